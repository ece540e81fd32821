"""Rigid poses as sequences of seven numbers (tx, ty, tz, qx, qy, qz, qw) inside tasks."""

import math

import numpy as np

IDENTITY = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def rotate(q, v):
    """One vector or an array of them."""
    u = 2 * np.cross(q[:3], v)
    return v + q[3] * u + np.cross(q[:3], u)


def _turn(q, v):
    """The same for one vector, in plain floats: arrays of three cost far more than their arithmetic."""
    u = [2 * c for c in _cross(q, v)]
    w = _cross(q, u)
    return [v[i] + q[3] * u[i] + w[i] for i in range(3)]


def compose(a, b):
    a, b = list(map(float, a)), list(map(float, b))
    qa, qb = a[3:], b[3:]
    c, r = _cross(qa, qb), _turn(qa, b)
    vec = [qa[3] * qb[i] + qb[3] * qa[i] + c[i] for i in range(3)]
    dot = qa[0] * qb[0] + qa[1] * qb[1] + qa[2] * qb[2]
    return [*(a[i] + r[i] for i in range(3)), *vec, qa[3] * qb[3] - dot]


def inverse(a):
    a = list(map(float, a))
    q = [-a[3], -a[4], -a[5], a[6]]
    return [*(-c for c in _turn(q, a)), *q]


def distance(a, b):
    return math.dist(a[:3], b[:3])


def angle(a):
    return 2 * math.atan2(math.hypot(*a[3:6]), abs(a[6]))


def small_step(x):
    """Pose of a step of three translations and a rotation vector."""
    turn = float(np.linalg.norm(x[3:]))
    k = math.sin(turn / 2) / turn if turn > 1e-12 else 0.5
    return [*map(float, x[:3]), *(k * v for v in map(float, x[3:])), math.cos(turn / 2)]
