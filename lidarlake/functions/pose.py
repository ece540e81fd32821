"""Rigid poses as Column expressions.

A pose is a struct ``tx,ty,tz,qx,qy,qz,qw``. All functions take and return Columns, stay inside
code generation, and assume unit quaternions unless they say otherwise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lidarlake.schema import POSE_FIELDS


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _fields(pose):
    p = _col(pose)
    return tuple(p.getField(f) for f in POSE_FIELDS)


def make_pose(tx, ty, tz, qx, qy, qz, qw) -> Column:
    values = (tx, ty, tz, qx, qy, qz, qw)
    return F.struct(
        *(_lit(v).cast("double").alias(f) for v, f in zip(values, POSE_FIELDS, strict=True))
    )


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def identity_pose() -> Column:
    return make_pose(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def yaw_pose(yaw) -> Column:
    """Pure rotation about the vertical axis."""
    half = _lit(yaw) / 2
    return make_pose(0.0, 0.0, 0.0, 0.0, 0.0, F.sin(half), F.cos(half))


def pose_normalize(pose) -> Column:
    """Scale the quaternion to unit length."""
    tx, ty, tz, qx, qy, qz, qw = _fields(pose)
    n = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    return make_pose(tx, ty, tz, *(F.try_divide(q, n) for q in (qx, qy, qz, qw)))


def quat_to_rot(pose) -> Column:
    """Rotation matrix, row-major array of nine."""
    _, _, _, x, y, z, w = _fields(pose)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def _rotate(q, v):
    """Rotate v by q through two cross products."""
    x, y, z, w = q
    a, b, c = v
    ux, uy, uz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return (
        a + w * ux + (y * uz - z * uy),
        b + w * uy + (z * ux - x * uz),
        c + w * uz + (x * uy - y * ux),
    )


def transform_xyz(pose, x, y, z):
    """The three coordinates of a point moved by ``pose``."""
    tx, ty, tz, qx, qy, qz, qw = _fields(pose)
    rx, ry, rz = _rotate((qx, qy, qz, qw), (_col(x), _col(y), _col(z)))
    return rx + tx, ry + ty, rz + tz


def pose_compose(a, b) -> Column:
    """First ``b``, then ``a``."""
    atx, aty, atz, ax, ay, az, aw = _fields(a)
    btx, bty, btz, bx, by, bz, bw = _fields(b)
    rx, ry, rz = _rotate((ax, ay, az, aw), (btx, bty, btz))
    return make_pose(
        rx + atx, ry + aty, rz + atz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def pose_inverse(pose) -> Column:
    tx, ty, tz, x, y, z, w = _fields(pose)
    rx, ry, rz = _rotate((-x, -y, -z, w), (tx, ty, tz))
    return make_pose(-rx, -ry, -rz, -x, -y, -z, w)


def pose_between(a, b) -> Column:
    """``b`` seen from ``a``."""
    atx, aty, atz, ax, ay, az, aw = _fields(a)
    btx, bty, btz, bx, by, bz, bw = _fields(b)
    rx, ry, rz = _rotate((-ax, -ay, -az, aw), (btx - atx, bty - aty, btz - atz))
    return make_pose(
        rx, ry, rz,
        aw * bx - ax * bw - ay * bz + az * by,
        aw * by + ax * bz - ay * bw - az * bx,
        aw * bz - ax * by + ay * bx - az * bw,
        aw * bw + ax * bx + ay * by + az * bz,
    )


def translation_norm(pose) -> Column:
    tx, ty, tz, *_ = _fields(pose)
    return F.sqrt(tx * tx + ty * ty + tz * tz)


def translation_distance(a, b) -> Column:
    ax, ay, az, *_ = _fields(a)
    bx, by, bz, *_ = _fields(b)
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def rotation_angle(pose) -> Column:
    """Absolute turning angle in [0, pi]."""
    *_, x, y, z, w = _fields(pose)
    return 2 * F.atan2(F.sqrt(x * x + y * y + z * z), F.abs(w))


def yaw_of(pose) -> Column:
    *_, x, y, z, w = _fields(pose)
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def planar_yaw_error_deg(estimate, truth) -> Column:
    """Heading difference of the forward axes, wrapped to half a turn."""
    diff = yaw_of(estimate) - yaw_of(truth)
    return F.abs(F.degrees(F.atan2(F.sin(diff), F.cos(diff))))


def roll_pitch_error_deg(estimate, truth) -> Column:
    """Angle between the up axes."""

    def up(pose):
        *_, x, y, z, w = _fields(pose)
        return 2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)

    a, b = up(estimate), up(truth)
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def pose_lerp(a, b, alpha, alpha_z=None) -> Column:
    """Blend two poses: straight line for the position, shortest arc for the rotation."""
    atx, aty, atz, ax, ay, az, aw = _fields(a)
    btx, bty, btz, bx, by, bz, bw = _fields(b)
    t = _lit(alpha)
    tz = t if alpha_z is None else _lit(alpha_z)
    dot = ax * bx + ay * by + az * bz + aw * bw
    near = F.abs(dot) >= 1.0 - 1e-15
    theta = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    sin_theta = F.sin(theta)
    wa = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * theta), sin_theta))
    wb = F.when(near, t).otherwise(F.try_divide(F.sin(t * theta), sin_theta))
    wb = F.when(dot < 0, -wb).otherwise(wb)
    return make_pose(
        (1 - t) * atx + t * btx, (1 - t) * aty + t * bty, (1 - tz) * atz + tz * btz,
        wa * ax + wb * bx, wa * ay + wb * by, wa * az + wb * bz, wa * aw + wb * bw,
    )


def map_odom(optimized, odom) -> Column:
    """Correction that carries odometry poses into the map frame."""
    return pose_compose(optimized, pose_inverse(odom))


def stamp_ns(sec, nanosec) -> Column:
    return _col(sec).cast("long") * F.lit(1_000_000_000).cast("long") + _col(nanosec).cast("long")


def ns_to_seconds(ns) -> Column:
    return _col(ns).cast("double") * F.lit(1e-9)
