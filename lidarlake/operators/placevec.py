"""Place descriptors of whole maps inside tasks.

A map of at most POINTS_IN_TASK points meets in one task: its clouds are moved into the frames of their neighbours,
thinned and described there, so the copies of a point in overlapping submaps and their cells are never shuffled or
written. The formulas are those of ``descriptors``, which larger maps go through.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.functions import vectors as V
from lidarlake.functions.numpose import compose, inverse, rotate
from lidarlake.operators.scanmatch import thin_points
from lidarlake.schema import POSE_FIELDS


def _bins(v, lo, hi, n):
    return np.clip(np.floor((v - lo) / (hi - lo) * n).astype(int), 0, n - 1)


def _azimuth(x, y, n):
    return np.clip(np.floor((np.arctan2(y, x) + np.pi) / (2 * np.pi) * n).astype(int), 0, n - 1)


def _extremes(cell, value, n):
    lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(lo, cell, value)
    np.maximum.at(hi, cell, value)
    return lo, hi


def _planes(out, x, y, z, angle, rng, z_min, z_max):
    c, s = np.cos(angle), np.sin(angle)
    ax, ay = x * c + y * s, y * c - x * s
    flat, tall, n = (-rng, rng), (z_min, z_max), V.BINS * V.BINS
    for plane, (a, b, h) in enumerate((((ax, flat), (ay, flat), (z, tall)), ((ax, flat), (z, tall), (ay, flat)), ((ay, flat), (z, tall), (ax, flat)))):
        inside = (a[0] >= a[1][0]) & (a[0] < a[1][1]) & (b[0] >= b[1][0]) & (b[0] < b[1][1])
        if not inside.any():
            continue
        cell = _bins(a[0][inside], *a[1], V.BINS) * V.BINS + _bins(b[0][inside], *b[1], V.BINS)
        height = np.clip((h[0][inside] - h[1][0]) / (h[1][1] - h[1][0]), 0.0, 1.0)
        count, total = np.bincount(cell, minlength=n), np.bincount(cell, height, n)
        lo, hi = _extremes(cell, height, n)
        full = np.flatnonzero(count)
        some = count[full]
        part = out[plane * V.PLANE_DIM : (plane + 1) * V.PLANE_DIM].reshape(n, V.PLANE_CH)
        part[full] = np.stack([some / count.sum(), total[full] / some, some / count.max(), hi[full] - lo[full]], axis=1)


def _rings(out, x, y, z, r, near, rng, z_min, z_max, azimuths):
    keep = near & (z >= z_min) & (z < z_max)
    if not keep.any():
        return
    r, z = r[keep], z[keep]
    ring, layer = np.clip(np.floor(r / rng * V.RINGS).astype(int), 0, V.RINGS - 1), _bins(z, z_min, z_max, V.LAYERS)
    azimuth, n = _azimuth(x[keep], y[keep], azimuths), V.RINGS * V.LAYERS
    cell = ring * V.LAYERS + layer
    fine = np.bincount(cell * azimuths + azimuth, minlength=n * azimuths).reshape(n, azimuths)
    count, squares = fine.sum(1), (fine.astype(float) ** 2).sum(1)
    full = np.flatnonzero(count)
    some = count[full]
    mean = np.bincount(cell, r, n)[full] / some
    spread = np.maximum(np.bincount(cell, r * r, n)[full] / some - mean * mean, 0.0)
    each = some / azimuths
    variance = (squares[full] - some * some / azimuths) / azimuths
    part = out[V.PART_A : V.SECTOR_BASE].reshape(n, V.RING_CH)
    part[full] = np.stack([some / count.sum(), np.minimum(variance / (each * each), 10.0) / 10.0, mean / rng, np.sqrt(spread) / rng], axis=1)
    # Occupied-layer patterns of coarse rings, sectors and layers.
    per, layers = V.RINGS // V.TOKEN_RINGS, V.LAYERS // 4
    taken = (fine > 0).reshape(V.TOKEN_RINGS, per, 4, layers, azimuths).any((1, 3))
    token = (taken * np.array([1, 2, 4, 8])[None, :, None]).sum(1)
    for i, row in enumerate(token):
        row = row[row > 0]
        if len(row):
            out[V.TOKEN_BASE + i * V.TOKENS : V.TOKEN_BASE + (i + 1) * V.TOKENS] = np.bincount(row, minlength=V.TOKENS) / len(row)


def _sectors(out, x, y, r, near, rng):
    if not near.any():
        return
    s = V.SECTORS
    lo, hi = _extremes(_azimuth(x[near], y[near], s), r[near], s)
    seen = np.isfinite(lo)
    beside = np.roll(seen, 1) | np.roll(seen, -1)
    state = np.where(seen, np.where(hi >= 0.75 * rng, 1.0, 0.0), np.where(beside, 0.75, 0.5))
    with np.errstate(invalid="ignore"):
        nearest, span = np.where(seen, np.clip(lo / rng, 0.0, 1.0), 1.0), np.where(seen, np.clip((hi - lo) / rng, 0.0, 1.0), 0.0)
    out[V.SECTOR_BASE : V.TOKEN_BASE] = np.stack([nearest, span, state], axis=1).ravel()


def describe(points: np.ndarray, min_points, rng=30.0, z_min=-2.0, z_max=6.0, azimuths=36) -> np.ndarray:
    """Full vector of one cloud; zeros where it has too few points."""
    out = np.zeros(V.RHPD_DIM)
    if len(points) < min_points:
        return out
    x, y, z = points.T
    dx, dy = x - x.mean(), y - y.mean()
    cxx, cxy, cyy = (dx * dx).mean(), (dx * dy).mean(), (dy * dy).mean()
    gap, mid = np.sqrt(((cxx - cyy) / 2) ** 2 + cxy**2), (cxx + cyy) / 2
    l1, l2 = max(mid + gap, 0.0), max(mid - gap, 0.0)
    out[V.CONF_INDEX] = 0.0 if l1 + l2 <= 1e-9 else min(max((l1 - l2) / (l1 + l2), 0.0), 1.0)
    _planes(out, x, y, z, 0.5 * np.arctan2(2 * cxy, cxx - cyy), rng, z_min, z_max)
    r = np.sqrt(x * x + y * y)
    near = (r > 0.1) & (r < rng)
    _rings(out, x, y, z, r, near, rng, z_min, z_max, azimuths)
    _sectors(out, x, y, r, near, rng)
    return out


def submap_vectors(keyframes: DataFrame, points: DataFrame, radius, leaf, min_points) -> DataFrame:
    """map_id, kf_id, rhpd of the clouds of every keyframe and the ``radius`` ids before it, for maps that fit a task."""
    poses = keyframes.select("map_id", "kf_id", *(F.col(f"opt.{f}").cast("double").alias(f) for f in POSE_FIELDS)).dropna()
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(p: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not p.empty and not k.empty:
            xyz = p[["x", "y", "z"]].to_numpy(float)
            owner, xyz = p["kf_id"].to_numpy()[fine := np.isfinite(xyz).all(1)], xyz[fine]
            order = np.argsort(owner, kind="stable")
            owner, xyz = owner[order], xyz[order]
            places = {}
            for i, pose in zip(k["kf_id"].tolist(), k[list(POSE_FIELDS)].to_numpy().tolist()):
                places.setdefault(i, []).append(pose)
            own = {i: xyz[slice(*np.searchsorted(owner, [i, i + 1]))] for i in places}
            for center, roots in places.items():
                parts = []
                for root in map(inverse, roots):
                    for i in range(center - radius, center + 1):
                        for pose in places.get(i, ()) if len(own.get(i, ())) else ():
                            t = compose(root, pose)
                            parts.append(rotate(np.array(t[3:]), own[i]) + t[:3])
                if parts:
                    cloud = np.concatenate(parts)
                    rows.append((center, describe(thin_points(cloud, leaf) if leaf > 1e-4 else cloud, min_points)))
        out = pd.DataFrame(rows, columns=["kf_id", "rhpd"])
        out.insert(0, "map_id", k["map_id"].iloc[0] if rows else 0)
        return out

    near = points.select("map_id", "kf_id", "x", "y", "z").repartition(width, "map_id").groupBy("map_id")
    return near.cogroup(poses.repartition(width, "map_id").groupBy("map_id")).applyInPandas(run, "map_id long, kf_id long, rhpd array<double>")
