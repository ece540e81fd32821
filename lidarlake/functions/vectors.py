"""Distances between descriptors. Arrow-batched numpy kernels; pairs are chosen by joins."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.pose import _col

# Layout of the planar / ring-height vector; fixed values.
PLANES, BINS, PLANE_CH = 3, 14, 4
RINGS, LAYERS, RING_CH = 16, 8, 4
SECTORS, SECTOR_CH = 36, 3
TOKEN_RINGS, TOKENS = 4, 16
PLANE_DIM = BINS * BINS * PLANE_CH
PART_A = PLANES * PLANE_DIM
PART_B = RINGS * LAYERS * RING_CH
SECTOR_BASE = PART_A + PART_B
TOKEN_BASE = SECTOR_BASE + SECTORS * SECTOR_CH
CONF_INDEX = TOKEN_BASE + TOKEN_RINGS * TOKENS
RHPD_DIM = CONF_INDEX + 1
COARSE_DIM = RINGS + SECTORS + TOKEN_RINGS * TOKENS + 1

# Channel weights of the polar descriptor: max height, height spread, density, four layers.
POLAR_CHANNELS, POLAR_RINGS, POLAR_SECTORS = 7, 20, 60
POLAR_WEIGHTS = (1.0, 0.8, 0.6, 0.7, 0.7, 0.7, 0.7)


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance of two arrays."""
    diff = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v)


def _flip_index():
    """Where each value of the half-turned vector comes from.

    Half a turn mirrors both axes of the first plane and the horizontal axis of the two upright
    planes, and moves every sector to the opposite side; everything else stays.
    """
    idx = np.arange(RHPD_DIM)
    planes = idx[:PART_A].reshape(PLANES, BINS, BINS, PLANE_CH)
    turned = np.stack([planes[0, ::-1, ::-1], planes[1, ::-1], planes[2, ::-1]])
    sectors = np.roll(idx[SECTOR_BASE:TOKEN_BASE].reshape(SECTORS, SECTOR_CH), SECTORS // 2, axis=0)
    return np.concatenate(
        [turned.ravel(), idx[PART_A:SECTOR_BASE], sectors.ravel(), idx[TOKEN_BASE:]]
    )


_FLIP = _flip_index()
# Types as objects: workers import this module without a session to parse type names.
_SHIFTED = T.StructType(
    [T.StructField("distance", T.DoubleType()), T.StructField("shift", T.IntegerType())]
)


def rhpd_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise distance of two stacks of full vectors, the better of both orientations."""
    w = 0.35 + 0.65 * np.minimum(np.clip(a[:, -1], 0, 1), np.clip(b[:, -1], 0, 1))

    def one(lhs):
        d = (lhs - b) ** 2
        return (
            w * d[:, :PART_A].sum(1) + d[:, PART_A:SECTOR_BASE].sum(1) + 0.5 * d[:, SECTOR_BASE:].sum(1)
        )

    return np.sqrt(np.minimum(one(a), one(a[:, _FLIP])))


def polar_distances(a, b, channels, weights, eps=1e-6, search=3, order="near", batch=32):
    """Distances and column shifts (of ``b``) between two equally long lists of polar matrices.

    A missing or ill-sized matrix gives distance 1 and shift 0.
    """
    good = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and 0 < len(x) == len(y)]
    distance, shift = np.ones(len(a)), np.zeros(len(a), int)
    by_size = {}
    for k in good:
        by_size.setdefault(len(a[k]), []).append(k)
    for rows in by_size.values():
        for i in range(0, len(rows), batch):
            part = rows[i : i + batch]
            x, y = (np.stack([np.asarray(m[k], float) for k in part]) for m in (a, b))
            shape = (len(part), channels, -1, POLAR_SECTORS)
            distance[part], shift[part] = _polar_batch(x.reshape(shape), y.reshape(shape), np.asarray(weights), eps, search, order)
    return distance, shift


def _polar_batch(a, b, weights, eps, search, order):
    s, each = POLAR_SECTORS, np.arange(POLAR_SECTORS)
    ka, kb = a.mean((1, 2)), b.mean((1, 2))
    # turned[n, k, c] = kb[n, c - k]: the key of b after shifting its columns by k.
    turned = kb[:, (each[None, :] - each[:, None]) % s]
    coarse = ((ka[:, None, :] - turned) ** 2).sum(2).argmin(1)
    steps = [0, *(v for i in range(1, search + 1) for v in (i, -i))]
    near = (coarse[:, None] + np.array(steps)) % s
    if order == "sorted":
        near = np.sort(near, axis=1)
    na, nb = np.sqrt((a * a).sum(2)), np.sqrt((b * b).sum(2))
    best, best_shift = np.full(len(a), np.inf), np.zeros(len(a), int)
    # A shifted matrix is a run of columns of the matrix set beside itself.
    runs, lengths = (np.lib.stride_tricks.sliding_window_view(np.concatenate([v, v], axis=-1), s, axis=-1) for v in (b, nb))
    rows = np.arange(len(a))
    for k in near.T:
        bk, nk = runs[rows, :, :, -k % s], lengths[rows, :, -k % s]
        ok = (na >= eps) & (nk >= eps) if eps > 0 else (na > 0) & (nk > 0)
        sim = np.where(ok, np.einsum("ncrs,ncrs->ncs", a, bk) / np.where(ok, na * nk, 1.0), 0.0)
        n = ok.sum(2)
        w = weights * (n > 0)
        total = w.sum(1)
        d = (w * (1.0 - sim.sum(2) / np.maximum(n, 1))).sum(1) / np.where(total > 0, total, 1.0)
        d = np.where((n > 0).any(1), d, 1.0)
        better = d < best
        best, best_shift = np.where(better, d, best), np.where(better, k, best_shift)
    return best, best_shift


def polar_distance_one(a, b, channels, weights, eps=1e-6, search=3, order="near"):
    """Distance and column shift of one pair."""
    d, k = polar_distances([a], [b], channels, weights, eps, search, order)
    return float(d[0]), int(k[0])


@F.pandas_udf(T.DoubleType())
def rhpd_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance of two full vectors; NULL when either has the wrong size."""
    ok = np.array(
        [x is not None and y is not None and len(x) == RHPD_DIM and len(y) == RHPD_DIM for x, y in zip(a, b)],
        dtype=bool,
    )
    out = np.full(len(a), np.nan)
    if ok.any():
        out[ok] = rhpd_distances(np.stack(a[ok].to_numpy()), np.stack(b[ok].to_numpy()))
    return pd.Series(out).where(ok, None)


@F.pandas_udf(_SHIFTED)
def polar_distance(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Weighted channel-wise cosine distance under the best column shift of ``b``."""
    d, k = polar_distances(a.to_numpy(), b.to_numpy(), POLAR_CHANNELS, POLAR_WEIGHTS)
    return pd.DataFrame({"distance": d, "shift": k})


@F.pandas_udf(_SHIFTED)
def polar_distance_classic(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Same for the single-channel matrix; every non-zero column counts."""
    d, k = polar_distances(a.to_numpy(), b.to_numpy(), 1, (1.0,), eps=0.0, order="sorted")
    return pd.DataFrame({"distance": d, "shift": k})


def dense_vector(dim: int):
    """Column function (indices, values) -> dense array of ``dim`` zeros with the values set; indices do not repeat.

    Built row by row inside Spark, so no batch of wide arrays is ever held in a Python worker.
    """

    def entry(i, v):
        return F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))

    def scatter(idx, val) -> Column:
        # ``sort_array``: the comparison of ``array_sort`` is a lambda, interpreted for every pair of entries.
        entries = F.sort_array(F.zip_with(_col(idx), _col(val), entry))
        before = F.concat(F.array(entry(F.lit(-1), F.lit(0.0))), entries)
        here = F.concat(entries, F.array(entry(F.lit(dim), F.lit(0.0))))
        # Each entry with the zeros between it and the one before; the last one only ends the row.
        runs = F.zip_with(before, here, lambda p, e: F.concat(F.array_repeat(F.lit(0.0), e["i"] - p["i"] - 1), F.array(e["v"])))
        return F.slice(F.flatten(runs), 1, dim)

    return scatter


def coarse_key(vec) -> Column:
    """117 values for preselection: ring densities, sector blend, tokens, confidence."""
    v = _col(vec)
    rings = [
        sum(
            (v[PART_A + (r * LAYERS + z) * RING_CH] for z in range(1, LAYERS)),
            v[PART_A + r * LAYERS * RING_CH],
        )
        for r in range(RINGS)
    ]
    sectors = [
        0.6 * v[SECTOR_BASE + s * SECTOR_CH]
        + 0.25 * v[SECTOR_BASE + s * SECTOR_CH + 1]
        + 0.15 * v[SECTOR_BASE + s * SECTOR_CH + 2]
        for s in range(SECTORS)
    ]
    return F.concat(
        F.array(*rings, *sectors),
        F.slice(v, TOKEN_BASE + 1, TOKEN_RINGS * TOKENS),
        F.array(v[CONF_INDEX]),
    )
