"""Scalar expressions: polar bins, angle wraps, weights, likelihoods, information matrices."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lidarlake.functions.pose import _col, _lit

TWO_PI = 2 * math.pi


def wrap_deg(deg) -> Column:
    """Wrap to (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - _col(deg), F.lit(360.0))


def wrap360(deg) -> Column:
    return F.pmod(_col(deg), F.lit(360.0))


def azimuth_deg(x, y) -> Column:
    """Heading of (x, y) in [0, 360)."""
    deg = F.degrees(F.atan2(_col(y), _col(x)))
    return F.when(deg < 0, deg + 360.0).otherwise(deg)


def clamp(value, lo, hi) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def azimuth_bin(x, y, n) -> Column:
    """Sector in [0, n), counted from the negative x axis."""
    return clamp(F.floor((F.atan2(_col(y), _col(x)) + math.pi) / TWO_PI * n).cast("int"), 0, n - 1)


def polar_bin(x, y, rings=20, sectors=60, rmax=80.0, rmin=0.5, log=True) -> Column:
    """Struct (ring, sector), or NULL outside the radius band."""
    x, y = _col(x), _col(y)
    r = F.sqrt(x * x + y * y)
    if log:
        ring = F.floor(F.ln(r / rmin) / math.log(rmax / rmin) * rings)
    else:
        ring = F.ceil(r / rmax * rings) - 1
    sector = F.floor(azimuth_deg(x, y) / 360.0 * sectors)
    return F.when(
        (r >= rmin) & (r <= rmax),
        F.struct(
            clamp(ring.cast("int"), 0, rings - 1).alias("ring"),
            clamp(sector.cast("int"), 0, sectors - 1).alias("sector"),
        ),
    )


def circshift(desc, rows, cols, k) -> Column:
    """Rotate the columns of a row-major matrix by ``k`` to the right."""
    shift = F.pmod(_lit(k).cast("int"), F.lit(cols))
    row_of = [F.slice(_col(desc), 1 + r * cols, cols) for r in range(rows)]

    def turn(row):
        return F.when(shift == 0, row).otherwise(
            F.concat(F.slice(row, F.lit(cols) - shift + 1, shift), F.slice(row, F.lit(1), F.lit(cols) - shift))
        )

    return F.concat(*(turn(r) for r in row_of)) if rows > 1 else turn(row_of[0])


def _upper_index(i, j):
    i, j = min(i, j), max(i, j)
    return i * 6 - i * (i - 1) // 2 + (j - i)


def unpack_information(info21) -> Column:
    """Packed upper triangle to a full symmetric row-major 6x6; NULL if malformed."""
    from lidarlake.functions.predicates import all_finite

    v = _col(info21)
    full = F.array(*(v[_upper_index(i, j)] for i in range(6) for j in range(6)))
    return F.when((F.size(v) == 21) & all_finite(v), full)


def reorder_information(info21) -> Column:
    """Swap the translation and the rotation block of a packed matrix."""
    v = _col(info21)
    swap = [3, 4, 5, 0, 1, 2]
    return F.array(
        *(v[_upper_index(swap[i], swap[j])] for i in range(6) for j in range(i, 6))
    )


def diagonal_information(translation, rotation):
    """Packed diagonal matrix, plain list of 21."""
    return [
        (translation if i < 3 else rotation) if i == j else 0.0
        for i in range(6)
        for j in range(i, 6)
    ]


# Standard deviations (translation m, rotation rad) by constraint kind; fixed values.
NOISE = {"PRIOR": (0.01, 0.01), "ODOMETRY": (0.01, 0.001), "LOOP": (0.5, 0.5)}


def edge_information(kind) -> Column:
    """Default packed information of a constraint kind."""
    out = None
    for name, (t, r) in NOISE.items():
        value = F.array(*(F.lit(v) for v in diagonal_information(1 / (t * t), 1 / (r * r))))
        cond = _col(kind) == name
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def confidence(fitness, threshold=0.3) -> Column:
    scale = max(1e-6, threshold * 0.5)
    return clamp(F.exp(-_col(fitness) / scale), 0.0, 1.0)


def fused_score(rhpd, sc, thr=25.0, sc_thr=0.6, w1=1.0, w2=0.15) -> Column:
    """Weighted sum of both normalised distances; a missing second distance counts as one."""
    return w1 * (_col(rhpd) / max(1e-6, thr)) + w2 * F.coalesce(
        _col(sc) / max(1e-6, sc_thr), F.lit(1.0)
    )


def reloc_log_likelihood(
    fitness="fitness", inlier="inlier_ratio", distance="distance", converged="converged",
    thr=0.3, w_inlier=2.0, w_distance=0.2, penalty=8.0,
) -> Column:
    """Evidence of one registration; a missing distance makes no contribution."""
    good = (
        -_col(fitness) / max(1e-6, thr)
        + w_inlier * F.greatest(_col(inlier), F.lit(0.0))
        - w_distance * F.coalesce(_col(distance), F.lit(0.0))
    )
    return F.when(_col(converged), good).otherwise(F.lit(-penalty))


def track_log_likelihood(
    fitness="fitness", inlier="inlier_ratio", motion="motion", converged="converged",
    thr=0.3, w_inlier=2.0, w_motion=0.5, penalty=8.0,
) -> Column:
    return reloc_log_likelihood(fitness, inlier, motion, converged, thr, w_inlier, w_motion, penalty)


def robust_weight(norm, kind="Cauchy", delta=1.0) -> Column:
    """Weight of a whitened residual norm under a robust loss."""
    e = F.abs(_col(norm))
    if kind == "Huber":
        return F.when(e <= delta, F.lit(1.0)).otherwise(F.try_divide(F.lit(float(delta)), e))
    if kind == "Cauchy":
        return 1.0 / (1.0 + e * e / (delta * delta))
    if kind == "DCS":
        e2 = e * e
        scale = 2.0 * delta / (delta + e2)
        return F.when(e2 > delta, scale * scale).otherwise(F.lit(1.0))
    return F.lit(1.0)


def yaw_seeds(yaw, has_yaw, sector_deg=6.0, n=4) -> Column:
    """Array of start angles: around a known yaw, or evenly spaced."""
    step = math.radians(sector_deg)
    n = max(1, n)
    y = _col(yaw)
    return F.when(_col(has_yaw), F.array(y, y - step, y + step)).otherwise(
        F.array(*(F.lit(TWO_PI * i / n) for i in range(n)))
    )


def blend_alpha(conf, distance) -> Column:
    """Step factor of the tracking filter by correction distance."""
    c, d = _col(conf), _col(distance)
    step = (
        F.when(d <= 0.5, F.least(c * 0.3, F.lit(0.2)))
        .when(d <= 2.0, F.least(c * 0.15, F.lit(0.1)))
        .otherwise(F.least(c * 0.08, F.lit(0.05)))
    )
    return F.greatest(step, F.lit(0.01))


def trajectory_source_state(source, has_rows, event="append") -> Column:
    """Source label of a trajectory after ``append`` of a live sample or at ``save``."""
    s, rows = F.coalesce(_col(source), F.lit("")), _col(has_rows)
    unset = s.isin("", "none")
    mixed = "mixed_keyframe_fallback_and_high_rate"
    if event == "append":
        return F.when(s == "keyframe_fallback", mixed).when(unset, "native").otherwise(s)
    return F.when(~rows, "none").when(unset, "native").otherwise(s)
