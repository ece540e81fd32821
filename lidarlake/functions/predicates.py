"""Row predicates on points, poses, clouds, descriptors and matches."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lidarlake.functions.pose import _col, _fields
def _finite(values) -> Column:
    """True if no value is NULL, NaN or infinite.

    Zero times a value is zero only for finite values. Each value is used once, so long
    coordinate expressions are not repeated in the generated code.
    """
    total = None
    for v in values:
        part = _col(v) * F.lit(0.0)
        total = part if total is None else total + part
    return F.coalesce(total == F.lit(0.0), F.lit(False))


def is_finite(value) -> Column:
    return _finite([value])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def is_finite_point(x="x", y="y", z="z", intensity=None) -> Column:
    return _finite([x, y, z] + ([intensity] if intensity is not None else []))


def is_finite_pose(pose) -> Column:
    f = _fields(pose)
    norm2 = f[3] * f[3] + f[4] * f[4] + f[5] * f[5] + f[6] * f[6]
    return F.coalesce(_finite(f) & is_finite(norm2) & (norm2 > 1e-12), F.lit(False))


def all_finite(values) -> Column:
    """Every element of an array is finite; NULL arrays are not."""
    return F.coalesce(F.forall(_col(values), is_finite), F.lit(False))


def voxel_coord_in_range(x, y, z, leaf, bits=20) -> Column:
    """The cell index of each coordinate fits a signed index of ``bits`` + 1 bits."""
    if leaf <= 0:
        return is_finite_point(x, y, z)
    bound = float(1 << bits)
    cells = [F.floor(_col(c) * F.lit(1.0 / leaf)) for c in (x, y, z)]
    return is_finite_point(x, y, z) & _all((c >= -bound) & (c <= bound - 1) for c in cells)


def cloud_layout_ok(values, n, cap=None) -> Column:
    """A flat cloud holds four values per point and respects the cap, if one is given."""
    n = _col(n)
    fits = F.lit(True) if cap is None else n <= cap
    return F.coalesce(fits & (F.size(_col(values)) == n * 4), F.lit(False))


def valid_descriptor(values, rows, cols=1, cap=None) -> Column:
    """The array itself if its shape is right and all values are finite, else NULL; ``cap`` bounds its length."""
    v, n = _col(values), F.lit(rows) * F.lit(cols)
    ok = (n > 0) & (F.size(v) == n) & all_finite(v)
    if cap is not None:
        ok = ok & (n <= cap)
    return F.when(ok, v)


def rear_sector(x="x", y="y", center_deg=180.0, width_deg=45.0, axis="x") -> Column:
    """Inside the sector around ``center_deg``, border included up to a millionth of a degree."""
    from lidarlake.functions.scores import wrap_deg

    x, y = _col(x), _col(y)
    forward, left = (y, -x) if axis == "y" else (x, y)
    diff = wrap_deg(F.degrees(F.atan2(left, forward)) - F.lit(float(center_deg)))
    return F.abs(diff) <= width_deg / 2 + 1e-6


def out_of_range(x="x", y="y", lo=0.0, hi=1e9) -> Column:
    r = F.hypot(_col(x), _col(y))
    return (r < lo) | (r > hi)


def self_box(x="x", y="y", z="z", box=(-1.0, 1.0, -1.0, 1.0, -1.0, 1.0)) -> Column:
    """Inside an axis-aligned box, faces included."""
    x0, x1, y0, y1, z0, z1 = box
    return _col(x).between(x0, x1) & _col(y).between(y0, y1) & _col(z).between(z0, z1)


def keep_reason(rules) -> Column:
    """First rule a point breaks, or ``keep``. ``rules`` is a plain dict of options."""
    reason = F.when(~is_finite_point("x", "y", "z", "intensity"), "non_finite")
    reason = reason.when(
        out_of_range("x", "y", rules.get("min_range", 0.0), rules.get("max_range", 1e9)), "range"
    )
    if rules.get("self_box"):
        reason = reason.when(self_box("x", "y", "z", rules["self_box"]), "self")
    if rules.get("rear_sector", True):
        reason = reason.when(
            rear_sector(
                "x", "y", rules.get("center_deg", 180.0), rules.get("width_deg", 45.0),
                rules.get("axis", "x"),
            ),
            "rear",
        )
    return reason.otherwise("keep")


def outside_backward_sector(cut_deg, x="x", y="y") -> Column:
    """Strictly ahead of the backward wedge of ``cut_deg`` degrees."""
    return F.abs(F.atan2(_col(y), _col(x))) < math.pi - math.radians(cut_deg) / 2


def loop_passes(min_inlier=0.5, max_fitness=0.3) -> Column:
    return (
        F.col("verified")
        & (F.col("query_id") >= 0)
        & (F.col("match_id") >= 0)
        & (F.col("inlier_ratio") >= min_inlier)
        & (F.col("fitness") <= max_fitness)
    )


def registration_passes(fitness=0.3, inlier=0.5, max_t=5.0, max_r=0.5, pose="T") -> Column:
    from lidarlake.functions.pose import rotation_angle, translation_norm

    ok = (
        F.col("converged")
        & (F.col("fitness") < fitness)
        & (F.col("inlier_ratio") >= inlier)
        & (translation_norm(pose) <= max_t)
        & (rotation_angle(pose) <= max_r)
    )
    return F.coalesce(ok, F.lit(False))


def reloc_passes(fitness=0.3, inlier=0.03, confidence=0.3) -> Column:
    from lidarlake.functions.scores import confidence as conf

    ok = (
        F.col("converged")
        & (F.col("fitness") < fitness)
        & (F.col("inlier_ratio") >= inlier)
        & (conf(F.col("fitness"), fitness) >= confidence)
    )
    return F.coalesce(ok, F.lit(False))


def pose_accurate(max_t=1.0, max_yaw=10.0, max_rp=5.0) -> Column:
    limits = {
        "translation_error_m": max_t,
        "yaw_error_deg": max_yaw,
        "roll_pitch_error_deg": max_rp,
    }
    ok = _all([F.col("locked")] + [is_finite(c) & (F.col(c) <= v) for c, v in limits.items()])
    return F.coalesce(ok, F.lit(False))
