"""Evaluation of localization results and range images of map clouds."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions.predicates import is_finite, pose_accurate
from lidarlake.functions.scores import azimuth_deg, clamp, wrap360

CLOUD = ["map_id", "kf_id"]
ERRORS = ("translation_error_m", "yaw_error_deg", "roll_pitch_error_deg")


def exact_percentiles(df: DataFrame, keys, value: str, fractions: dict) -> DataFrame:
    """Linearly interpolated percentiles per key; ``fractions`` maps output names to [0, 1].

    Works on counts of distinct values cut into chunks by a rough quantile, so neither a hot key
    nor a value shared by many rows ends up whole in one task.
    """
    keys = list(keys)
    counts = df.filter(is_finite(value)).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    span = counts.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"),
        F.count(F.lit(1)).alias("_d"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.greatest(F.lit(1.0), F.col("_d") / 10000.0)
    chunk = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width)).otherwise(F.lit(0))
    rows = counts.join(span, keys).withColumn("_chunk", chunk.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_c").alias("_m"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"))
    )
    upto = (
        Window.partitionBy(*keys, "_chunk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = (
        rows.withColumn("_in", F.sum("_c").over(upto))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("_end", F.col("_off") + F.col("_in") - 1)
        .withColumn("_start", F.col("_end") - F.col("_c") + 1)
    )
    picks = []
    for name, q in fractions.items():
        at = F.lit(q) * (F.col("_n") - 1)
        lo, hi = F.floor(at), F.ceil(at)

        def value_at(rank):
            return F.max(F.when((F.col("_start") <= rank) & (rank <= F.col("_end")), F.col("_v")))

        frac = F.max(at - lo)
        picks.append((value_at(lo) * (1 - frac) + value_at(hi) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def with_errors_nulled(results: DataFrame) -> DataFrame:
    """Errors count only for locked queries."""
    return results.withColumns({c: F.when(F.col("locked"), F.col(c)) for c in ERRORS})


def eval_summary(results: DataFrame, keys=(), id_lists=True, **limits) -> DataFrame:
    """Counts, rates and error percentiles of localization results, per ``keys`` or overall.

    ``results``: query_id, locked, match_id and the three errors. With ``id_lists`` the failing
    ids follow as sorted arrays (a report for evaluation runs, whose size the caller chose).
    """
    keys = list(keys)
    group = keys or ["_all"]
    rows = results if keys else results.withColumn("_all", F.lit(0))
    ok = pose_accurate(**limits)
    aggs = [
        F.count(F.lit(1)).alias("tested"),
        F.count_if("locked").alias("lock_success"),
        F.count_if(ok).alias("pose_success"),
        F.count_if(F.col("locked") & (F.col("match_id") == F.col("query_id"))).alias("self_matches"),
    ]
    if id_lists:
        aggs += [
            F.array_sort(F.collect_list(F.when(~F.col("locked"), F.col("query_id")))).alias("failed_ids"),
            F.array_sort(F.collect_list(F.when(~ok, F.col("query_id")))).alias("inaccurate_ids"),
        ]
    out = rows.groupBy(*group).agg(*aggs)
    locked = rows.filter("locked")
    for c in ERRORS:
        stats = exact_percentiles(locked, group, c, {f"median_{c}": 0.5, f"p95_{c}": 0.95})
        out = out.join(stats, group, "left")
    out = out.withColumn("lock_success_rate", F.col("lock_success") / F.col("tested")).withColumn(
        "pose_success_rate", F.col("pose_success") / F.col("tested")
    )
    return out if keys else out.drop("_all")


def eval_matrix(results: DataFrame, keys=("dropout", "noise_sigma", "fake_yaw_deg", "query_source"), **limits):
    """The summary for every cell of a sweep."""
    return eval_summary(results, keys, id_lists=False, **limits)


def strict_pass(summary: DataFrame, min_rate=0.95, max_t=1.0, max_yaw=10.0) -> DataFrame:
    """Whether a summary meets the acceptance limits; a missing median fails nothing."""
    ok = (
        (F.col("pose_success_rate") >= min_rate)
        & F.coalesce(F.col("median_translation_error_m") <= max_t, F.lit(True))
        & F.coalesce(F.col("median_yaw_error_deg") <= max_yaw, F.lit(True))
    )
    return summary.withColumn("strict_pass", ok)


def default_envelope(fov_azimuth=0.0, fov_vertical=0.0):
    """Plain values (full, start, span, low, high) used for clouds with too few points."""
    full = fov_azimuth <= 0 or fov_azimuth >= 360
    half = (fov_vertical if fov_vertical > 0 else 60.0) / 2
    return full, 0.0 if full else -fov_azimuth / 2, 360.0 if full else fov_azimuth, -half, half


def scan_envelope(
    points: DataFrame, keys=CLOUD, range_min=0.5, range_max=30.0, fov_azimuth=0.0, fov_vertical=0.0
) -> DataFrame:
    """Observed field of view of each cloud from the widest empty azimuth gap and the elevations."""
    keys = list(keys)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r = F.sqrt(x * x + y * y + z * z)
    rays = (
        points.filter(is_finite(r) & (r >= range_min) & (r <= range_max))
        .select(*keys, azimuth_deg("x", "y").alias("az"), F.degrees(F.atan2(z, F.hypot(x, y))).alias("el"))
        .withColumn("_deg", F.floor("az"))
    )
    # Gaps inside one degree come from neighbours in the degree, wider ones from degree ends.
    inside = Window.partitionBy(*keys, "_deg").orderBy("az")
    gaps_in = rays.withColumn("b", F.lead("az").over(inside)).filter("b is not null").select(
        *keys, (F.col("b") - F.col("az")).alias("gap"), F.col("az").alias("a"), "b"
    )
    degrees = rays.groupBy(*keys, "_deg").agg(F.min("az").alias("first"), F.max("az").alias("last"))
    around = Window.partitionBy(*keys).orderBy("_deg")
    whole = Window.partitionBy(*keys)
    nxt = F.coalesce(F.lead("first").over(around), F.min("first").over(whole) + 360.0)
    gaps_out = degrees.select(*keys, (nxt - F.col("last")).alias("gap"), F.col("last").alias("a"), nxt.alias("b"))
    widest = (
        gaps_in.unionByName(gaps_out)
        .groupBy(*keys)
        .agg(F.max_by(F.struct("gap", "b"), F.struct("gap", -F.col("a"))).alias("g"))
    )
    counts = points.select(*keys).distinct().join(
        rays.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left"
    )
    tilt = exact_percentiles(rays, keys, "el", {"v1": 0.01, "v99": 0.99})
    d = default_envelope(fov_azimuth, fov_vertical)
    gap, start = F.col("g.gap"), wrap360("g.b")
    span = F.greatest(F.lit(1.0), 360.0 - gap)
    if fov_azimuth > 0:
        span = F.least(span, F.lit(float(fov_azimuth)))
    full = span >= 330.0
    begin = wrap360(wrap360(start + (360.0 - gap) / 2) - span / 2)
    if fov_vertical > 0:
        mid = (F.col("v1") + F.col("v99")) / 2
        half = F.least(F.lit(float(fov_vertical)), F.greatest(F.lit(1.0), F.col("v99") - F.col("v1"))) / 2
        low, high = mid - half, mid + half
    else:
        low, high = F.col("v1"), F.col("v99")
    ok = F.coalesce(F.col("n") >= 8, F.lit(False))

    def pick(value, default):
        return F.when(ok, value).otherwise(F.lit(default))

    return counts.join(widest, keys, "left").join(tilt, keys, "left").select(
        *keys,
        ok.alias("valid"),
        pick(full, d[0]).alias("azimuth_full"),
        pick(F.when(full, 0.0).otherwise(begin), d[1]).alias("azimuth_start"),
        pick(F.when(full, 360.0).otherwise(span), d[2]).alias("azimuth_span"),
        pick(low, d[3]).alias("vertical_min"),
        pick(high, d[4]).alias("vertical_max"),
    )


def range_image(
    points: DataFrame, envelope: DataFrame, keys=CLOUD, range_min=0.5, range_max=30.0, res_deg=1.0
) -> DataFrame:
    """Nearest point per (azimuth, elevation) cell; points are in the frame of the view.

    Output: keys, row, col, azimuth_full, n_cols, range, x, y, z, intensity.
    """
    keys = list(keys)
    e = F.col
    x, y, z = e("x"), e("y"), e("z")
    r = F.sqrt(x * x + y * y + z * z)
    view = (
        points.join(envelope, keys)
        .withColumn("range", r)
        .withColumn("_az", azimuth_deg("x", "y"))
        .withColumn("_el", F.degrees(F.atan2(z, F.hypot(x, y))))
        .withColumn("_rel", wrap360(e("_az") - e("azimuth_start")))
        .filter((e("range") >= range_min) & (e("range") <= range_max))
        .filter(e("_el").between(e("vertical_min"), e("vertical_max")))
        .filter(e("azimuth_full") | (e("_rel") <= e("azimuth_span")))
    )
    cols = F.greatest(F.lit(1), F.ceil(clamp(e("azimuth_span"), 1.0, 360.0) / res_deg))
    rows = F.greatest(F.lit(1), F.ceil(clamp(e("vertical_max") - e("vertical_min"), 1.0, 180.0) / res_deg))
    angle = F.when(e("azimuth_full"), e("_az")).otherwise(e("_rel"))

    def cell(v, n):
        return F.least(F.greatest(F.floor(v / res_deg), F.lit(0)), n - 1)

    hit = F.struct("range", "x", "y", "z", "intensity")
    return (
        view.withColumn("n_cols", cols)
        .withColumn("col", cell(angle, cols))
        .withColumn("row", cell(e("_el") - e("vertical_min"), rows))
        .groupBy(*keys, "row", "col", "azimuth_full", "n_cols")
        .agg(F.min_by(hit, F.struct("range", "x", "y", "z")).alias("h"))
        .select(*keys, "row", "col", "azimuth_full", "n_cols", "h.*")
    )


def occlusion_filter(hits: DataFrame, keys=CLOUD, dilation=1, tol=0.3) -> DataFrame:
    """Drop hits lying behind the nearest of their neighbour cells by more than ``tol``."""
    keys = list(keys)
    steps = [(dr, dc) for dr in range(-dilation, dilation + 1) for dc in range(-dilation, dilation + 1)]
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))
    col = F.col("col") + F.col("o.dc")
    wrapped = F.when(F.col("azimuth_full"), F.pmod(col, F.col("n_cols"))).otherwise(col)
    shade = (
        hits.withColumn("o", F.explode(offsets))
        .select(*keys, (F.col("row") + F.col("o.dr")).alias("row"), wrapped.alias("col"), "range")
        .groupBy(*keys, "row", "col")
        .agg(F.min("range").alias("nearest"))
    )
    return (
        hits.join(shade, [*keys, "row", "col"])
        .filter(F.col("range") <= F.col("nearest") + max(0.0, tol))
        .drop("nearest")
    )
