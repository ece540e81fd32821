"""Report files: evaluation rows and summaries, filter reports, the optimization log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.functions.predicates import pose_accurate
from lidarlake.operators.evaluate import eval_matrix, eval_summary

EVAL_COLUMNS = (
    "query_id", "success", "locked", "translation_error_m", "yaw_error_deg", "roll_pitch_error_deg",
    "pose_accurate", "input_odom_translation_error_m", "input_odom_yaw_error_deg", "match_id", "self_match",
    "num_query_points", "dropout", "noise_sigma", "elapsed_ms",
)


def eval_rows(results: DataFrame, **limits) -> DataFrame:
    """Rows of the per-query report; columns the results lack are left out."""
    full = results.withColumn("pose_accurate", pose_accurate(**limits)).withColumn(
        "self_match", F.col("match_id") == F.col("query_id")
    )
    return full.select(*(c for c in EVAL_COLUMNS if c in full.columns))


def write_eval_csv(results: DataFrame, path: str, **limits) -> None:
    eval_rows(results, **limits).write.mode("overwrite").csv(path, header=True)


def write_eval_summary(results: DataFrame, path: str, **limits) -> None:
    """One JSON row with counts, rates, percentiles and the failing ids."""
    eval_summary(results, **limits).write.mode("overwrite").json(path)


def write_matrix(results: DataFrame, path: str, **limits) -> None:
    """One CSV row per cell of a sweep."""
    eval_matrix(results, **limits).write.mode("overwrite").csv(path, header=True)


def filter_report(counts: DataFrame) -> DataFrame:
    """Nested report per map: totals by reason and the list of its keyframes.

    The list grows with the keyframes of a map, one short entry each.
    """
    sums = ("original_points", "kept_points", "removed_points", "removed_non_finite", "removed_range",
            "removed_self", "removed_rear")
    entry = F.struct(
        F.col("kf_id").alias("id"), "original_points", "kept_points", "removed_points", "removed_ratio"
    )
    totals = counts.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("keyframes"),
        *(F.sum(c).alias(c) for c in sums),
        F.array_sort(F.collect_list(F.when(F.col("kept_points") == 0, F.col("kf_id")))).alias("empty_result_keyframes"),
        F.array_sort(F.collect_list(entry)).alias("per_keyframe"),
    )
    ratio = F.when(F.col("original_points") > 0, F.col("removed_points") / F.col("original_points")).otherwise(0.0)
    return totals.withColumn("removed_ratio", ratio)


def write_filter_report(counts: DataFrame, path: str) -> None:
    filter_report(counts).write.mode("overwrite").json(path)


def optimization_rows(keyframes: DataFrame, context: str, report: DataFrame = None) -> DataFrame:
    """Log rows per map: keyframe count, latest id, and the loop report if there was a loop round."""
    base = keyframes.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("keyframes"), F.max("kf_id").alias("latest_id"), F.max("ts").alias("ts")
    )
    names = ["loop_edges", "residual_t_before", "residual_r_before", "residual_t_after", "residual_r_after",
             "update_mean_t", "update_max_t", "update_mean_r", "update_max_r"]
    out = base.withColumn("context", F.lit(context))
    if report is None:
        return out.select("*", *(F.lit(None).cast("double").alias(n) for n in names))
    part = report.select("map_id", *(F.col(n).cast("double").alias(n) for n in names))
    return out.join(part, ["map_id"], "left")


def append_optimization_log(keyframes: DataFrame, path: str, context: str, report=None) -> None:
    optimization_rows(keyframes, context, report).write.mode("append").parquet(path)
