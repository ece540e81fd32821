"""Dense trajectories: corrections from keyframes applied to raw odometry samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.functions.pose import map_odom, pose_compose, pose_inverse, pose_lerp
from lidarlake.functions.scores import clamp
from lidarlake.operators.binding import bind
from lidarlake.operators.sequence import asof_backward, asof_bracket


def dense_trajectory(samples: DataFrame, keyframes: DataFrame, key="map_id", chunk_seconds=3600.0):
    """Corrected pose of every sample.

    ``samples``: key, seq, ts, raw (pose), anchor_id (NULL if none), anchor_raw (pose),
    use_bracket. Bracketed samples blend the corrections of the keyframes around their time;
    anchored ones move with their anchor; the rest stay raw. Output: key, seq, ts, pose.
    """
    # The correction is a property of the keyframe; samples only blend two of them.
    corrected = keyframes.withColumn("corr", map_odom("opt", "odom"))
    near = asof_bracket(
        samples, corrected, [key], payload=["ts", "corr"], chunk_seconds=chunk_seconds
    )
    near = near.withColumns({"_b": F.coalesce("before", "after"), "_a": F.coalesce("after", "before")})
    dt = F.col("_a.ts") - F.col("_b.ts")
    alpha = F.when(dt > 1e-9, clamp(F.try_divide(F.col("ts") - F.col("_b.ts"), dt), 0.0, 1.0)).otherwise(0.0)
    near = bind(near, "_alpha", alpha)
    near = bind(near, "_corr", pose_lerp(F.col("_b.corr"), F.col("_a.corr"), F.col("_alpha")))
    anchors = keyframes.select(key, F.col("kf_id").alias("anchor_id"), F.col("opt").alias("_anchor"))
    fix = F.when(F.col("_anchor").isNotNull(), pose_compose("_anchor", pose_inverse("anchor_raw")))
    joined = bind(near.join(anchors, [key, "anchor_id"], "left"), "_fix", fix)
    bracketed = F.col("use_bracket") & F.col("_b").isNotNull()
    anchored = ~F.col("use_bracket") & F.col("_fix").isNotNull()
    return joined.select(
        key, "seq", "ts",
        F.when(bracketed, pose_compose("_corr", "raw"))
        .when(anchored, pose_compose("_fix", "raw"))
        .otherwise(F.col("raw"))
        .alias("pose"),
    )


def reanchor_trajectory(trajectory: DataFrame, keyframes: DataFrame, key="map_id", chunk_seconds=3600.0):
    """Tie loaded poses to the latest keyframe before them (or the first), for later corrections."""
    tied = asof_backward(
        trajectory, keyframes, [key], payload=["kf_id", "ts", "opt"], chunk_seconds=chunk_seconds
    )
    return tied.select(
        key, "seq", "ts", F.col("pose").alias("raw"), F.col("anchor.kf_id").alias("anchor_id"),
        F.col("anchor.opt").alias("anchor_raw"), F.lit(False).alias("use_bracket"),
    )


def record_trajectory(odom: DataFrame, keyframes: DataFrame, key="map_id", corrections: DataFrame = None,
                      chunk_seconds=3600.0) -> DataFrame:
    """Samples from every odometry row, tied to the latest keyframe at that time.

    ``odom``: key, seq, ts, pose. With ``corrections`` (key, map_odom, NULL while not locked; map
    extension) rows of unlocked maps are dropped and the others carried into the map frame.
    """
    rows, bracket = odom, True
    if corrections is not None:
        rows = (
            odom.join(corrections, [key])
            .filter(F.col("map_odom").isNotNull())
            .withColumn("pose", pose_compose("map_odom", "pose"))
            .drop("map_odom")
        )
        bracket = False
    raw = F.when(F.col("from_loaded"), F.col("opt")).otherwise(F.col("odom"))
    tied = asof_bracket(
        rows, keyframes.withColumn("_raw", raw), [key], payload=["kf_id", "_raw"], tie="last",
        chunk_seconds=chunk_seconds,
    )
    return tied.select(
        key, "seq", "ts", F.col("pose").alias("raw"), F.col("before.kf_id").alias("anchor_id"),
        F.col("before._raw").alias("anchor_raw"), F.lit(bracket).alias("use_bracket"),
    )
