"""Streaming inputs: scans with odometry, and odometry alone."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.schema import POSE_DDL

FRAME_DDL = (
    f"session_id long, frame_id long, ts timestamp, pose {POSE_DDL}, pose_valid boolean, n_points long"
)
ODOM_DDL = f"session_id long, seq long, ts timestamp, pose {POSE_DDL}"


def _stream(spark: SparkSession, ddl: str, source: str, fmt: str, options: dict) -> DataFrame:
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        raw = reader.option("subscribe", source).load()
        return raw.select(F.from_json(F.col("value").cast("string"), ddl).alias("v")).select("v.*")
    return reader.schema(ddl).load(source)


def frame_stream(spark: SparkSession, source: str, fmt="parquet", **options) -> DataFrame:
    """Scans with their odometry pose; ``source`` is a folder or a Kafka topic."""
    return _stream(spark, FRAME_DDL, source, fmt, options)


def dense_odom_stream(spark: SparkSession, source: str, fmt="parquet", **options) -> DataFrame:
    """Every odometry message, independent of scans."""
    return _stream(spark, ODOM_DDL, source, fmt, options)


def valid_frames(frames: DataFrame) -> DataFrame:
    """Frames with a usable pose and a scan that is not empty."""
    return frames.filter(F.col("pose_valid") & (F.col("n_points") > 0))


def sync_nearest_stream(a: DataFrame, b: DataFrame, tol_seconds=0.1, delay="10 seconds") -> DataFrame:
    """Pair two streams by nearest time within a tolerance, per session.

    ``a``: session_id, a_id, ts, ... ``b``: session_id, b_id, b_ts, ... Rows come out once the
    watermark has passed them; ties go to the earlier row.
    """
    left = a.withWatermark("ts", delay)
    right = b.withWatermark("b_ts", delay).withColumnRenamed("session_id", "b_session")
    tol = F.make_dt_interval(secs=F.lit(float(tol_seconds)))
    pairs = left.join(
        right,
        (F.col("session_id") == F.col("b_session"))
        & (F.col("b_ts") >= F.col("ts") - tol)
        & (F.col("b_ts") <= F.col("ts") + tol),
    )
    gap = F.abs(F.unix_micros("b_ts") - F.unix_micros("ts"))
    rest = [c for c in right.columns if c != "b_session"]
    return (
        pairs.groupBy("session_id", "a_id", F.window("ts", "1 second"))
        .agg(F.min_by(F.struct("ts", *rest), F.struct(gap, "b_ts", "b_id")).alias("_r"))
        .select("session_id", "a_id", "_r.*")
    )
