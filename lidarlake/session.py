"""Cutting the lineage of iterative jobs."""

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir = None
_shipped = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session that was not started with --py-files."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    out = pathlib.Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / root.name
    zip_path = shutil.make_archive(str(out), "zip", root.parent, root.name)
    sc.addPyFile(zip_path)
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster for intermediate tables.

    A local master may fall back to a temporary folder; a cluster has to name one in
    ``spark.checkpoint.dir``, because every executor must be able to read it.
    """
    global _local_dir
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dir


def materialize(df: DataFrame, spark: SparkSession = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in ``spark`` if given, else in its own session.

    Survives lost executors, ends the lineage, and gives the planner true sizes, so joins with
    the result are broadcast only when the written table is small.
    """
    spark = spark or df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
