"""Micro-batch jobs: loop rounds, map refresh, trajectory recording, cross-map loops.

Every job writes versions named after the batch id and starts from the newest older version, so a
batch that runs again after a failure gives the same result.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.operators.clouds import next_revision, transform_points, voxel_merge
from lidarlake.operators.mapcheck import refresh_poses
from lidarlake.operators.ranking import loop_pair_history
from lidarlake.operators.retrieval import detect_loops
from lidarlake.plans.loops import (
    accepted_loops,
    close_loops,
    cross_map_only,
    loop_edges,
    thin_queries,
    verify_cross_loops,
)
from lidarlake.session import materialize
from lidarlake.sources.reports import optimization_rows


def _versions(spark: SparkSession, path: str):
    """Ids of the complete versions below ``path``."""
    try:
        done = spark.read.parquet(f"{path}/_versions")
    except AnalysisException:
        return []
    return sorted(r.version for r in done.select("version").distinct().collect())


#: Tables of which a version of the map refresh only holds the maps it touched.
_BY_MAP = ("voxels", "seen")


def read_version(spark: SparkSession, path: str, names, before=None, maps=None) -> dict:
    """Tables of the newest version (older than ``before``), or an empty dict; ``maps`` (map_id) reads only those."""
    ids = [v for v in _versions(spark, path) if before is None or v < before]
    if not ids:
        return {}
    return {n: _whole(spark, path, n, ids[-1], maps) for n in names}


def _held(spark, path, version):
    """Which version holds the rows of each map (map_id, version), or None if every version is whole."""
    try:
        return spark.read.parquet(f"{path}/held/version={version}")
    except AnalysisException:
        return None


def _whole(spark, path, name, version, maps):
    held = _held(spark, path, version) if name in _BY_MAP else None
    now = spark.read.parquet(f"{path}/{name}/version={version}")
    if held is None:
        return now if maps is None else now.join(maps, ["map_id"], "left_semi")
    if maps is not None:
        held = held.join(maps, ["map_id"], "left_semi")
    at = [r.version for r in held.select("version").distinct().collect()]
    if not at:
        return now.limit(0)
    folders = [f"{path}/{name}/version={v}" for v in at]
    parts = spark.read.schema(now.schema.add("version", "long")).option("basePath", f"{path}/{name}").parquet(*folders)
    return parts.join(held, ["map_id", "version"], "left_semi").drop("version")


def write_version(spark: SparkSession, path: str, version: int, tables: dict) -> None:
    """Write all tables, then the version id, which makes the version visible."""
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{n}/version={version}")
    spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{path}/_versions")


def global_map_refresh(path: str, keyframes_of, points_of, leaf=0.1, rebuild_of=None):
    """Batch function that adds new keyframes to the stored voxel sums.

    ``keyframes_of()`` / ``points_of()`` read the current tables; the batch rows carry map_id and
    kf_id. Maps listed by ``rebuild_of()`` (poses moved) are built again from all their keyframes.
    The revision of a map grows only when its cells changed. A batch reads and writes the cells of the
    maps it touches; the table ``held`` of a version tells where those of the other maps lie.
    """

    def run(batch: DataFrame, batch_id: int):
        keyframes, points = keyframes_of(), points_of()
        # The session of a stream plans without adaptive execution: every shuffle and file count would be the widest.
        spark = points.sparkSession
        ids = materialize(batch.select("map_id", "kf_id"), spark).distinct()
        redo = None
        if rebuild_of is not None:
            redo = rebuild_of().select("map_id").distinct()
            stale = read_version(spark, path, ("seen",), batch_id, redo)
            if stale:
                ids = ids.unionByName(stale["seen"].select("map_id", "kf_id")).distinct()
        touched = ids.select("map_id").distinct()
        old = read_version(spark, path, ("voxels", "seen"), batch_id, touched)
        if old:
            state, seen = old["voxels"], old["seen"]
            revisions, held = _index(spark, path, batch_id)
        else:
            empty = points.filter("false")
            state = empty.selectExpr(
                "map_id", "0L vx", "0L vy", "0L vz", "x sx", "y sy", "z sz", "intensity si", "0L n"
            )
            seen = empty.select("map_id", "kf_id")
            revisions, held = empty.selectExpr("map_id", "0L revision"), empty.selectExpr("map_id", "0L version")
        if redo is not None:
            state = state.join(redo, ["map_id"], "left_anti")
            seen = seen.join(redo, ["map_id"], "left_anti")
        # Tables laid out by map are read only where the batch lies.
        lo, hi = ids.agg(F.min("map_id"), F.max("map_id")).first()
        near = F.lit(False) if lo is None else F.col("map_id").between(lo, hi)
        fresh = points.filter(near).join(ids, ["map_id", "kf_id"], "left_semi")
        world = transform_points(fresh, keyframes.filter(near))
        merged, seen_now, changed = voxel_merge(state, seen, world, leaf)
        now = touched.withColumn("version", F.lit(batch_id).cast("long"))
        write_version(
            spark, path, batch_id,
            {
                "voxels": merged, "seen": seen_now, "revisions": next_revision(revisions, changed),
                "held": held.join(touched, ["map_id"], "left_anti").unionByName(now).coalesce(1),
            },
        )

    return run


def _index(spark, path, before):
    """Revisions of the newest version older than ``before``, and which version holds each map."""
    last = [v for v in _versions(spark, path) if v < before][-1]
    revisions = spark.read.parquet(f"{path}/revisions/version={last}")
    held = _held(spark, path, last)
    if held is None:
        whole = spark.read.parquet(f"{path}/seen/version={last}")
        held = whole.select("map_id").distinct().withColumn("version", F.lit(last).cast("long"))
    return revisions, held


def changed_maps(spark: SparkSession, path: str, published: DataFrame) -> DataFrame:
    """Maps whose revision differs from the one published last (map_id, revision)."""
    now = read_version(spark, path, ("revisions",)).get("revisions")
    return now.join(published.withColumnRenamed("revision", "_old"), ["map_id"], "left").filter(
        F.col("_old").isNull() | (F.col("revision") != F.col("_old"))
    ).select("map_id", "revision")


def loop_microbatch(path: str, frames_of, keyframes_of, edges_of, points_of, gap=5, detect=None, options=None):
    """Batch function: candidates of the new keyframes, one loop round, new poses, edges and log.

    ``frames_of()`` gives the descriptors with positions; tables of earlier versions supply poses,
    edges and the last query id kept per map once there are any, so that ``gap`` holds across batches.
    """

    def run(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        new = batch.select("map_id", "kf_id").distinct()
        frames = frames_of()
        queries = frames.join(new, ["map_id", "kf_id"], "left_semi")
        candidates = materialize(detect_loops(frames, queries, **(detect or {})))
        old = read_version(spark, path, ("poses", "loops", "gaps"), batch_id)
        candidates, gaps = after_gap(candidates, old.get("gaps"), gap)
        keyframes, edges = keyframes_of(), edges_of()
        history = None
        if old:
            keyframes = refresh_poses(keyframes, old["poses"])
            history = old["loops"]
            edges = edges.unionByName(loop_edges(history).select(*edges.columns))
        loops, _, poses, report = close_loops(
            candidates, keyframes, edges, points_of(), gap, **(options or {})
        )
        keep = loops.select("map_id", "query_id", "match_id", "fitness", "inlier_ratio", "T_match_query", "info")
        every = keep if history is None else history.unionByName(keep)
        write_version(
            spark, path, batch_id,
            {
                "poses": poses, "loops": every, "pairs": loop_pair_history(every), "gaps": gaps,
                "log": optimization_rows(keyframes, "loop", report),
            },
        )

    return run


def after_gap(candidates: DataFrame, gaps: DataFrame | None, gap: int):
    """Candidates at least ``gap`` after the last query of an earlier batch, and the new last ids.

    ``gaps``: map_id, last_id. What is left is thinned as if all batches had been one.
    """
    if gaps is not None:
        far = F.col("last_id").isNull() | (F.col("query_id") - F.col("last_id") >= gap)
        candidates = candidates.join(gaps, ["map_id"], "left").filter(far).drop("last_id")
    kept = thin_queries(candidates, gap).groupBy("map_id").agg(F.max("query_id").alias("last_id"))
    if gaps is not None:
        kept = kept.unionByName(gaps).groupBy("map_id").agg(F.max("last_id").alias("last_id"))
    return candidates, materialize(kept)


def cross_loop_microbatch(path: str, frames_of, keyframes_of, points_of, detect=None, min_inlier=0.5,
                          max_fitness=0.3, options=None):
    """Batch function for sessions that extend a loaded map: loops from new keyframes into it.

    All verified loops within the limits become edges, not only the best per query.
    """

    def run(batch: DataFrame, batch_id: int):
        new = batch.select("map_id", "kf_id").distinct()
        frames, keyframes = frames_of(), keyframes_of()
        edges = cross_loops(
            new, frames, keyframes, points_of(), detect, min_inlier, max_fitness, options
        )
        write_version(batch.sparkSession, path, batch_id, {"edges": edges})

    return run


def cross_loops(new, frames, keyframes, points, detect=None, min_inlier=0.5, max_fitness=0.3, options=None):
    """Edges from the loaded part of each map to the new keyframes."""
    queries = frames.join(new, ["map_id", "kf_id"], "left_semi")
    bounds = keyframes.filter("from_loaded").groupBy("map_id").agg(F.max("kf_id").alias("max_id"))
    candidates = materialize(cross_map_only(detect_loops(frames, queries, **(detect or {})), bounds))
    matches = verify_cross_loops(candidates, keyframes, points, **(options or {}))
    return loop_edges(accepted_loops(matches, min_inlier, max_fitness, best=False))


def start_batches(stream: DataFrame, run, checkpoint: str, every="100 milliseconds", once=False):
    """Start a micro-batch job on a stream of new keyframes."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def record_odometry(stream: DataFrame, path: str, checkpoint: str, once=False):
    """Append every odometry row to a table; corrections are applied when it is read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()
