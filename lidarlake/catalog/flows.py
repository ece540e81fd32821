"""Queries over streams, stateful steps, stored maps and reports."""

import uuid

from pyspark.sql import functions as F

from lidarlake.catalog import sqlpose as S
from lidarlake.catalog.points import POINTS_KF, RULES, WORLD, keyframes, points, vox
from lidarlake.catalog.poses import ODOM, _NEAREST, _VIEWS2, _sides
from lidarlake.catalog.registry import query
from lidarlake.catalog.views import info21, odom_frames, r6, view, with_views
from lidarlake.functions.pose import make_pose, pose_compose
from lidarlake.functions.predicates import is_finite_pose
from lidarlake.operators import mapcheck, ranking
from lidarlake.session import materialize, scratch_dir
from lidarlake.sources import maps as M
from lidarlake.sources import reports
from lidarlake.sources.streams import sync_nearest_stream, valid_frames
from lidarlake.streaming import folds, stateful
from lidarlake.streaming.batches import global_map_refresh, read_version, record_odometry, start_batches


def fresh_path(spark):
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


#: Rows of one file of a replayed stream.
ROWS_PER_FILE = 500_000


def replay(spark, df, order="seq", size=60, most=None):
    """A table as a stream whose files hold ascending ranges of ``order``.

    ``df`` is evaluated once. Ranges span ``size``, or more where they would be more than ``most``. A range has as many files as its size asks for, written in parallel; a
    trigger takes as many as the largest range has, so no range comes before an earlier one.
    """
    path, held = fresh_path(spark), fresh_path(spark)
    if most is not None:
        top = df.agg(F.max(order)).first()[0] or 0
        size = max(size, -(-(int(top) + 1) // most))
    parts = df.withColumn("_part", F.floor(F.col(order) / size).cast("long"))
    parts.filter("_part is not null").write.partitionBy("_part").parquet(held)
    sizes = spark.read.parquet(held).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    files = {r._part: -(-r.n // ROWS_PER_FILE) for r in sizes}
    for part, n in files.items():
        one = spark.read.schema(df.schema).parquet(f"{held}/_part={part}")
        (one.coalesce(1) if n == 1 else one.repartition(n)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(files.values(), default=1)).parquet(path)


def drain(stream):
    """Run a stream to its end into a table and read it."""
    spark = stream.sparkSession
    out = fresh_path(spark)
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark))
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_GATE = (
    f"with recursive odom as {with_views('odom').removeprefix('with odom as ')}, r as (select session_id, seq, true as accepted, tx as lx, ty as ly, yaw as lyaw from odom where seq = 0 union all select "
    "session_id, seq, ok, case when ok then tx else lx end, case when ok then ty else ly end, case when ok then yaw else lyaw end from (select f.session_id, f.seq, f.tx, f.ty, f.yaw, r.lx, r.ly, r.lyaw, "
    "sqrt((f.tx-r.lx)**2 + (f.ty-r.ly)**2) >= 1.0 or 2*atan2(abs(sin((f.yaw-r.lyaw)/2)), abs(cos((f.yaw-r.lyaw)/2))) >= 0.5 as ok from r join odom f on f.session_id = r.session_id and f.seq = r.seq + 1)) "
    "select session_id, seq, accepted from r"
)


@query("keyframe_gate", _GATE)
def keyframe_gate(spark, sf):
    return stateful.keyframe_gate(odom_frames(spark, sf), chunk_size=50)


@query("keyframe_gate_stream", _GATE)
def keyframe_gate_stream(spark, sf):
    frames = odom_frames(spark, sf).select("session_id", "seq", "pose")
    return drain(stateful.keyframe_gate(replay(spark, frames)))


@query("valid_frames", f"{ODOM} select event_id from odom where event_id % 5 <> 0 and event_id % 3 <> 0")
def valid_frame_rows(spark, sf):
    o = odom_frames(spark, sf).withColumn("n_points", F.col("event_id") % 3)
    bad = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("tx"))
    o = o.withColumn("pose_valid", is_finite_pose(F.col("pose").withField("tx", bad)))
    return valid_frames(o).select("event_id")


_STEP = "sqrt((b.tx-a.tx)**2 + (b.ty-a.ty)**2) <= 25.0 and 2*atan2(abs(sin((b.yaw-a.yaw)/2)), abs(cos((b.yaw-a.yaw)/2))) <= 2.0"
_STATIC = (
    f"{ODOM}, n as (select a.session_id, a.event_id as frame_id, b.event_id as member_id, a.seq - b.seq as k, {_STEP} as ok from odom a join odom b on a.session_id = b.session_id and b.seq between a.seq - 4 and a.seq), "
    "m as (select *, min(case when not ok then k end) over (partition by frame_id) as brk from n), c as (select frame_id, count(*) as c from m where brk is null or k < brk group by 1) select m.session_id, m.frame_id, "
    "member_id from m join c on m.frame_id = c.frame_id where (c.c >= 3 and (brk is null or k < brk)) or (c.c < 3 and k = 0)"
)
_STILL = {"max_t": 25.0, "max_r": 2.0}


@query("static_members", _STATIC)
def static_members(spark, sf):
    f = odom_frames(spark, sf).withColumn("frame_id", F.col("event_id"))
    return stateful.static_members(f, **_STILL).select("session_id", "frame_id", "member_id")


@query("static_members_stream", _STATIC)
def static_members_stream(spark, sf):
    f = odom_frames(spark, sf).withColumn("frame_id", F.col("seq"))
    names = f.select("session_id", F.col("seq").alias("frame_id"), F.col("event_id").alias("_e"))
    out = drain(stateful.static_members_stream(replay(spark, f.select("session_id", "frame_id", "pose", "seq")), **_STILL))
    return (
        out.join(names, ["session_id", "frame_id"])
        .withColumn("_f", F.col("_e")).drop("_e", "frame_id")
        .join(names.withColumnRenamed("frame_id", "member_id"), ["session_id", "member_id"])
        .select("session_id", F.col("_f").alias("frame_id"), F.col("_e").alias("member_id"))
    )


@query("static_aggregate")
def static_aggregate(spark, sf):
    f = odom_frames(spark, sf).withColumn("frame_id", F.col("event_id"))
    pts = f.select("session_id", "frame_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(
        "session_id", "frame_id", (F.col("i") * 0.31).alias("x"), (F.col("i") * 0.17).alias("y"),
        F.lit(0.05).alias("z"), F.lit(1.0).alias("intensity"),
    )
    out = stateful.static_aggregate(f, pts, **_STILL)
    return out.groupBy("session_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("monotone_stream", f"{ODOM} select session_id, seq from (select session_id, seq, ts, lag(ts) over (partition by session_id order by seq) as p from odom) where p is null or ts > p")
def monotone_stream(spark, sf):
    rows = view(spark, sf, "odom").select("session_id", "seq", "ts")
    return drain(stateful.monotone_stream(replay(spark, rows))).select("session_id", "seq")


@query(
    "lock_counter_stream",
    f"{ODOM} select session_id, seq, row_number() over (partition by session_id order by seq) as lock_count from odom where value > 90",
)
def lock_counter_stream(spark, sf):
    rows = view(spark, sf, "odom").select("session_id", "seq", (F.col("value") > 90).alias("locked"))
    return drain(stateful.lock_count_stream(replay(spark, rows)))


@query("sync_nearest_stream", f"{_VIEWS2} select session_id, event_id as a_id, b_id from ({_NEAREST}) where rn = 1 and gap <= 7200")
def sync_nearest_stream_rows(spark, sf):
    a, b = _sides(spark, sf)
    left = a.select("session_id", F.col("event_id").alias("a_id"), F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("ts"))
    right = b.select("session_id", F.col("kf_id").alias("b_id"), F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("b_ts"))
    return sync_nearest_stream(left, right, 7200.0).select("session_id", "a_id", "b_id")


def scored(spark, sf):
    """Three scored hypotheses per odometry row."""
    e, s = F.col("event_id"), F.col("s")
    zero = F.lit(0.0)
    shift = make_pose(s * 5.0 + 1.0, zero, zero, zero, zero, zero, F.lit(1.0))
    return odom_frames(spark, sf).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "session_id", F.col("seq").alias("frame_id"), F.col("pose").alias("odom"), (s * 10).cast("long").alias("seed"),
        F.when(~((e % 11 == 0) & (s == 2)), s * 10 + e % 3).cast("long").alias("match_id"),
        (F.lit(1.5) - s * 0.4 - (e % 5) * 0.1).alias("ll"), (e % 7 != 0).alias("converged"),
        (e % 4 != 0).alias("valid"), (e % 29 == 0).alias("ambiguous"), pose_compose(shift, "pose").alias("pose"),
        (s * 5.0).alias("x"), zero.alias("y"), zero.alias("z"),
    )


@query("lock_tracker")
def lock_tracker(spark, sf):
    return stateful.fold_batch(scored(spark, sf), folds.lock_step(), folds.LOCK_DDL)


@query("lock_tracker_stream")
def lock_tracker_stream(spark, sf):
    rows = replay(spark, scored(spark, sf).withColumn("seq", F.col("frame_id")))
    return drain(stateful.fold_stream(rows, folds.lock_step(), folds.LOCK_DDL))


_MODE = (
    f"with recursive odom as {with_views('odom').removeprefix('with odom as ')}, r as (select session_id, seq, 'MAP_LOADED' as mode, false as success, false as accepted, cast(null as double) as lx, cast(null as double) as "
    "ly, cast(null as double) as lyaw from (select distinct session_id, cast(-1 as bigint) as seq from odom) union all select session_id, seq, case when mode = 'MAP_LOADED' then case when lock then 'RELOCALIZED' else mode "
    "end when ok then 'EXTENDING' else mode end, mode <> 'MAP_LOADED' or lock, mode <> 'MAP_LOADED' and ok, case when mode = 'MAP_LOADED' then 0e0 when ok then tx else lx end, case when mode = 'MAP_LOADED' then 0e0 when ok "
    "then ty else ly end, case when mode = 'MAP_LOADED' then 0e0 when ok then yaw else lyaw end from (select f.session_id, f.seq, f.tx, f.ty, f.yaw, f.event_id % 4 = 0 as lock, r.mode, r.lx, r.ly, r.lyaw, "
    "coalesce(sqrt((f.tx-r.lx)**2 + (f.ty-r.ly)**2) >= 1.0 or 2*atan2(abs(sin((f.yaw-r.lyaw)/2)), abs(cos((f.yaw-r.lyaw)/2))) >= 0.5, true) as ok from r join odom f on f.session_id = r.session_id and f.seq = r.seq + 1)) "
    "select session_id, seq as frame_id, success, accepted, mode from r where seq >= 0"
)


@query("session_mode", _MODE)
def session_mode(spark, sf):
    zero = F.lit(0.0)
    rows = odom_frames(spark, sf).select(
        "session_id", F.col("seq").alias("frame_id"), (F.col("event_id") % 4 == 0).alias("lock"), "pose",
        make_pose(zero, zero, zero, zero, zero, zero, F.lit(1.0)).alias("gate_pose"),
    )
    return stateful.fold_batch(rows, folds.mode_step(), folds.MODE_DDL, chunk_size=40)


@query("record_odometry", f"{ODOM} select session_id, seq, {S.r6('tx')} as tx from odom")
def record_odometry_rows(spark, sf):
    rows = odom_frames(spark, sf).select("session_id", "seq", "pose")
    path = fresh_path(spark)
    record_odometry(replay(spark, rows), path, fresh_path(spark), once=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).select("session_id", "seq", r6("pose.tx").alias("tx"))


_WORLD2 = f"{POINTS_KF}, {WORLD}, cell as (select map_id, {vox(2.0)} from world)"


@query(
    "global_map_refresh",
    f"{_WORLD2} select map_id, count(*) as cells, sum(n)::bigint as n from (select map_id, vx, vy, vz, count(*) as n from cell group by 1, 2, 3, 4) group by 1",
)
def global_map_refresh_rows(spark, sf):
    path, k = fresh_path(spark), keyframes(spark, sf)
    # Stored once in map order, so that a batch reads the points of its own maps.
    p = materialize(points(spark, sf).repartitionByRange("map_id", "kf_id").sortWithinPartitions("map_id", "kf_id"))
    # A backlog of any length arrives in at most 32 batches: cells do not depend on how keyframes are dealt to batches.
    stream = replay(spark, k.select("map_id", "kf_id"), order="kf_id", most=32)
    run = global_map_refresh(path, lambda: k, lambda: p, leaf=2.0)
    start_batches(stream, run, fresh_path(spark), once=True).awaitTermination()
    voxels = read_version(spark, path, ("voxels",))["voxels"]
    return voxels.groupBy("map_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"))


# --- stored maps and reports ------------------------------------------------------------------


_STORED_RHPD = "transform(sequence(0, 3036), i -> cast((i * 7 + kf_id) % 11 as double) / 8.0)"


def map_tables(spark, sf):
    """A stored map built from the views: only edges that are in order."""
    k = keyframes(spark, sf)
    odo = ranking.odometry_edges(k)
    maps = k.select("map_id").distinct().select(
        "map_id", F.lit("2.3.0").alias("version"),
        F.when(F.col("map_id") % 5 == 1, "dim=1").otherwise(mapcheck.descriptor_schema()).alias("rhpd_schema"),
        F.lit("map").alias("map_frame"), F.lit("body").alias("body_frame"), F.lit(False).alias("filter_applied"),
        F.lit("").alias("filter_policy"), *(F.lit(0).cast("long").alias(c) for c in ("raw_points", "kept_points", "removed_points")),
        F.when(F.col("map_id") % 4 == 2, "mixed_keyframe_fallback_and_high_rate").otherwise("").alias("trajectory_source"),
        (F.col("map_id") % 4 == 2).alias("trajectory_degraded"),
    )
    track = k.filter("map_id % 2 = 0").select("map_id", F.col("kf_id").alias("seq"), "ts", F.col("opt").alias("pose"))
    none = F.lit(None).cast("array<double>")
    desc = k.select("map_id", "kf_id", none.alias("polar"), F.expr(_STORED_RHPD).alias("rhpd"))
    return {"maps": maps, "keyframes": k, "points": points(spark, sf), "descriptors": desc, "edges": odo, "trajectory": track}


_KF_COUNT = f"{with_views('keyframes', 'points')}"


@query(
    "read_map",
    f"{_KF_COUNT} select k.map_id, n_kf, n_pts, n_kf - 1 as n_edges, case when k.map_id % 2 = 0 then n_kf else 0 end as n_track, "
    "case when k.map_id % 4 = 2 then 'mixed_keyframe_fallback_and_high_rate' when k.map_id % 2 = 0 then 'native' else 'none' end as trajectory_source, "
    "k.map_id % 5 = 1 as rebuilt, case when k.map_id % 5 = 1 then 3037.0 * n_kf else stored end as rhpd_sum, x_sum from (select map_id, "
    "count(*) as n_kf, sum(list_sum(list_transform(range(3037), lambda i: ((i * 7 + kf_id) % 11)::double / 8.0))) as stored from keyframes group by 1) k "
    "join (select map_id, count(*) as n_pts, round(sum(x), 3) as x_sum from points group by 1) p on k.map_id = p.map_id",
)
def read_map(spark, sf):
    """Two saves into one store, then all maps read back with their values."""
    path, whole = fresh_path(spark), map_tables(spark, sf)
    for half in (0, 1):
        M.write_map({n: df.filter(F.col("map_id") % 2 == half) for n, df in whole.items()}, path)

    def ones(keyframes, _):
        return keyframes.select("map_id", "kf_id", F.expr("array_repeat(1.0D, 3037)").alias("rhpd"))

    t = M.read_map(spark, path, "STRICT", rebuild=ones)

    def n(name, alias):
        return t[name].groupBy("map_id").agg(F.count(F.lit(1)).alias(alias))

    out = n("keyframes", "n_kf")
    for name, alias in (("edges", "n_edges"), ("trajectory", "n_track")):
        out = out.join(n(name, alias), ["map_id"], "left")
    clouds = t["points"].groupBy("map_id").agg(F.count(F.lit(1)).alias("n_pts"), F.round(F.sum("x"), 3).alias("x_sum"))
    total = F.aggregate("rhpd", F.lit(0.0), lambda a, v: a + v)
    desc = t["descriptors"].groupBy("map_id").agg(F.bool_and("rebuilt").alias("rebuilt"), F.sum(total).alias("rhpd_sum"))
    out = out.join(clouds, ["map_id"]).join(desc, ["map_id"])
    return out.join(t["maps"].select("map_id", "trajectory_source"), ["map_id"]).fillna(0)


@query(
    "read_map_salvage",
    f"{_KF_COUNT} select map_id, count(*) as n_kf from keyframes where kf_id % 7 <> 3 group by 1",
)
def read_map_salvage(spark, sf):
    path, t = fresh_path(spark), map_tables(spark, sf)
    nan = F.when(F.col("kf_id") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("ts"))
    t["keyframes"] = t["keyframes"].withColumn("ts", nan)
    M.write_map(t, path, check=False)
    return M.read_map(spark, path, "SALVAGE")["keyframes"].groupBy("map_id").agg(F.count(F.lit(1)).alias("n_kf"))


@query(
    "save_problems",
    f"{with_views('keyframes', 'edges')}, k as (select distinct map_id from keyframes), b as (select e.map_id, case when info_kind = 5 then 'edge: malformed edge' when a.kf_id is null or c.kf_id is null then 'edge: missing endpoint' end as "
    "problem from edges e left join keyframes a on e.map_id = a.map_id and e.from_id = a.kf_id left join keyframes c on e.map_id = c.map_id and e.to_id = c.kf_id) select distinct map_id, problem from b where problem is not null",
)
def save_problems(spark, sf):
    t = map_tables(spark, sf)
    t["edges"] = view(spark, sf, "edges").withColumn("info", info21()).drop("info_kind")
    return M.save_problems(t)


@query(
    "read_nav_resource",
    f"{_KF_COUNT} select map_id, case when map_id % 4 = 2 then 'mixed_keyframe_fallback_and_high_rate' when map_id % 2 = 0 then 'native' "
    "else 'keyframe_fallback' end as source, map_id % 4 <> 0 as degraded, map_id % 4 = 0 as has_native_dense, "
    "map_id % 4 <> 0 as from_keyframe_fallback, count(*) as n_track from keyframes group by map_id",
)
def read_nav_resource(spark, sf):
    path = fresh_path(spark)
    M.write_map(map_tables(spark, sf), path)
    t = M.read_nav_resource(spark, path, allow_fallback=True)
    n = t["trajectory"].groupBy("map_id").agg(F.count(F.lit(1)).alias("n_track"))
    return t["flags"].join(n, ["map_id"])


@query("write_global_map", f"{_WORLD2} select map_id, count(*) as cells from (select map_id, vx, vy, vz from cell group by 1, 2, 3, 4) group by 1")
def write_global_map(spark, sf):
    path = fresh_path(spark)
    M.write_global_map(points(spark, sf), keyframes(spark, sf), path, voxel=2.0)
    back = spark.read.schema("x double, y double, z double, intensity double, map_id long").parquet(path)
    return back.groupBy("map_id").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "eval_csv",
    f"{with_views('results')} select query_id, locked and translation_error_m <= 1.0 and yaw_error_deg <= 10.0 and roll_pitch_error_deg <= 5.0 as pose_accurate, match_id = query_id as self_match from results",
)
def eval_csv(spark, sf):
    path = fresh_path(spark)
    res = view(spark, sf, "results")
    reports.write_eval_csv(res, path)
    schema = reports.eval_rows(res).schema
    return spark.read.schema(schema).csv(path, header=True).select("query_id", "pose_accurate", "self_match")


@query("eval_files", f"{with_views('results')} select count(*) as tested, count(distinct (dropout, noise_sigma, fake_yaw_deg, query_source)) as matrix_rows from results")
def eval_files(spark, sf):
    a, b = fresh_path(spark), fresh_path(spark)
    res = view(spark, sf, "results")
    reports.write_eval_summary(res, a)
    reports.write_matrix(res, b)
    rows = spark.read.csv(b, header=True).agg(F.count(F.lit(1)).alias("matrix_rows"))
    return spark.read.json(a).select("tested").join(rows)


@query(
    "filter_report",
    "select map_id, count(*) as keyframes, sum(n)::bigint as original_points, count(*) as entries from (select map_id, kf_id, count(*) as n from ("
    + with_views("points").removeprefix("with points as ") + ") group by 1, 2) group by 1",
)
def filter_report(spark, sf):
    path = fresh_path(spark)
    counts = mapcheck.filter_counts(mapcheck.classify_point(points(spark, sf), RULES))
    reports.write_filter_report(counts, path)
    back = spark.read.schema(reports.filter_report(counts).schema).json(path)
    return back.select("map_id", "keyframes", "original_points", F.size("per_keyframe").cast("long").alias("entries"))


@query(
    "optimization_log",
    f"{_KF_COUNT} select map_id, context, count(*) as keyframes, max(kf_id) as latest_id from keyframes, (select unnest(['mapping', 'loop']) as context) group by 1, 2",
)
def optimization_log(spark, sf):
    path, k = fresh_path(spark), keyframes(spark, sf)
    for context in ("mapping", "loop"):
        reports.append_optimization_log(k, path, context)
    schema = reports.optimization_rows(k, "loop").schema
    return spark.read.schema(schema).parquet(path).select("map_id", "context", "keyframes", "latest_id")
