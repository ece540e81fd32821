"""What a job moves grows with its input: no copies of rows per cell, pair or sector on the way."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lidarlake.catalog import flows, matching, places
from lidarlake.functions import vectors
from lidarlake.functions.pose import identity_pose, make_pose, translation_distance
from lidarlake.operators import descriptors, mapcheck, neighbors, register, retrieval
from lidarlake.sources import maps
from lidarlake.streaming import batches, stateful


def cloud(spark, points, name, key=0):
    return spark.createDataFrame(pd.DataFrame({"pair_id": key, name: range(len(points)), **dict(zip("xyz", points.T))}))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_points_of_small_clouds_meet_in_a_task(spark, monkeypatch):
    """No point is copied into 27 cells; clouds too large for a task give the same partners over cells."""
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-5, 5, (200, 3)), rng.uniform(-5, 5, (150, 3))
    b = np.concatenate([b, b[:40]])
    src = cloud(spark, a, "src_id").union(cloud(spark, a[:20], "src_id", 1)).union(cloud(spark, a[:3] * np.nan, "src_id", 2))
    tgt = cloud(spark, b, "tgt_id").union(cloud(spark, b[:20], "tgt_id", 1)).union(cloud(spark, b[:3], "tgt_id", 2))
    near = register.correspondences(src, tgt, 1.5)
    assert "Generate" not in plan(near)
    monkeypatch.setattr(neighbors, "POINTS_IN_TASK", 100)
    both = register.correspondences(src, tgt, 1.5)
    got, want = ({(r.pair_id, r.src_id, r.hit.tgt_id, round(r.hit.d2, 9)) for r in d.collect()} for d in (near, both))
    assert got == want and {k for k, *_ in got} == {0, 1}


def test_covariances_of_small_clouds_meet_in_a_task(spark, monkeypatch):
    """One exchange of the points and none of their neighbours; too large clouds give the same over blocks."""
    rng = np.random.default_rng(3)
    points = cloud(spark, rng.uniform(-5, 5, (120, 3)), "tgt_id").union(cloud(spark, rng.uniform(-5, 5, (30, 3)), "tgt_id", 1))
    near = register.normals_covariances(points, k=6)
    assert plan(near).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(neighbors, "POINTS_IN_TASK", 50)
    both = register.normals_covariances(points, k=6)
    assert near.columns == both.columns
    got, want = ({(r.pair_id, r.tgt_id): r.cov for r in d.collect()} for d in (near, both))
    assert len(got) == 150 and got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_dense_vectors_are_made_without_python(spark):
    """No worker holds a batch of wide arrays; any order of the indices, both ends and no entries."""
    rows = [(0, [5, 0, 9], [2.0, 1.0, 3.0]), (1, [], []), (2, [3], [4.0])]
    df = spark.createDataFrame(rows, "id long, i array<int>, v array<double>").repartition(2)
    out = df.select("id", vectors.dense_vector(10)("i", "v").alias("d"))
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    got = {r.id: r.d for r in out.collect()}
    for k, idx, val in rows:
        want = np.zeros(10)
        want[idx] = val
        assert got[k] == want.tolist()


def test_near_pairs_share_their_vectors(spark):
    """No pair carries its vectors to a worker: each travels once per block of clouds."""
    rng = np.random.default_rng(1)
    rows = [(0, k, rng.uniform(0, 1, 1200).tolist()) for k in (1, 2, 4, 9)]
    d = spark.createDataFrame(rows, "map_id long, kf_id long, polar array<double>")
    out = places._near_distances(d, "polar", retrieval._classic_kernel, [("distance", "double"), ("shift", "int")])
    assert "ArrowEvalPython" not in plan(out)
    vec = {k: np.array(v) for _, k, v in rows}
    got = {(r.a_id, r.b_id): (r.distance, r["shift"]) for r in out.collect()}
    want = {(a, b): vectors.polar_distance_one(vec[a], vec[b], 1, (1.0,), 0.0, order="sorted") for a, b in [(1, 2), (1, 4), (2, 4)]}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_points_are_dealt_by_cloud_before_they_are_binned(spark, monkeypatch):
    """One exchange of the points and none of their cells; clouds too large for a task give the same cells."""
    rng = np.random.default_rng(4)
    xyz = rng.uniform(-5, 5, (90, 3))
    rows = [(0, int(k > 60), *map(float, p)) for k, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, "map_id long, kf_id long, x double, y double, z double")
    pca = descriptors.materialize(descriptors.pca_2d(points))
    parts = ("plane", "ring", "sector")
    near = descriptors._cells_by_cloud(points, pca, parts)
    assert plan(near).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(descriptors, "POINTS_IN_TASK", 40)
    both = descriptors._cells_by_cloud(points, pca, parts)
    key = [*descriptors.CLOUD, "part", "c0", "c1", "c2"]
    got, want, plain = ({tuple(r[c] for c in key): r.s1 for r in d.collect()} for d in (near, both, descriptors.cloud_cells(points, pca, parts)))
    assert got.keys() == want.keys() == plain.keys()
    assert all(np.isclose(got[k], want[k]) and np.isclose(got[k], plain[k]) for k in got)


def test_wide_descriptors_are_not_broadcast(spark):
    """Encoded files and guessed array sizes look small; neither stored nor fresh descriptors go through the driver."""
    keys = spark.range(6).selectExpr("0L map_id", "id kf_id")
    wide = keys.withColumn("rhpd", F.array_repeat(F.lit(1.0), 3037))
    out = mapcheck.descriptor_restore(keys, wide, wide, keys.selectExpr("map_id", "true rebuild_descriptors").distinct())
    joins = [line for line in plan(out).splitlines() if "Join" in line and "kf_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert {(r.kf_id, r.rebuilt, len(r.rhpd)) for r in out.collect()} == {(k, True, 3037) for k in range(6)}


def test_exported_maps_have_no_file_per_task(spark, tmp_path):
    """Cells are dealt by tile: a map within one tile is one file, and all its cells are there."""
    points = spark.createDataFrame(
        [(0, 0, k, float(k % 40) + 1, float(k // 40) + 1, 0.0, 0.0) for k in range(800)],
        "map_id long, kf_id long, pt_id long, x double, y double, z double, intensity double",
    )
    keyframes = points.select("map_id", "kf_id", identity_pose().alias("opt")).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        maps.write_global_map(points, keyframes, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 800


def test_replayed_ranges_are_written_in_parallel_and_stay_in_order(spark, monkeypatch):
    """Large ranges are several files of one trigger; a stream over them sees every session in order."""
    monkeypatch.setattr(flows, "ROWS_PER_FILE", 20)
    rows = spark.range(150).selectExpr("id % 3 session_id", "id div 3 seq", "double(case when id % 7 = 0 then 0 else id end) ts")
    paths, fresh = [], flows.fresh_path
    monkeypatch.setattr(flows, "fresh_path", lambda spark: paths.append(fresh(spark)) or paths[-1])
    stream = flows.replay(spark, rows, size=20)
    got = flows.drain(stateful.monotone_stream(stream)).select("session_id", "seq").collect()
    files = spark.read.parquet(paths[0]).select(F.input_file_name()).distinct().count()
    last, want = {}, set()
    for r in sorted(rows.collect(), key=lambda r: r.seq):
        if r.ts > last.get(r.session_id, -1.0):
            want.add((r.session_id, r.seq))
            last[r.session_id] = r.ts
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert files == 8


def test_the_drift_is_the_same_however_far_a_map_lies(spark, monkeypatch):
    """The second visits of verify_loops drift by decimetres at 5 km from the origin as well."""
    sf = "/root/testdata/sf0.001"
    near = matching.keyframes(spark, sf)
    far = near.withColumn("opt", F.col("opt").withField("tx", F.col("opt.tx") + 5000.0))
    monkeypatch.setattr(matching, "keyframes", lambda *_: far)
    k, _, truth = matching.second_visits(spark, sf)
    both = k.join(truth.select("map_id", "kf_id", F.col("opt").alias("was")), ["map_id", "kf_id"])
    assert both.agg(F.max(translation_distance("opt", "was"))).first()[0] < 0.5


def test_blocks_grow_with_the_map(spark, monkeypatch):
    """A vector travels to at most BLOCKS blocks; before, a block of 128 rows sent it to one block per 128 rows."""
    from lidarlake.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCKS", 4)
    seen, real = [], retrieval.block_top_k
    monkeypatch.setattr(retrieval, "block_top_k", lambda q, b, keys, k: seen.append(q) or real(q, b, keys, k))
    v = spark.range(600).selectExpr("0L map_id", "id pos", "array(sin(id * 1.7D), cos(id * 0.3D)) vec")
    asked = retrieval.loop_search_range(v, 50).withColumnRenamed("pos", "query_id")
    got = {(r.query_id, r.match_pos) for r in retrieval.top_by_key(asked, v, 3, "vec", block=16).collect()}
    assert max(len(r.b_blocks) for r in seen[0].select("b_blocks").collect()) == 4
    rows = [r.vec for r in v.orderBy("pos").collect()]
    for q in range(51, 600, 37):
        near = sorted((sum((x - y) ** 2 for x, y in zip(rows[q], rows[p])), p) for p in range(q - 50))[:3]
        assert {p for i, p in got if i == q} == {p for _, p in near}


def test_tasks_that_bin_clouds_grow_in_number(spark, monkeypatch):
    """The planes of a table are binned in tasks of bounded clouds, not in a number of tasks that is fixed."""
    points = spark.range(400).selectExpr("0L map_id", "id % 40 kf_id", "id % 7 - 3.0D x", "id % 5 - 2.0D y", "id % 3 * 1.0D z")
    pca = descriptors.materialize(descriptors.pca_2d(points))
    few = descriptors._cells_by_cloud(points, pca, ("plane",))
    monkeypatch.setattr(descriptors, "POINTS_PER_TASK", 20)
    many = descriptors._cells_by_cloud(points, pca, ("plane",))
    assert few.rdd.getNumPartitions() <= 8 and "REPARTITION_BY_NUM" in plan(many) and "(map_id#" in plan(many)
    assert ", 20), REPARTITION_BY_NUM" in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_members_of_a_frame_come_from_the_rows_before_it(spark):
    """Frames are dealt by session once, not copied per earlier frame and joined; a gap in seq is no member."""
    seqs = [0, 1, 2, 4, 5, 6, 7]
    rows = [(s, 100 + q, q, float(q // 5)) for s in (1, 2) for q in seqs]
    frames = spark.createDataFrame(rows, "session_id long, frame_id long, seq long, x double")
    zero = F.lit(0.0)
    frames = frames.select("session_id", "frame_id", "seq", make_pose(F.col("x"), zero, zero, zero, zero, zero, F.lit(1.0)).alias("pose"))
    out = stateful.static_members(frames, max_frames=3, min_frames=2)
    assert "Join" not in plan(out) and plan(out).count("Exchange hashpartitioning") == 1
    want = {0: [0], 1: [1, 0], 2: [2, 1, 0], 4: [4, 2], 5: [5], 6: [6, 5], 7: [7, 6, 5]}
    got = sorted((r.session_id, r.frame_id, r.member_id) for r in out.collect())
    assert got == sorted((s, 100 + q, 100 + m) for s in (1, 2) for q in seqs for m in want[q])


def test_a_refresh_batch_writes_the_maps_it_touches(spark, tmp_path):
    """Cells of other maps stay where they are and are still read; rebuilt and repeated batches agree with a whole build."""
    path = str(tmp_path / "refresh")
    ks = [(m, 10 * m + i) for m in range(3) for i in range(2)]
    zero = F.lit(0.0)
    keys = spark.createDataFrame(ks, "map_id long, kf_id long")
    frames = keys.withColumn("opt", make_pose(F.col("kf_id") * 0.5, zero, zero, zero, zero, zero, F.lit(1.0)))
    points = keys.select("map_id", "kf_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).selectExpr(
        "map_id", "kf_id", "i * 0.4D x", "0.1D y", "0.2D z", "1.0D intensity"
    )

    def batch(n, names, redo=None):
        run = batches.global_map_refresh(path, lambda: frames, lambda: points, 1.0, None if redo is None else lambda: redo)
        run(spark.createDataFrame(names, "map_id long, kf_id long"), n)

    def cells():
        now = batches.read_version(spark, path, ("voxels", "seen", "revisions"))
        rows = {(r.map_id, r.vx, r.vy, r.vz): (round(r.sx, 9), r.n) for r in now["voxels"].collect()}
        return rows, sorted(map(tuple, now["seen"].collect())), dict(map(tuple, now["revisions"].collect()))

    batch(0, ks[:3])
    batch(1, ks[3:5])
    batch(2, [ks[5]])
    written = spark.read.parquet(f"{path}/voxels/version=2")
    assert {r.map_id for r in written.select("map_id").distinct().collect()} == {2}
    want = batches.transform_points(points, frames).groupBy("map_id", F.floor("x").alias("vx"), F.floor("y").alias("vy"), F.floor("z").alias("vz")).agg(F.sum("x").alias("sx"), F.count("*").alias("n"))
    whole = {(r.map_id, r.vx, r.vy, r.vz): (round(r.sx, 9), r.n) for r in want.collect()}
    assert cells() == (whole, ks, {0: 1, 1: 2, 2: 2})
    batch(2, [ks[5]])
    assert cells() == (whole, ks, {0: 1, 1: 2, 2: 2})
    batch(3, [ks[0]], keys.filter("map_id = 1").select("map_id"))
    assert cells() == (whole, ks, {0: 1, 1: 3, 2: 2})
