"""Known small cases: expected values follow from the geometry of each input."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lidarlake.functions import vectors as V
from lidarlake.functions.pose import make_pose, yaw_pose
from lidarlake.functions.scores import diagonal_information, trajectory_source_state
from lidarlake.operators import clouds, evaluate, mapcheck, neighbors, posegraph, ranking, retrieval, sequence
from lidarlake.operators import descriptors as D
from lidarlake.operators.trajectory import dense_trajectory
from lidarlake.plans import loops
from lidarlake.plans.navfilter import nav_filter, require_no_empty_keyframes
from lidarlake.schema import POSE_DDL
from lidarlake.streaming import folds, stateful

ID = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def at(x=0.0, y=0.0, z=0.0, yaw=0.0):
    return (float(x), float(y), float(z), 0.0, 0.0, math.sin(yaw / 2), math.cos(yaw / 2))


def cloud(spark, rows):
    data = [(0, kf, i, *map(float, p)) for i, (kf, *p) in enumerate(rows)]
    return spark.createDataFrame(data, "map_id long, kf_id long, pt_id long, x double, y double, z double, intensity double")


def frames(spark, rows):
    ddl = f"map_id long, kf_id long, ts double, odom {POSE_DDL}, opt {POSE_DDL}, from_loaded boolean"
    return spark.createDataFrame(rows, ddl)


def test_voxel_mean(spark):
    pts = cloud(spark, [(0, 0.1, 0.1, 0.1, 1), (0, 0.2, 0.2, 0.2, 3)])
    row = clouds.voxel_centroid(pts, 1.0).collect()
    assert len(row) == 1 and row[0].x == pytest.approx(0.15, abs=1e-5) and row[0].intensity == 2


def test_transform_and_incremental_map(spark):
    pts = cloud(spark, [(0, 0, 0, 0, 1)])
    kf = frames(spark, [(0, 0, 0.0, ID, at(1, 2, 3), False)])
    moved = clouds.transform_points(pts, kf).first()
    assert (moved.x, moved.y, moved.z) == (1, 2, 3)
    world = clouds.transform_points(pts, kf)
    state = clouds.voxel_sums(world, 1.0)
    seen = pts.select("map_id", "kf_id")
    later = clouds.transform_points(pts, frames(spark, [(0, 0, 0.0, ID, at(6, 2, 3), False)]))
    same, _, changed = clouds.voxel_merge(state, seen, later, 1.0)
    assert clouds.voxel_means(same).first().x == 1.0 and changed.isEmpty()
    rebuilt, _, changed = clouds.voxel_merge(state.filter("false"), seen.filter("false"), later, 1.0)
    assert clouds.voxel_means(rebuilt).first().x == 6.0 and not changed.isEmpty()


def sector_cloud():
    def ray(deg, r=5.0):
        return (0, r * math.cos(math.radians(deg)), r * math.sin(math.radians(deg)), 0.0, 1.0)

    rows = []
    for deg, n in ((0, 50), (90, 50), (-90, 50), (180, 50), (150, 10), (-150, 10), (157.5, 10), (-157.5, 10)):
        rows += [ray(deg)] * n
    return rows


def test_nav_filter_counts(spark):
    kf = frames(spark, [(0, 0, 0.0, ID, ID, False)])
    out = nav_filter(cloud(spark, sector_cloud()), kf, {"width_deg": 45.0})
    c = out.counts.first()
    assert (c.original_points, c.kept_points, c.removed_points) == (240, 170, 70)
    require_no_empty_keyframes(out)
    rules = {"max_range": 3.0, "self_box": (-0.5, 0.5, -0.5, 0.5, -0.5, 0.5), "rear_sector": False}
    pts = cloud(spark, [(0, 2, 0, 0, 1), (0, 4, 0, 0, 1), (0, 0.25, 0, 0, 1)])
    c = nav_filter(pts, kf, rules).counts.first()
    assert (c.original_points, c.kept_points, c.removed_range, c.removed_self) == (3, 1, 1, 1)
    with pytest.raises(ValueError):
        require_no_empty_keyframes(nav_filter(cloud(spark, [(0, -2, 0, 0, 1)] * 32), kf))


def test_gate_limits():
    for pose, ok in ((at(0.5), False), (at(1.0), True), (at(yaw=0.3), False), (at(yaw=0.51), True)):
        _, out = folds.gate_step()(list(ID), pd.DataFrame({"pose": [list(pose)]}))
        assert out["accepted"].tolist() == [ok]


def test_chunked_fold_equals_plain_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, at(*rng.normal(size=2))) for s in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, f"session_id long, seq long, pose {POSE_DDL}")
    got = stateful.keyframe_gate(df, chunk_size=13).toPandas().sort_values(["session_id", "seq"])
    want = []
    for s in range(2):
        pdf = pd.DataFrame({"pose": [list(p) for q, _, p in rows if q == s]})
        want += folds.gate_step()(None, pdf)[1]["accepted"].tolist()
    assert got["accepted"].tolist() == want


def test_nearest_keyframes(spark):
    kf = frames(spark, [(0, i, float(i), at(5.0 * i), at(5.0 * i), False) for i in range(3)])
    q = spark.createDataFrame([(0, 0.8), (0, 1.6)], "map_id long, ts double")
    got = {r.ts: r.nearest.kf_id for r in sequence.nearest_by_time(q, kf, ["map_id"]).collect()}
    assert got == {0.8: 1, 1.6: 2}
    spots = spark.createDataFrame([(0, 4, 4.0), (0, 8, 8.0)], "map_id long, query_id long, x double").withColumns(
        {"y": F.lit(0.0), "z": F.lit(0.0)}
    )
    near = {r.query_id: r.kf_id for r in neighbors.nearest_by_position(spots, kf).collect()}
    assert near == {4: 1, 8: 2}


def test_grid_and_block_search_match_brute_force(spark):
    rng = np.random.default_rng(5)
    src, tgt = rng.uniform(-5, 5, (300, 3)), rng.uniform(-5, 5, (200, 3))
    tgt = np.concatenate([tgt, tgt[:50], np.repeat(tgt[:1], 40, 0)])

    def table(a, name):
        return spark.createDataFrame(pd.DataFrame({"k": 0, name: range(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]}))

    out = neighbors.nearest_in_grid(table(src, "src_id"), table(tgt, "tgt_id"), ["k"], 1.5, (4, 1))
    got = {r.src_id: (r.hit.tgt_id, round(r.hit.d2, 9)) for r in out.collect()}
    d2 = ((src[:, None] - tgt[None]) ** 2).sum(-1)
    want = {i: (int(d.argmin()), round(d.min(), 9)) for i, d in enumerate(d2) if d.min() <= 2.25}
    assert got == want
    for dim in (3, 20):
        q, b = rng.normal(size=(100, dim)), rng.normal(size=(700, dim))
        b = np.concatenate([b, b[:300]])
        limit = rng.integers(1, 1000, 100)
        qi, bi, d = neighbors.nearest_in_block(q, limit, b, np.arange(1000), 7, size=64, fan=2)
        for i in range(100):
            dist = ((q[i] - b[: limit[i]]) ** 2).sum(1)
            best = np.lexsort((np.arange(limit[i]), dist))[:7]
            assert sorted(bi[qi == i]) == sorted(best)


def test_loop_selection_and_edges(spark):
    rows = [(0, 1, 10, 0.8, 0.5, True), (0, 1, 11, 0.2, 0.5, True), (0, 2, 12, 0.4, 0.1, True), (0, 3, 13, 0.1, 0.9, False)]
    m = spark.createDataFrame(
        rows, "map_id long, query_id long, match_id long, fitness double, inlier_ratio double, verified boolean"
    )
    kept = loops.accepted_loops(m, 0.3, 1.0, best=False)
    assert {r.match_id for r in kept.collect()} == {10, 11}
    best = {r.query_id: (r.match_id, r.fitness) for r in ranking.best_per_query(m).collect()}
    assert best[1] == (11, 0.2) and best[2] == (12, 0.4)
    one = m.filter("match_id = 10").withColumns(
        {"T_match_query": make_pose(*(F.lit(v) for v in at(1, 2, 3))), "info": F.array(F.lit(1.0))}
    )
    fwd = loops.loop_edges(one).first()
    back = loops.loop_edges(one, "query_to_match").first()
    assert (fwd.from_id, fwd.to_id, fwd.meas.tx) == (10, 1, 1.0)
    assert (back.from_id, back.to_id, back.meas.tx) == (1, 10, -1.0)


def test_two_stage_finds_near_copy(spark):
    rng = np.random.default_rng(7)
    vec = rng.uniform(size=(500, V.RHPD_DIM))
    pdf = pd.DataFrame({"map_id": 0, "pos": range(500), "rhpd": [v.tolist() for v in vec]})
    base = spark.createDataFrame(pdf).withColumn("coarse", V.coarse_key("rhpd"))
    q = spark.createDataFrame(pd.DataFrame({"map_id": [0], "query_id": [0], "rhpd": [(vec[317] + 1e-5).tolist()]}))
    q = q.withColumn("coarse", V.coarse_key("rhpd")).withColumn("limit", F.lit(2**62))
    hit = retrieval.knn_two_stage(q, base, 5, 20).filter("rank = 0").first()
    assert hit.match_pos == 317


def test_recent_copies_do_not_hide_old_loop(spark):
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(181, 16))
    vec[20] = vec[180] + 0.001
    vec[131:180] = vec[180]
    v = spark.createDataFrame(pd.DataFrame({"map_id": 0, "pos": range(181), "coarse": [v.tolist() for v in vec]})).withColumn("full", F.col("coarse"))
    q = retrieval.loop_search_range(v, 50).filter("pos = 180").withColumn("query_id", F.col("pos"))
    hits = retrieval.knn_two_stage(q, v, 3, 10, full="full", metric="l2").collect()
    assert hits and all(r.match_pos < 130 for r in hits)
    assert min(hits, key=lambda r: r.rank).match_pos == 20


def test_half_turn_keeps_descriptor_close(spark):
    wall = [(x / 10, -2.0, z / 2) for x in range(-60, 80) for z in range(4)]
    wall += [(3.0, y / 10, z / 2) for y in range(-18, 35) for z in range(4)]
    other = [(6 * math.cos(a / 20), 9 * math.sin(a / 20), z) for a in range(126) for z in range(4)]
    rows = [(0, *p, 1.0) for p in wall] + [(1, -x, -y, z, 1.0) for x, y, z in wall] + [(2, *p, 1.0) for p in other]
    d = {r.kf_id: np.array(r.rhpd) for r in D.rhpd_descriptors(cloud(spark, rows)).collect()}
    turned = V.rhpd_distances(d[0][None], d[1][None])[0]
    different = V.rhpd_distances(d[0][None], d[2][None])[0]
    assert len(d[0]) == 3037 and turned < 0.75 * different


def sample(spark, rows):
    ddl = f"map_id long, seq long, ts double, raw {POSE_DDL}, anchor_id long, anchor_raw {POSE_DDL}, use_bracket boolean"
    return spark.createDataFrame(rows, ddl)


def test_dense_trajectory(spark):
    kf = frames(spark, [(0, 0, 1.0, ID, ID, False), (0, 1, 2.0, ID, at(0, 2), False)])
    p = dense_trajectory(sample(spark, [(0, 0, 1.5, at(0.1), None, None, True)]), kf).first().pose
    assert (round(p.tx, 9), round(p.ty, 9)) == (0.1, 1.0)
    loaded = frames(spark, [(0, 5, 1.0, ID, at(0, 10), True)])
    p = dense_trajectory(sample(spark, [(0, 0, 1.5, at(0, 10), 5, at(0, 10), False)]), loaded).first().pose
    assert p.ty == pytest.approx(10.0)


def test_trajectory_source(spark):
    df = spark.createDataFrame([("keyframe_fallback",), ("none",)], "s string")
    got = [r[0] for r in df.select(trajectory_source_state("s", F.lit(True))).collect()]
    assert got == ["mixed_keyframe_fallback_and_high_rate", "native"]


def graph_edges(spark, rows):
    data = [(0, a, b, m, [float(v) for v in diagonal_information(*w)], t) for a, b, m, w, t in rows]
    return spark.createDataFrame(
        data, f"map_id long, from_id long, to_id long, meas {POSE_DDL}, info array<double>, type string"
    )


def test_chain_start_values(spark):
    e = graph_edges(spark, [(i, i + 1, at(1.0), (1e4, 1e6), "ODOMETRY") for i in range(5)])
    anchors = spark.createDataFrame([(0, 0, ID)], f"map_id long, kf_id long, opt {POSE_DDL}")
    out = {r.kf_id: r.pose.tx for r in posegraph.initial_values(e, anchors, chunk=2).collect()}
    assert out[5] == pytest.approx(5.0, abs=1e-9) and len(out) == 6


def test_square_loop_closes(spark):
    drift = at(1.05, 0.0, 0.0, math.pi / 2 + 0.02)
    rows = [(i, i + 1, drift, (1e2, 1e2), "ODOMETRY") for i in range(4)]
    rows.append((0, 4, ID, (1e4, 1e4), "LOOP"))
    e = graph_edges(spark, rows)
    anchors = spark.createDataFrame([(0, 0, ID)], f"map_id long, kf_id long, opt {POSE_DDL}")
    start = posegraph.initial_values(e, anchors)
    end, how = posegraph.relax_pose_graph(start, e, iterations=2, cg_iterations=10, report=True)
    assert how.first().steps in (1, 2) and how.first().gradient >= 0
    assert not how.first().stalled and how.first().cost < 0.7  # 2.3 at the start
    assert 0 <= how.first().residual < 1e-3
    out = {r.kf_id: r.pose for r in end.collect()}
    assert math.dist((out[0].tx, out[0].ty), (out[4].tx, out[4].ty)) < 0.1


def test_small_systems_are_solved_in_a_task(spark, monkeypatch):
    """The same steps as in rounds over tables, without a job per iteration."""
    rng, rows, blocks = np.random.default_rng(4), [], []
    for m, n in ((0, 6), (1, 1), (2, 9)):
        big = np.zeros((6 * n, 6 * n))
        for i in range(n - 1):
            j = rng.normal(size=(6, 12))
            at_i, at_j = slice(6 * i, 6 * i + 6), slice(6 * i + 6, 6 * i + 12)
            big[6 * i : 6 * i + 12, 6 * i : 6 * i + 12] += j.T @ j
            blocks.append((m, i, i + 1, big[at_i, at_j].ravel().tolist()))
        big += np.eye(6 * n)
        for i in range(n):
            d = big[6 * i : 6 * i + 6, 6 * i : 6 * i + 6]
            rows.append((m, i, d.ravel().tolist(), rng.normal(size=6).tolist(), np.linalg.inv(d).ravel().tolist()))
    e = spark.createDataFrame(blocks, "map_id long, from_id long, to_id long, h_ft array<double>")
    n = spark.createDataFrame(rows, "map_id long, kf_id long, diag array<double>, b array<double>, inv array<double>")
    far = {(r.map_id, r.kf_id): (r.x, r.left) for r in posegraph._solve_over_tables(e, n, 8, 1e-10).collect()}
    monkeypatch.setattr(posegraph, "_solve_over_tables", None)
    near = {(r.map_id, r.kf_id): (r.x, r.left) for r in posegraph._solve_step(e, n, 8, 1e-10).collect()}
    assert near.keys() == far.keys() and len(near) == 16
    for k, (x, left) in near.items():
        assert np.allclose(x, far[k][0], rtol=1e-6, atol=1e-9) and abs(left - far[k][1]) < 1e-6


def test_a_map_whose_steps_all_raise_the_objective_is_stalled(spark, monkeypatch):
    def uphill(blocks, nodes, iterations, tol):
        away = F.array(*(F.lit(v) for v in (0.01, 0.0, 9.0, 0.0, 0.0, 0.0)))
        return nodes.select("map_id", "kf_id", F.when(F.col("kf_id") == 0, F.array_repeat(F.lit(0.0), 6)).otherwise(away).alias("x"), F.lit(1.0).alias("left"))

    e = graph_edges(spark, [(0, 1, at(1.0), (1e2, 1e2), "ODOMETRY"), (0, 1, at(1.5), (1e2, 1e2), "LOOP")])
    anchors = spark.createDataFrame([(0, 0, ID)], f"map_id long, kf_id long, opt {POSE_DDL}")
    start = posegraph.initial_values(e, anchors)
    monkeypatch.setattr(posegraph, "_solve_step", uphill)
    _, bad = posegraph.relax_pose_graph(start, e, iterations=2, halvings=1, report=True)
    assert bad.first().stalled and not bad.first().converged and bad.first().residual == 1.0


def test_range_image_keeps_front(spark):
    pts = cloud(spark, [(0, 5, 0, 0, 1), (0, 6, 0, 0, 1), (0, -5, 0, 0, 1), (0, 4, 1, 1, 1)])
    full, start, span, low, high = evaluate.default_envelope(120.0, 90.0)
    env = pts.select("map_id", "kf_id").distinct().withColumns(
        {"azimuth_full": F.lit(full), "azimuth_start": F.lit(start), "azimuth_span": F.lit(span),
         "vertical_min": F.lit(low), "vertical_max": F.lit(high)}
    )
    hits = evaluate.range_image(pts, env, res_deg=10.0)
    xs = {r.x for r in evaluate.occlusion_filter(hits, dilation=0).collect()}
    assert 5.0 in xs and -5.0 not in xs and 6.0 not in xs


def test_lock_after_full_window():
    step, state = folds.lock_step({"window": 3}), None
    cols = dict(seed=7, match_id=7, ll=1.0, converged=True, valid=True, ambiguous=False, x=0.0, y=0.0, z=0.0)
    pdf = pd.DataFrame([{"frame_id": i, "odom": list(at(i)), "pose": list(at(i + 5.0)), **cols} for i in range(3)])
    state, out = step(state, pdf)
    assert out["status"].tolist() == ["pending", "pending", "locked"]
    assert out["map_odom"].iloc[2][0] == pytest.approx(5.0) and state == folds.new_lock()


def test_strict_and_salvage(spark):
    nan = float("nan")
    kf = frames(spark, [(0, 0, 0.0, ID, ID, False), (0, 1, nan, ID, ID, False), (1, 0, 0.0, ID, ID, False), (1, 0, 1.0, ID, ID, False)])
    pts = spark.createDataFrame(
        [(m, k, 0, 0.0, 0.0, 0.0, 0.0) for m in (0, 1) for k in (0, 1)],
        "map_id long, kf_id long, pt_id long, x double, y double, z double, intensity double",
    )
    checked = mapcheck.validate_keyframes(kf, pts)
    assert mapcheck.accepted_keyframes(checked, "STRICT").count() == 0
    kept = mapcheck.accepted_keyframes(checked, "SALVAGE").collect()
    assert [(r.map_id, r.kf_id) for r in kept] == [(0, 0)]


def test_yaw_pose_is_unit(spark):
    p = spark.range(1).select(yaw_pose(F.lit(0.7)).alias("p")).first().p
    assert p.qz**2 + p.qw**2 == pytest.approx(1.0)


def test_polar_batches_equal_single_pairs():
    rng = np.random.default_rng(4)
    a = [rng.random(V.POLAR_CHANNELS * 20 * 60) * (rng.random() < 0.8) for _ in range(9)]
    b = [np.roll(x.reshape(-1, 60), k, axis=1).ravel() for k, x in enumerate(a)] + []
    d, k = V.polar_distances([*a, None], [*b, b[0]], V.POLAR_CHANNELS, V.POLAR_WEIGHTS)
    for i, (x, y) in enumerate(zip(a, b)):
        assert V.polar_distance_one(x, y, V.POLAR_CHANNELS, V.POLAR_WEIGHTS) == (pytest.approx(d[i]), k[i])
        assert not x.any() or (d[i] < 1e-9 and (k[i] + i) % 60 == 0)
    assert (d[-1], k[-1]) == (1.0, 0)


def test_gap_holds_across_batches(spark):
    from lidarlake.streaming.batches import after_gap

    ids = [10, 11, 12, 15, 16, 19, 20, 27, 28]
    rows = [(0, q, q - 5) for q in ids]
    one = {r.query_id for r in loops.thin_queries(spark.createDataFrame(rows, "map_id long, query_id long, match_id long")).collect()}
    seen, gaps = set(), None
    for row in rows:
        left, gaps = after_gap(spark.createDataFrame([row], "map_id long, query_id long, match_id long"), gaps, 5)
        seen |= {r.query_id for r in left.collect()}
    assert seen == one == {10, 15, 20, 27}


def test_registration_far_from_the_origin(spark):
    from lidarlake.functions.pose import identity_pose
    from lidarlake.operators.register import register_pairs

    rng = np.random.default_rng(8)
    side = rng.uniform(0, 4, (500, 2))
    flat = np.concatenate([np.c_[side[:170], 0 * side[:170, :1]], np.c_[side[170:340, :1], 0 * side[170:340, :1], side[170:340, 1:]],
                           np.c_[0 * side[340:, :1], side[340:]]])
    for origin in ((0.0, 0.0, 0.0), (500_000.0, 4_000_000.0, 30.0)):
        both = [flat + origin + (0.07, -0.05, 0.04), flat + origin]
        src, tgt = (spark.createDataFrame(pd.DataFrame({"pair_id": 0, "x": c[:, 0], "y": c[:, 1], "z": c[:, 2]})) for c in both)
        pairs = spark.createDataFrame([(0,)], "pair_id long").withColumn("T", identity_pose())
        out = register_pairs(pairs, src, tgt, leaf=0.05, rounds=8, refine=False).first()
        assert out.converged and out.inliers > 300
        moved = np.array([out.T.tx, out.T.ty, out.T.tz])
        assert origin[0] or np.abs(moved - (-0.07, 0.05, -0.04)).max() < 0.02


def test_stored_maps_keep_each_other(spark, tmp_path):
    from lidarlake.sources import maps as M

    def tables(map_id, n, source="", degraded=False, track=True):
        kf = spark.createDataFrame([(map_id, i, float(i), at(i), at(i), False) for i in range(n)], f"map_id long, kf_id long, ts double, odom {POSE_DDL}, opt {POSE_DDL}, from_loaded boolean")
        pts = spark.createDataFrame([(map_id, i, 0, 1.0, 2.0, 3.0, 0.0) for i in range(n)], "map_id long, kf_id long, pt_id long, x double, y double, z double, intensity double")
        row = (map_id, "2.3.0", mapcheck.descriptor_schema(), "map", "body", 0, 0, 0, False, "", 0, 0, 0, source, degraded)
        path = spark.createDataFrame([(map_id, i, float(i), at(i)) for i in range(n if track else 0)], f"map_id long, seq long, ts double, pose {POSE_DDL}")
        desc = spark.createDataFrame([(map_id, i, None, [float(i)] * 3037) for i in range(n)], "map_id long, kf_id long, polar array<double>, rhpd array<double>")
        edges = spark.createDataFrame([], f"map_id long, from_id long, to_id long, meas {POSE_DDL}, info array<double>, type string")
        return {"maps": spark.createDataFrame([row], M.MAP_TABLES["maps"]), "keyframes": kf, "points": pts, "descriptors": desc, "edges": edges, "trajectory": path}

    store = str(tmp_path / "store")
    M.write_map(tables(0, 3), store)
    M.write_map(tables(1, 2, "mixed_keyframe_fallback_and_high_rate", True), store)
    M.write_map(tables(2, 2, track=False), store)
    both = M.read_map(spark, store)
    assert {(r.map_id, r.kf_id) for r in both["keyframes"].collect()} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)}
    assert M.read_map(spark, store, map_ids=[1])["points"].count() == 2
    got = {(r.map_id, r.kf_id): (r.rhpd[0], r.rebuilt) for r in both["descriptors"].collect()}
    assert got[0, 2] == (2.0, False)
    M.write_map({n: df.drop("rebuilt", "version_action") for n, df in M.read_map(spark, store, map_ids=[0]).items()}, store)
    assert M.read_map(spark, store)["points"].count() == 7
    stale = M.read_map(spark, store, map_ids=[0], schema="other", rebuild=lambda k, p: k.select("map_id", "kf_id", F.array_repeat(F.lit(9.0), 3037).alias("rhpd")))
    assert {(r.rhpd[5], r.rebuilt) for r in stale["descriptors"].collect()} == {(9.0, True)}
    M.write_map(tables(1, 2, track=False), store)
    assert M.read_map(spark, store, map_ids=[1])["trajectory"].count() == 0
    M.write_map(tables(1, 2, "mixed_keyframe_fallback_and_high_rate", True), store)
    flags = {r.map_id: r for r in M.read_nav_resource(spark, store, allow_fallback=True)["flags"].collect()}
    assert (flags[0].has_native_dense, flags[0].degraded, flags[0].from_keyframe_fallback) == (True, False, False)
    assert (flags[1].has_native_dense, flags[1].degraded, flags[1].source) == (False, True, "mixed_keyframe_fallback_and_high_rate")
    assert (flags[2].source, flags[2].from_keyframe_fallback) == ("keyframe_fallback", True)
    with pytest.raises(ValueError, match="map 2"):
        M.read_nav_resource(spark, store)
    assert [r.map_id for r in M.read_nav_resource(spark, store, refuse=False)["missing"].collect()] == [2]
    track = M.read_nav_resource(spark, store, allow_fallback=True, map_ids=[1])["trajectory"]
    assert {(r.source, r.degraded) for r in track.collect()} == {("mixed_keyframe_fallback_and_high_rate", True)}
