"""Work that one task does whole: its points, vectors and rounds travel once."""

import numpy as np
from pyspark.sql import functions as F

from lidarlake.catalog import flows
from lidarlake.functions import vectors
from lidarlake.functions.pose import make_pose
from lidarlake.operators import descriptors, register, retrieval, scanmatch
from lidarlake.sources import maps
from tests.test_scanmatch import MOVES, corridor, gaps, scans, starts


def test_partners_are_searched_again_only_where_they_may_have_changed(monkeypatch):
    """A cloud that settles keeps its partners; they are those of a whole search after every move, near and far."""
    rng, asked = np.random.default_rng(5), []
    real = scanmatch.nearest_two_of_few
    for n in (600, 6000):
        b = corridor(rng, n)
        p = b[:: n // 200] + rng.normal(0, 0.3, (200, 3))
        monkeypatch.setattr(scanmatch, "nearest_two_of_few", lambda q, b: asked.append(len(q)) or real(q, b))
        partners = scanmatch.Partners(scanmatch.Cloud(b, 10), 0.25)
        for step in (0.0, 0.1, 0.01, 0.001, 0.0001):
            p = p + step
            d2 = ((p[:, None] - b) ** 2).sum(2)
            want = np.flatnonzero(d2.min(1) <= 0.25)
            rows, near = partners.of(p)
            assert rows.tolist() == want.tolist() and near.tolist() == d2.argmin(1)[want].tolist()
    assert sum(asked) < 2 * 200 * 5 * 0.6


def test_small_clouds_are_thinned_and_refined_where_they_are_registered(spark, monkeypatch):
    """One gathering of the points for all resolutions and the fine pass; no aggregation of them before."""
    gathered = []
    real = register.gathered
    monkeypatch.setattr(register, "gathered", lambda *a: gathered.append(1) or real(*a))
    monkeypatch.setattr(register, "thinned", None)
    src, tgt = scans(spark, MOVES[:2])
    found = register.register_pairs(starts(spark, 2), src, tgt).collect()
    assert len(found) == 2 and all(r.success for r in found) and len(gathered) == 1
    assert all(t < 0.01 and a < 0.01 for t, a in gaps(found, MOVES).values())


def test_large_clouds_are_refined_as_well(spark, monkeypatch):
    """Clouds that are too large as they are, but not when thinned, give the same result, the fine pass included."""
    src, tgt = scans(spark, MOVES[:1])
    near = register.register_pairs(starts(spark, 1), src, tgt, leaf=0.3).collect()[0]
    monkeypatch.setattr(scanmatch, "POINTS_IN_TASK", 2500)
    far = register.register_pairs(starts(spark, 1), src, tgt, leaf=0.3).collect()[0]
    assert (near.converged, near.inliers, near.success) == (far.converged, far.inliers, far.success)
    assert np.allclose(list(near["T"]), list(far["T"]), atol=1e-9) and abs(near.fitness - far.fitness) < 1e-9


def test_submaps_of_small_maps_are_described_in_a_task(spark, monkeypatch):
    """No copy of a point leaves the task; larger maps give the same vectors over tables."""
    rows = []
    for m in (0, 1):
        for kf in range(6 if m else 4):
            rows += [(m, kf, *map(float, p)) for p in corridor(np.random.default_rng(10 * m + kf), 15 if kf == 5 else 300) * 2.5]
    points = spark.createDataFrame(rows, "map_id long, kf_id long, x double, y double, z double").withColumn("intensity", F.lit(0.0))
    keys = spark.createDataFrame(sorted({r[:2] for r in rows} | {(1, 9)}), "map_id long, kf_id long")
    zero, half = F.lit(0.0), F.col("kf_id") * 0.05
    frames = keys.withColumn("opt", make_pose(F.col("kf_id") * 0.7, zero, zero, zero, zero, F.sin(half), F.cos(half)))
    near = descriptors.submap_descriptors(frames, points, min_points=400)
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    monkeypatch.setattr(descriptors, "POINTS_IN_TASK", 1250)
    both = descriptors.submap_descriptors(frames, points, min_points=400)
    got, want = ({(r.map_id, r.kf_id): np.array(r.rhpd) for r in d.collect()} for d in (near, both))
    assert got.keys() == want.keys() == {tuple(r) for r in keys.collect()} - {(1, 9)}
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got) and not got[0, 0].any() and got[1, 4].any()


def test_vectors_of_small_maps_meet_once(spark, monkeypatch):
    """Scoring shuffles every vector once per side; maps too large for a task meet in blocks with the same scores."""
    v = spark.range(60).selectExpr("id % 2 map_id", "id div 2 pos", "array(sin(id * 1.7D), cos(id * 0.3D)) vec")
    v = v.union(spark.range(5).selectExpr("1L", "30 + id", "array(1.0D, id * 0.5D)"))
    pairs = v.select("map_id", F.col("pos").alias("query_id")).join(v.select("map_id", F.col("pos").alias("match_pos")), "map_id").filter("match_pos % 3 = query_id % 3 and query_id <> 7")
    queries = v.withColumnRenamed("pos", "query_id")
    args = (pairs, queries, v, "vec", retrieval._l2_kernel, [("distance", "double")])
    near = retrieval.score_pairs(*args)
    assert "FlatMapGroupsInPandas" in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "FRAMES_IN_TASK", 32)
    got, want = ({(r.map_id, r.query_id, r.match_pos): r.distance for r in d.collect()} for d in (near, retrieval.score_pairs(*args, block=8)))
    vec = {(r.map_id, r.pos): np.array(r.vec) for r in v.collect()}
    assert got.keys() == want.keys() == {tuple(r) for r in pairs.collect()}
    for (m, q, p), d in got.items():
        assert d == want[m, q, p] and np.isclose(d, np.linalg.norm(vec[m, q] - vec[m, p]))


def test_nothing_is_searched_again_where_all_have_candidates(spark, monkeypatch):
    """The fallback looks only where a query has no primary candidate."""
    asked = spark.range(4).selectExpr("0L map_id", "id query_id")
    found, rest = retrieval._unanswered(asked, asked)
    assert rest is None and found.count() == 4
    _, rest = retrieval._unanswered(asked, asked.filter("query_id <> 2"))
    assert [tuple(r) for r in rest.collect()] == [(0, 2)]


def test_near_polar_distances_have_no_wide_rows(spark):
    """Cells travel, not dense matrices; the distances are those of the matrices, across blocks and for empty clouds."""
    rng = np.random.default_rng(6)
    rows = [(m, kf, *map(float, rng.uniform(-30, 30, 2)), float(rng.uniform(-2, 6))) for m in (0, 1) for kf in (0, 1, 3, 4, 5, 9) for _ in range(80)]
    rows += [(1, 6, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "map_id long, kf_id long, x double, y double, z double")
    out = retrieval.near_polar(p.select("map_id", "kf_id").distinct(), descriptors.polar_cells(p), block=4)
    assert "flatten" not in out._jdf.queryExecution().executedPlan().toString()
    vec = {(r.map_id, r.kf_id): np.array(r.polar) for r in descriptors.polar_descriptors(p).collect()}
    want = {(m, a, b) for m, a in vec for n, b in vec if m == n and 0 < b - a <= 3}
    got = {(r.map_id, r.a_id, r.b_id): (r.distance, r["shift"]) for r in out.collect()}
    assert got.keys() == want
    for (m, a, b), found in got.items():
        assert np.allclose(found, vectors.polar_distance_one(vec[m, a], vec[m, b], vectors.POLAR_CHANNELS, vectors.POLAR_WEIGHTS))


def test_a_store_has_few_folders(spark, tmp_path, monkeypatch):
    """Neighbouring maps share a folder; a save replaces its maps only, and maps that lost all rows lose them."""
    monkeypatch.setattr(maps, "MAPS_PER_PART", 4)
    sf, store = "/root/testdata/sf0.001", str(tmp_path / "store")
    one = flows.map_tables(spark, sf)
    one = {n: df.filter("map_id = 0").drop("map_id") for n, df in one.items()}
    many = {n: df.crossJoin(spark.range(-1, 9).select(F.col("id").alias("map_id"))) for n, df in one.items()}
    maps.write_map(many, store)
    assert sorted(p.name for p in (tmp_path / "store" / "points").glob("part=*")) == ["part=-1", "part=0", "part=1", "part=2"]

    def rows(name, **options):
        return {r.map_id: r["count"] for r in maps.read_table(spark, store, name, **options).groupBy("map_id").count().collect()}

    n, track = one["points"].count(), one["trajectory"].count()
    assert rows("points") == dict.fromkeys(range(-1, 9), n) and rows("points", map_ids=[-1, 5]) == {-1: n, 5: n}
    # Map 8 is alone in its folder, map 5 is not.
    again = {name: df.filter("map_id in (5, 8)") for name, df in many.items()}
    again["trajectory"] = again["trajectory"].limit(0)
    again["points"] = again["points"].unionByName(again["points"])
    maps.write_map(again, store)
    assert rows("points") == {m: n * (2 if m in (5, 8) else 1) for m in range(-1, 9)}
    assert rows("trajectory") == {m: track for m in range(-1, 9) if m not in (5, 8)} and rows("maps") == dict.fromkeys(range(-1, 9), 1)


def test_registration_far_from_the_origin():
    """Five kilometres from the origin of the map a registration ends where it does near the origin, with the sums about the origin."""
    world = corridor(np.random.default_rng(8), 1200)
    body = world - [0.2, -0.1, 0.05]
    for c in (np.zeros(3), np.array([5000.0, -300.0, 2.0])):
        src, tgt = scanmatch.Cloud(body, 10), scanmatch.Cloud(world + c, 10)
        for kind in ("plane", "gicp"):
            pose, _, error, inliers, h = scanmatch.align_clouds([*c, 0.0, 0.0, 0.0, 1.0], src, tgt, 1.0, 30, kind)
            assert np.allclose(pose[:3], c + [0.2, -0.1, 0.05], atol=2e-3) and np.allclose(pose[3:6], 0, atol=1e-5) and inliers > 1000
    p, n = tgt.points[:200], tgt.normals(np.arange(200))
    about, (want, _, _) = np.eye(6), scanmatch.plane_equations(p, p, n, None)
    about[:3, 3:] = np.cross(c, np.eye(3))
    assert np.allclose(about.T @ scanmatch.plane_equations(p - c, p - c, n, None)[0] @ about, want, rtol=1e-6, atol=1.0)
