"""Registered queries run the operators' whole job."""

import numpy as np
import pytest

from lidarlake.catalog import all_queries, places
from lidarlake.functions import vectors as V
from lidarlake.operators import posegraph, register, retrieval
from lidarlake.plans import loops

SF = "/root/testdata/sf0.001"


class Reached(Exception):
    pass


@pytest.mark.parametrize(
    "name, rounds",
    [("register_pairs", 30), ("refine_pairs", 20), ("verify_pairs_keyframe", 30), ("align_batch", 30), ("seeded_best", 30), ("verify_loops", 30), ("close_loops", 30)],
)
def test_registration_runs_with_the_defaults(spark, monkeypatch, name, rounds):
    seen, radii, members = [], [], loops.submap_members

    def align(pairs, source, target, stages, k):
        seen.append((*{s[2] for s in stages}, k))
        raise Reached

    def around(centers, keyframes, before, after, *names):
        radii.append((before, after))
        return members(centers, keyframes, before, after, *names)

    monkeypatch.setattr(register, "_align", align)
    monkeypatch.setattr(loops, "submap_members", around)
    with pytest.raises(Reached):
        all_queries()[name](spark, SF)
    assert seen == [(rounds, 20)] and radii == [(5, 5)] * name.endswith("_loops")


def test_relaxation_runs_with_the_defaults_and_reports(spark, monkeypatch):
    given = []

    def relax(nodes, edges, **options):
        given.append(options)
        report = nodes.select("map_id").distinct().selectExpr("map_id", "0d cost", "2 steps", "0.5d gradient", "0d residual", "false stalled", "true converged")
        return nodes, report

    monkeypatch.setattr(posegraph, "relax_pose_graph", relax)
    out = all_queries()["relax_pose_graph"](spark, SF)
    assert given == [{"report": True}] and {"converged", "steps", "gradient"} <= set(out.columns)


def test_retrieval_runs_with_the_defaults(spark, monkeypatch):
    """Only thresholds and the gap to recent frames are given; none of these lowers what is searched."""
    given = {}
    monkeypatch.setattr(places, "place_frames", lambda spark, sf: spark.createDataFrame(
        [(0, k, k, k, [0.0], [0.0], [0.0], [0.0]) for k in range(3)],
        "map_id long, kf_id long, arrival long, pos long, coarse array<double>, rhpd array<double>, ring_key array<double>, polar array<double>",
    ))
    for name in ("knn_ring_key", "detect_loops", "reloc_candidates", "polar_scan"):
        monkeypatch.setattr(retrieval, name, lambda *a, name=name, **options: given.update({name: options}) or a[0])
        all_queries()[name](spark, SF)
    assert given == {
        "knn_ring_key": {"thr": 0.6}, "detect_loops": {"exclude_recent": 5, "sc_thr": 0.6}, "reloc_candidates": {}, "polar_scan": {"thr": 0.5},
    }


def test_polar_scan_equals_brute_force(spark):
    frames = [(r.pos, np.array(r.polar)) for r in places.place_frames(spark, SF).select("pos", "polar").collect()]
    want = []
    for q, a in frames:
        near = sorted((V.polar_distance_one(a, b, V.POLAR_CHANNELS, V.POLAR_WEIGHTS)[0], p) for p, b in frames)
        want += [(q, p) for d, p in near if d <= 0.5][:10]
    got = all_queries()["polar_scan"](spark, SF).collect()
    assert sorted((r.query_id, r.match_pos) for r in got) == sorted(want) and want
