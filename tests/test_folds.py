"""Sequential folds read rows as they come: no frame per session or chunk."""

import numpy as np
import pandas as pd

from lidarlake.operators import sequence
from lidarlake.plans import loops
from lidarlake.streaming import folds, stateful
from tests.test_growth import plan
from tests.test_goldens import POSE_DDL, at


def test_chunked_folds_build_no_frame_per_chunk(spark, monkeypatch):
    """Chunks are dealt and sorted by Spark and read row by row; the rows are those of the plain fold."""
    plans, write = [], sequence.materialize
    monkeypatch.setattr(sequence, "materialize", lambda df: plans.append(plan(df)) or write(df))
    rng = np.random.default_rng(5)
    rows = [
        (s, i, k * 10, int(rng.integers(3)), float(rng.normal(1, 1)), bool(i % 2), True, False, at(float(i)), at(i + 5.0), k * 5.0, 0.0, 0.0)
        for s in range(3) for i in range(25) for k in range(3)
    ]
    names = ["session_id", "frame_id", "seed", "match_id", "ll", "converged", "valid", "ambiguous", "odom", "pose", "x", "y", "z"]
    types = f"session_id long, frame_id long, seed long, match_id long, ll double, converged boolean, valid boolean, ambiguous boolean, odom {POSE_DDL}, pose {POSE_DDL}, x double, y double, z double"
    got = stateful.fold_batch(spark.createDataFrame(rows, types).repartition(3), folds.lock_step(), folds.LOCK_DDL, chunk_size=7)
    got = {(r.session_id, r.frame_id): (r.status, r.locked, r.match_id) for r in got.collect()}
    for s in range(3):
        pdf = pd.DataFrame([dict(zip(names, r)) for r in rows if r[0] == s])
        _, want = folds.lock_step()(None, pdf)
        assert [got[s, r.frame_id][0] for r in want.itertuples()] == want["status"].tolist() and len(want) == 25
    assert any(locked for _, locked, _ in got.values())
    ids = spark.createDataFrame([(m, q) for m in range(2) for q in (0, 3, 5, 9, 10, 14, 15, 40)], "map_id long, query_id long")
    kept = {(r.map_id, r.query_id) for r in loops.thin_queries(ids, 5, chunk=4).collect()}
    assert kept == {(m, q) for m in range(2) for q in (0, 5, 10, 15, 40)}
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroupsInPandas" in p for p in plans)
