"""Place retrieval: preselection by small keys, exact rerank by full descriptors, fused ranking."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions import vectors as V
from lidarlake.functions.scores import fused_score
from lidarlake.operators.neighbors import BLOCK, block_top_k, fresh, large_keys
from lidarlake.operators.sequence import dense_position
from lidarlake.session import materialize

NO_LIMIT = 2**62
#: Blocks a map is cut into, and the least (unless smaller ones are asked for) and most rows of one.
BLOCKS, LEAST_ROWS, MOST_ROWS = 32, 512, 1 << 16
#: Frames of a map that one task takes with their wide vectors, and frames of all maps per task.
FRAMES_IN_TASK, FRAMES_PER_TASK = 512, 2_000


def dedupe_keep_first(df: DataFrame, keys=("map_id", "kf_id"), arrival="arrival") -> DataFrame:
    """One row per key, the earliest to arrive."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("_r")).select(*keys, "_r.*")


def arrival_position(descriptors: DataFrame, arrival="arrival") -> DataFrame:
    """Dense position per map in arrival order; a repeated id keeps its first place."""
    return dense_position(dedupe_keep_first(descriptors, arrival=arrival), ["map_id"], arrival)


def loop_search_range(positions: DataFrame, exclude_recent=50) -> DataFrame:
    """Frames each query may match: all positions below ``limit``. Queries without any are dropped."""
    return positions.withColumn("limit", F.col("pos") - exclude_recent).filter("limit > 0")


def _block_rows(rows, block):
    """Rows of a block of a map: a part of BLOCKS of it, so that a vector travels to few blocks however large the map is."""
    return F.least(F.lit(MOST_ROWS), F.greatest(F.lit(min(block, LEAST_ROWS)), F.ceil(rows / F.lit(BLOCKS)))).cast("long")


def top_by_key(queries: DataFrame, base: DataFrame, m: int, vec: str, block=BLOCK) -> DataFrame:
    """The ``m`` nearest base frames per query by Euclidean distance of the array ``vec``.

    ``queries``: map_id, query_id, limit, vec. ``base``: map_id, pos, vec. Of base frames with
    equal keys only the first ``m`` positions can ever be among the nearest ``m`` (equal distance,
    lower position wins, and every query that may see a later copy may see the earlier ones), so
    later copies are left out before any distance is computed. Blocks grow with the map (``_block_rows``);
    ``block`` only lowers their least size.
    """
    extent = base.groupBy("map_id").agg(F.max("pos").alias("_top"))
    extent = extent.withColumn("_rows", _block_rows(F.col("_top") + 1, block))
    copies = Window.partitionBy("map_id", vec).orderBy("pos")
    distinct = (
        base.withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= m)
        .join(fresh(extent), ["map_id"])
        .select(
            "map_id", F.col("pos").alias("b_id"), F.floor(F.col("pos") / F.col("_rows")).alias("b_block"),
            F.col(vec).alias("vec"),
        )
    )
    last = F.floor(F.least(F.col("limit") - 1, F.col("_top")) / F.col("_rows"))
    q = (
        queries.filter("limit > 0")
        .join(extent, ["map_id"])
        .select(
            "map_id", F.col("query_id").alias("q_id"),
            F.floor(F.col("query_id") / F.col("_rows")).alias("q_block"),
            F.sequence(F.lit(0).cast("long"), last).alias("b_blocks"),
            "limit", F.col(vec).alias("vec"),
        )
    )
    return block_top_k(q, distinct, ["map_id"], m).select(
        "map_id", F.col("q_id").alias("query_id"), F.col("b_id").alias("match_pos"), "d2", "rank"
    )


def score_pairs(
    pairs: DataFrame, queries: DataFrame, base: DataFrame, vec: str, kernel, fields, block=512
) -> DataFrame:
    """Run ``kernel(a, b) -> list of arrays`` over the descriptors of chosen pairs.

    Wide vectors are not copied per pair: those of a map of at most FRAMES_IN_TASK frames meet in one task, each
    shuffled once; larger maps meet in blocks. ``fields``: list of (name, type) of the kernel's outputs.
    """
    large = large_keys(base, ["map_id"], FRAMES_IN_TASK)
    if large.isEmpty():
        return _score_in_tasks(pairs, queries, base, vec, kernel, fields)
    large = materialize(large)
    near, far = ([d.join(large, "map_id", how) for d in (pairs, queries, base)] for how in ("left_anti", "left_semi"))
    return _score_in_tasks(*near, vec, kernel, fields).unionByName(_score_in_blocks(*far, vec, kernel, fields, block))


def _scorer(kernel, fields):
    """(function of queries, wanted positions and base frames, its columns)."""
    names = [n for n, _ in fields]
    cols = ["map_id", "query_id", "match_pos", *names]

    def score(map_id, asked, pos, vectors):
        order = np.argsort(pos, kind="stable")
        pos, parts = pos[order], []
        vectors = np.stack([vectors[i] for i in order])
        for q_id, want, qv in asked:
            b = vectors[np.searchsorted(pos, want)]
            out = kernel(np.broadcast_to(np.asarray(qv), b.shape), b)
            parts.append((np.full(len(want), q_id), want, *out))
        if not parts:
            return pd.DataFrame({c: [] for c in cols})
        return pd.DataFrame({"map_id": map_id, **dict(zip(cols[1:], (np.concatenate(c) for c in zip(*parts))))})[cols]

    return score, cols


def _score_ddl(fields):
    return "map_id long, query_id long, match_pos long, " + ", ".join(f"{n} {t}" for n, t in fields)


BASE, QUERY, PAIR = 0, 1, 2


def _score_in_tasks(pairs, queries, base, vec, kernel, fields):
    """The pairs of a map with the vectors of both sides in one task."""
    none = F.lit(None)
    kinds = [
        base.select("map_id", F.lit(BASE).alias("kind"), F.col("pos").alias("id"), none.cast("long").alias("other"), F.col(vec).alias("vec")),
        queries.select("map_id", F.lit(QUERY).alias("kind"), F.col("query_id").alias("id"), none.cast("long").alias("other"), F.col(vec).alias("vec")),
        pairs.select("map_id", F.lit(PAIR).alias("kind"), F.col("query_id").alias("id"), F.col("match_pos").alias("other"), none.cast("array<double>").alias("vec")),
    ]
    score, cols = _scorer(kernel, fields)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind, ids, vectors = (rows[c].to_numpy() for c in ("kind", "id", "vec"))
        b, q, p = (np.flatnonzero(kind == k) for k in (BASE, QUERY, PAIR))
        if not len(p) or not len(b):
            return pd.DataFrame({c: [] for c in cols})
        other = rows["other"].to_numpy()[p].astype(np.int64)
        asked, match = ids[p], np.isin(other, ids[b])
        asked, other = asked[match], other[match]
        order = np.lexsort((other, asked))
        asked, other = asked[order], other[order]
        first, last = (np.searchsorted(asked, ids[q], side) for side in ("left", "right"))
        wanted = [(ids[i], other[f:e], vectors[i]) for i, f, e in zip(q, first, last) if e > f]
        return score(rows["map_id"].iloc[0], wanted, ids[b], vectors[b])

    # Little data, much work: a given number of partitions is not merged by their size. It grows with the frames.
    width = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // FRAMES_PER_TASK))
    every = kinds[0].union(kinds[1]).union(kinds[2])
    return every.repartition(width, "map_id").groupBy("map_id").applyInPandas(run, _score_ddl(fields))


def _score_in_blocks(pairs, queries, base, vec, kernel, fields, block):
    """Pairs in blocks of queries and base frames: each vector travels once per block pair."""
    left = (
        pairs.groupBy("map_id", "query_id", F.floor(F.col("match_pos") / block).alias("b_block"))
        .agg(F.collect_list("match_pos").alias("want"))
        .join(queries.select("map_id", "query_id", F.col(vec).alias("vec")), ["map_id", "query_id"])
        .withColumn("q_block", F.floor(F.col("query_id") / block))
    )
    used = pairs.select(
        "map_id", F.floor(F.col("query_id") / block).alias("q_block"),
        F.floor(F.col("match_pos") / block).alias("b_block"), F.col("match_pos").alias("pos"),
    ).distinct()
    right = fresh(used.join(base.select("map_id", "pos", F.col(vec).alias("vec")), ["map_id", "pos"]))
    score, cols = _scorer(kernel, fields)

    def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or bs.empty:
            return pd.DataFrame({c: [] for c in cols})
        asked = [(i, np.asarray(want), v) for i, want, v in zip(qs["query_id"], qs["want"], qs["vec"])]
        return score(qs["map_id"].iloc[0], asked, bs["pos"].to_numpy(), bs["vec"].to_numpy())

    on = ["map_id", "q_block", "b_block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(run, _score_ddl(fields))


def _rhpd_kernel(a, b):
    return [V.rhpd_distances(a, b)]


def _l2_kernel(a, b):
    return [np.sqrt(((a - b) ** 2).sum(1))]


def _polar_kernel(a, b):
    return V.polar_distances(a, b, V.POLAR_CHANNELS, V.POLAR_WEIGHTS)


def _classic_kernel(a, b):
    return V.polar_distances(a, b, 1, (1.0,), eps=0.0, order="sorted")


def _rank(df, by, name, part=("map_id", "query_id")):
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*by)) - 1)


def knn_two_stage(
    queries: DataFrame, base: DataFrame, top_k: int, preselect=100, coarse="coarse", full="rhpd",
    metric="rhpd", block=BLOCK,
) -> DataFrame:
    """Nearest frames by full descriptor among the preselected nearest by coarse key.

    Output: map_id, query_id, match_pos, distance, rank. ``limit`` of the queries is applied
    before the preselection. Without one (``preselect`` 0 or less) every allowed frame is scored.
    """
    top_k = max(1, top_k)
    m = max(top_k, preselect) if preselect > 0 else 1 << 40
    # Read twice by the scoring; written so that the search is not repeated.
    chosen = materialize(top_by_key(queries, base, m, coarse, block))
    kernel = _rhpd_kernel if metric == "rhpd" else _l2_kernel
    scored = score_pairs(chosen, queries, base, full, kernel, [("distance", "double")])
    return _rank(scored, ["distance", "match_pos"], "rank").filter(F.col("rank") < top_k)


def knn_ring_key(queries, base, k=20, keep=10, thr=0.2, block=BLOCK) -> DataFrame:
    """Candidates by polar descriptor: ``k`` nearest ring keys, then those below ``thr``."""
    chosen = materialize(top_by_key(queries, base, k, "ring_key", block))
    scored = score_pairs(
        chosen, queries, base, "polar", _polar_kernel, [("sc_distance", "double"), ("shift", "int")]
    )
    return _rank(scored, ["sc_distance", "match_pos"], "sc_rank").filter(
        (F.col("sc_rank") < keep) & (F.col("sc_distance") < thr)
    )


def attach_polar(pairs: DataFrame, polar: DataFrame, veto=None) -> DataFrame:
    """Add a second distance per pair where known; drop pairs whose distance exceeds ``veto``."""
    out = pairs.join(polar, ["map_id", "query_id", "match_id"], "left")
    if veto is None:
        return out
    return out.filter(F.col("sc_distance").isNull() | (F.col("sc_distance") <= veto))


def rank_candidates(
    hits: DataFrame, k=10, thr=25.0, sc_thr=0.6, veto=None, w1=1.0, w2=0.15, rank_before_thr=False
) -> DataFrame:
    """Fuse both distances and keep the best ``k`` per query.

    ``hits``: map_id, query_id, match_id, rhpd_distance, sc_distance (may be NULL). ``rhpd_rank``
    is counted before the veto, after the threshold or (``rank_before_thr``) before it.
    """
    by_primary = ["rhpd_distance", "match_id"]
    if rank_before_thr:
        ranked = _rank(hits, by_primary, "rhpd_rank").filter(F.col("rhpd_distance") <= thr)
    else:
        ranked = _rank(hits.filter(F.col("rhpd_distance") <= thr), by_primary, "rhpd_rank")
    if veto is not None:
        ranked = ranked.filter(F.col("sc_distance").isNull() | (F.col("sc_distance") <= veto))
    scored = ranked.withColumn(
        "fused_score", fused_score("rhpd_distance", "sc_distance", thr, sc_thr, w1, w2)
    )
    return _rank(scored, ["fused_score", "rhpd_distance", "match_id"], "fused_rank").filter(
        F.col("fused_rank") < k
    )


def _named(hits, base):
    return hits.join(
        base.select("map_id", F.col("pos").alias("match_pos"), F.col("kf_id").alias("match_id")),
        ["map_id", "match_pos"],
    )


def _with_polar(hits, queries, base, sector_deg=6.0):
    polar = score_pairs(
        hits, queries, base, "polar", _polar_kernel, [("sc_distance", "double"), ("shift", "int")]
    )
    return hits.join(polar, ["map_id", "query_id", "match_pos"], "left").withColumn(
        "yaw", F.col("shift") * math.radians(sector_deg)
    )


CANDIDATE = [
    "map_id", "query_id", "match_id", "rhpd_distance", "sc_distance", "yaw", "source", "rhpd_rank",
    "sc_rank", "fused_score", "fused_rank",
]


def _primary(queries, base, top_k, preselect, keep, thr, sc_thr, veto, source, before_thr, weights=(1.0, 0.15)):
    hits = knn_two_stage(queries, base, top_k, preselect).select(
        "map_id", "query_id", "match_pos", F.col("distance").alias("rhpd_distance")
    )
    full = _named(_with_polar(hits, queries, base), base)
    ranked = rank_candidates(full, keep, thr, sc_thr, veto, *weights, rank_before_thr=before_thr)
    return ranked.withColumn("source", F.lit(source)).withColumn("sc_rank", F.lit(None).cast("int")).select(
        *CANDIDATE
    )


def _fallback_rows(hits, base):
    return _named(hits, base).select(
        "map_id", "query_id", "match_id", F.lit(None).cast("double").alias("rhpd_distance"),
        "sc_distance", (F.col("shift") * math.radians(6.0)).alias("yaw"), F.lit("polar").alias("source"),
        F.lit(None).cast("int").alias("rhpd_rank"), "sc_rank", F.col("sc_distance").alias("fused_score"),
        F.col("sc_rank").alias("fused_rank"),
    )


def _unanswered(asked, primary):
    """(primary candidates, written; the queries without any, or None if all have one)."""
    primary = materialize(primary)
    ids = asked.select("map_id", "query_id").join(primary.select("map_id", "query_id").distinct(), ["map_id", "query_id"], "left_anti")
    ids = materialize(ids)
    return primary, None if ids.isEmpty() else asked.join(ids, ["map_id", "query_id"], "left_semi")


def detect_loops(
    frames: DataFrame, queries=None, exclude_recent=50, keep=10, sc_keep=10, preselect=100, thr=25.0,
    sc_thr=0.2, veto=None, veto_scale=0.6,
) -> DataFrame:
    """Loop candidates of every frame (or of ``queries``, a subset of rows) against older frames.

    ``frames``: map_id, kf_id, pos, coarse, rhpd, ring_key, polar. Queries without a primary
    candidate fall back to the polar descriptor.
    """
    asked = loop_search_range(frames if queries is None else queries, exclude_recent)
    asked = asked.withColumn("query_id", F.col("pos"))
    usable = asked.filter(F.exists("rhpd", lambda v: v != 0))
    primary = _primary(
        usable, frames, max(keep * 3, sc_keep * 4), preselect, keep, thr, veto_scale, veto, "rhpd", False
    )
    primary, rest = _unanswered(asked, primary)
    if rest is not None:
        primary = primary.unionByName(_fallback_rows(knn_ring_key(rest, frames, 20, sc_keep, sc_thr), frames))
    ids = frames.select("map_id", F.col("pos").alias("query_id"), F.col("kf_id").alias("_kf"))
    return (
        primary
        .join(ids, ["map_id", "query_id"])
        .withColumn("query_id", F.col("_kf"))
        .drop("_kf")
    )


def polar_scan(queries: DataFrame, base: DataFrame, keep=10, thr=0.3) -> DataFrame:
    """Polar-only candidates against the whole map; only for queries without a primary hit.

    The distance has no metric bound, so every frame of the map is measured. Base frames go to
    the queries in blocks and only frames at or below ``thr`` leave the task.
    """
    blocks = base.groupBy("map_id").agg(F.max("pos").alias("_top"))
    size = 512
    q = (
        queries.join(blocks, ["map_id"])
        .withColumn(
            "b_block",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_top") / size).cast("long"))),
        )
        .withColumn("q_block", F.floor(F.col("query_id") / size))
        .select("map_id", "q_block", "b_block", "query_id", F.col("polar").alias("vec"))
    )
    need = fresh(q.select("map_id", "q_block", "b_block")).distinct()
    b = fresh(
        base.withColumn("b_block", F.floor(F.col("pos") / size))
        .select("map_id", "b_block", "pos", F.col("polar").alias("vec"))
        .join(need, ["map_id", "b_block"])
    )

    def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        cols, parts = ["map_id", "query_id", "match_pos", "sc_distance", "shift"], []
        frames, pos = list(bs["vec"]), bs["pos"].to_numpy()
        for q_id, qv in zip(qs["query_id"], qs["vec"]):
            d, k = _polar_kernel([qv] * len(frames), frames)
            near = d <= thr
            parts.append(pd.DataFrame({"query_id": q_id, "match_pos": pos[near], "sc_distance": d[near], "shift": k[near]}))
        if not parts:
            return pd.DataFrame([], columns=cols)
        return pd.concat(parts).assign(map_id=qs["map_id"].iloc[0] if len(qs) else None)[cols]

    on = ["map_id", "q_block", "b_block"]
    hits = q.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(
        run, "map_id long, query_id long, match_pos long, sc_distance double, shift int"
    )
    return _rank(hits, ["sc_distance", "match_pos"], "sc_rank").filter(F.col("sc_rank") < keep)


def near_polar(clouds: DataFrame, cells: DataFrame, reach=3, block=256) -> DataFrame:
    """Polar distance and shift of each cloud to those of the next ``reach`` ids of its map: map_id, a_id, b_id, distance, shift.

    ``clouds``: map_id, kf_id. ``cells``: their ``polar_cells``. Dense matrices exist in tasks only, for a block of ids
    and the few beyond it, so no row is wide and a task holds no more in a larger map.
    """
    at = [c for c in cells.columns if c not in ("map_id", "kf_id", "ring", "sector")]
    named = [F.col(c).cast("double").alias(c) for c in at]
    every = clouds.select("map_id", "kf_id", *(F.lit(-1).alias(c) for c in ("ring", "sector")), *(F.lit(0.0).alias(c) for c in at))
    every = every.unionByName(cells.select("map_id", "kf_id", "ring", "sector", *named))
    own = F.floor(F.col("kf_id") / block)
    blocks = F.array_distinct(F.array(own, F.floor((F.col("kf_id") - reach) / block)))
    # Only the first few ids of a block belong to the one before as well.
    rows = every.withColumn("block", F.explode(blocks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, where = np.unique(pdf["kf_id"].to_numpy(), return_inverse=True)
        ring, sector = pdf["ring"].to_numpy(), pdf["sector"].to_numpy()
        dense = np.zeros((len(ids), V.POLAR_CHANNELS, V.POLAR_RINGS, V.POLAR_SECTORS))
        some = ring >= 0
        dense[where[some], :, ring[some], sector[some]] = pdf[at].to_numpy()[some]
        dense = dense.reshape(len(ids), -1)
        pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, min(i + reach + 1, len(ids))) if ids[j] - ids[i] <= reach]
        pairs = [(i, j) for i, j in pairs if ids[i] // block == pdf["block"].iloc[0]]
        a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
        distance, shift = _polar_kernel([dense[i] for i in a], [dense[j] for j in b])
        return pd.DataFrame({"map_id": pdf["map_id"].iloc[0], "a_id": ids[a], "b_id": ids[b], "distance": distance, "shift": shift})

    return rows.groupBy("map_id", "block").applyInPandas(run, "map_id long, a_id long, b_id long, distance double, shift int")


def merge_frame_candidates(submap_hits: DataFrame, frame_hits: DataFrame, keep=10) -> DataFrame:
    """Union of both candidate lists, the lower score per match, ranked again."""
    both = submap_hits.unionByName(frame_hits)
    rest = [c for c in both.columns if c not in ("map_id", "query_id", "match_id")]
    best = both.groupBy("map_id", "query_id", "match_id").agg(
        F.min_by(F.struct(*rest), F.struct("fused_score", "rhpd_distance", "source")).alias("_r")
    )
    return _rank(
        best.select("map_id", "query_id", "match_id", "_r.*").drop("fused_rank"),
        ["fused_score", "rhpd_distance", "match_id"],
        "fused_rank",
    ).filter(F.col("fused_rank") < keep)


def reloc_candidates(
    queries: DataFrame, base: DataFrame, frame_base=None, keep=10, rhpd_keep=10, preselect=100, thr=25.0,
    sc_thr=0.3, veto=None, veto_scale=0.6,
) -> DataFrame:
    """Relocalization candidates of each query against its whole map.

    ``queries``: map_id, query_id, coarse, rhpd, polar. ``base`` holds submap-level vectors;
    ``frame_base``, if given, single-scan vectors whose hits are merged in.
    """
    asked = queries.withColumn("limit", F.lit(NO_LIMIT))
    usable = asked.filter(F.exists("rhpd", lambda v: v != 0))
    top = max(rhpd_keep * 3, keep * 3)
    primary = _primary(usable, base, top, preselect, keep, thr, veto_scale, veto, "rhpd", True)
    if frame_base is not None:
        top = max(keep * 2, rhpd_keep * 2)
        frame = _primary(
            usable, frame_base, top, max(preselect, top * 5), top, thr, veto_scale, veto, "rhpd_frame", True
        )
        primary = merge_frame_candidates(primary, frame, keep).select(*CANDIDATE)
    primary, rest = _unanswered(asked, primary)
    return primary if rest is None else primary.unionByName(_fallback_rows(polar_scan(rest, base, keep, sc_thr), base))


def classic_detect(frames: DataFrame, thr=0.13, k=10, exclude_recent=50) -> DataFrame:
    """Match of the newest frame of each map by the single-channel descriptor.

    ``frames``: map_id, kf_id, pos, ring_key, polar (single channel). Output has one row per map
    whose best partner lies below ``thr``.
    """
    newest = frames.groupBy("map_id").agg(F.max("pos").alias("pos"))
    asked = frames.join(newest, ["map_id", "pos"]).select(
        "map_id", F.col("pos").alias("query_id"), (F.col("pos") + 1 - exclude_recent).alias("limit"),
        "ring_key", "polar",
    )
    chosen = top_by_key(asked, frames, k, "ring_key")
    scored = score_pairs(
        chosen, asked, frames, "polar", _classic_kernel, [("sc_distance", "double"), ("shift", "int")]
    )
    best = _rank(scored, ["sc_distance", "match_pos"], "_r").filter("_r = 0").drop("_r")
    return _named(best.filter(F.col("sc_distance") < thr), frames)
