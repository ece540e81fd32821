"""Nearest neighbours: exact top-k over vectors in blocks, and nearest points through grid cells.

No form keeps the pairs it looks at. Clouds of at most POINTS_IN_TASK points meet whole in one task, so every
point is shuffled once; larger ones take the other forms. The block form compares a block of queries with a block
of base vectors inside one task and returns the best few per query; big keys are cut into many
blocks, so no task sees more than two blocks. The grid form joins on cell keys and feeds the rows
straight into a partial minimum; it starts with cells much smaller than the search distance and
widens only for points still without a partner.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.session import materialize

BLOCK = 8192
#: Points of a key that one task takes.
POINTS_IN_TASK = 400_000


def _chunks(vec, size):
    """Row ranges of compact chunks: vectors ordered by coarse cells of their first coordinates."""
    lead = vec[:, : min(3, vec.shape[1])]
    span = np.ptp(lead, axis=0).max() if len(vec) else 0.0
    cell = np.floor(lead / (span / 16 if span > 0 else 1.0))
    order = np.lexsort(cell.T[::-1])
    return [order[i : i + size] for i in range(0, len(order), size)]


def nearest_in_block(q, limit, b, b_pos, k, size=256, fan=16, bound=np.inf):
    """Exact k nearest rows of ``b`` per row of ``q`` by (distance, position).

    ``limit`` bounds the position (exclusive) per query, ``bound`` the squared distance. Chunks that cannot hold a closer vector
    by the triangle inequality are skipped. Returns query rows, base rows, squared distances.
    """
    parts = _chunks(b, size)
    centers = np.stack([b[p].mean(0) for p in parts])
    radii = np.array([np.sqrt(((b[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centers)])
    b_norm = (b * b).sum(1)
    out_q, out_b, out_d = [], [], []
    for rows in _chunks(q, size):
        qv, ql = q[rows], limit[rows]
        qc = qv.mean(0)
        q_rad = np.sqrt(((qv - qc) ** 2).sum(1).max())
        low = np.maximum(0.0, np.sqrt(((centers - qc) ** 2).sum(1)) - radii - q_rad)
        visit = np.argsort(low, kind="stable")
        q_norm = (qv * qv).sum(1)
        best = (np.empty(0, int), np.empty(0, int), np.empty(0))
        kth = np.full(len(rows), bound)
        for i in range(0, len(visit), fan):
            group = visit[i : i + fan]
            if low[group[0]] ** 2 > kth.max() * (1 + 1e-9) + 1e-12:
                break
            cols = np.concatenate([parts[g] for g in group])
            if q.shape[1] <= 8:
                rough = sum((qv[:, None, i] - b[cols][None, :, i]) ** 2 for i in range(q.shape[1]))
            else:
                rough = q_norm[:, None] + b_norm[cols][None, :] - 2.0 * (qv @ b[cols].T)
            rough[b_pos[cols][None, :] >= ql[:, None]] = np.inf
            # Rounding of the expanded form; candidates within it are measured again exactly.
            slack = 1e-11 * (q_norm + b_norm[cols].max()) + 1e-300
            if len(cols) > k:
                cut = np.minimum(np.partition(rough, k - 1, axis=1)[:, k - 1], kth)
            else:
                cut = kth
            hit = np.isfinite(rough) & (rough <= (cut + 2 * slack)[:, None])
            qi, ci = np.nonzero(hit)
            bi = cols[ci]
            d = np.concatenate(
                [((qv[qi[s : s + 65536]] - b[bi[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(qi), 65536)]
                or [np.empty(0)]
            )
            qi, bi, d = (np.concatenate(p) for p in zip(best, (qi, bi, d)))
            order = np.lexsort((b_pos[bi], d, qi))
            qi, bi, d = qi[order], bi[order], d[order]
            first = np.searchsorted(qi, qi, side="left")
            rank = np.arange(len(qi)) - first
            keep = rank < k
            qi, bi, d, rank = qi[keep], bi[keep], d[keep], rank[keep]
            best = (qi, bi, d)
            full = rank == k - 1
            kth[qi[full]] = d[full]
        out_q.append(rows[best[0]])
        out_b.append(best[1])
        out_d.append(best[2])
    return np.concatenate(out_q), np.concatenate(out_b), np.concatenate(out_d)


def _cell_size(b, k):
    """Edge of cells that hold a few points each, at most 2^20 cells along an axis."""
    span = float(np.ptp(b, axis=0).max()) or 1.0
    size, least = span, span / (1 << 20)
    while size > least:
        filled = len(np.unique(np.floor((b - b.min(0)) / size).astype(np.int64) @ np.array([1 << 42, 1 << 21, 1])))
        if len(b) <= filled * max(2.0, k / 2.5):
            break
        size /= 1.5
    return max(size, least)


def cells_of(b, k):
    """The cells of ``nearest_in_cells``, for searches that share their points: low corner, edge, counts, sorted keys, rows."""
    low, size = b.min(0), _cell_size(b, k)
    cell = np.floor((b - low) / size).astype(np.int64)
    n = cell.max(0) + 1
    key = (cell[:, 0] * n[1] + cell[:, 1]) * n[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    return low, size, n, key[order], order


def nearest_in_cells(q, b, k, bound=np.inf, chunk=4096, cells=None):
    """Exact k nearest points of ``b`` per point of ``q`` (three coordinates) by (squared distance, row).

    Points lie in cells sorted by (x, y, z), so a column of cells is one run of rows. A query looks at the cells
    around its own; it is done when its k-th distance is within them, the others look twice as far.
    ``bound`` limits the squared distance. Returns query rows, base rows, squared distances.
    """
    (low, size, n, key, order), out = cells or cells_of(b, k), []
    for at in range(0, len(q), chunk):
        rows, reach = np.arange(at, min(at + chunk, len(q))), 1
        while len(rows):
            if len(rows) * reach > chunk:  # wider looks take fewer queries at once
                parts = np.array_split(rows, -(-len(rows) * reach // chunk))
            else:
                parts = [rows]
            late = []
            for part in parts:
                hit, done = _look(q[part], b, low, size, n, key, order, k, bound, reach)
                qi, bi, d2 = hit
                keep = done[qi]
                out.append((part[qi[keep]], bi[keep], d2[keep]))
                late.append(part[~done])
            rows, reach = np.concatenate(late), reach * 2
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _look(q, b, low, size, n, key, order, k, bound, reach):
    """One look of ``nearest_in_cells``: the k nearest within ``reach`` cells, and which queries are done."""
    own = np.clip(np.floor((q - low) / size), -(2**40), 2**40).astype(np.int64)
    first, last = np.maximum(own - reach, 0), np.minimum(own + reach, n - 1)
    column = np.arange(-reach, reach + 1)
    x, y = (c.ravel() for c in np.meshgrid(column, column, indexing="ij"))
    cx, cy = own[:, :1] + x, own[:, 1:2] + y
    inside = (cx >= 0) & (cx < n[0]) & (cy >= 0) & (cy < n[1]) & (first[:, 2:] <= last[:, 2:])
    row, col = np.nonzero(inside)
    base = (cx[row, col] * n[1] + cy[row, col]) * n[2]
    start = np.searchsorted(key, base + first[row, 2], "left")
    many = np.searchsorted(key, base + last[row, 2], "right") - start
    qi = np.repeat(row, many)
    bi = order[np.repeat(start - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
    d2 = ((q[qi] - b[bi]) ** 2).sum(1)
    near = d2 <= bound
    most = np.bincount(qi, minlength=1).max()
    if k < most and most * len(q) < 1 << 23:
        # The k-th distance of each query first; only what is within it is ordered.
        table = np.full((len(q), most), np.inf)
        table[qi, np.arange(len(qi)) - np.searchsorted(qi, qi, "left")] = d2
        near &= d2 <= np.partition(table, k - 1, axis=1)[qi, k - 1]
    qi, bi, d2 = qi[near], bi[near], d2[near]
    rank = np.lexsort((bi, d2, qi))
    qi, bi, d2 = qi[rank], bi[rank], d2[rank]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
    keep = place < k
    kth = np.full(len(q), np.inf)
    full = place == k - 1
    kth[qi[full]] = d2[full]
    seen = (reach * size) ** 2
    whole = ((own - reach <= 0) & (own + reach >= n - 1)).all(1)
    return (qi[keep], bi[keep], d2[keep]), (kth <= seen) | (bound <= seen) | whole


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for grouping a table with a relative of it."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def block_top_k(queries: DataFrame, base: DataFrame, keys, k: int) -> DataFrame:
    """k nearest base vectors per query.

    ``queries``: keys, q_id, q_block, b_blocks (array of base blocks to visit), limit, vec.
    ``base``: keys, b_id, b_block, vec. Positions ``b_id`` break ties, lowest first.
    Output: keys, q_id, b_id, d2, rank (from 0).
    """
    types = dict(queries.dtypes)
    key_ddl = ", ".join(f"{c} {types[c]}" for c in keys)
    q = queries.select(
        *keys, "q_id", "q_block", F.explode("b_blocks").alias("b_block"), "limit", "vec"
    )
    need = fresh(q.select(*keys, "q_block", "b_block")).distinct()
    b = fresh(base.select(*keys, "b_id", "b_block", "vec").join(need, [*keys, "b_block"]))
    on = [*keys, "q_block", "b_block"]

    def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "q_id", "b_id", "d2"]
        if qs.empty or bs.empty:
            return pd.DataFrame({c: [] for c in cols})
        bs = bs.sort_values("b_id", kind="stable")
        b_pos = bs["b_id"].to_numpy()
        qi, bi, d2 = nearest_in_block(
            np.stack(qs["vec"].to_numpy()), qs["limit"].to_numpy(), np.stack(bs["vec"].to_numpy()),
            b_pos, k,
        )
        out = {c: np.repeat(qs[c].iloc[0], len(qi)) for c in keys}
        return pd.DataFrame({**out, "q_id": qs["q_id"].to_numpy()[qi], "b_id": b_pos[bi], "d2": d2})

    # Little data, much work: a given number of partitions is not merged by their size.
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = (
        q.repartition(width, *on).groupBy(*on)
        .cogroup(b.repartition(width, *on).groupBy(*on))
        .applyInPandas(run, f"{key_ddl}, q_id long, b_id long, d2 double")
    )
    w = Window.partitionBy(*keys, "q_id").orderBy("d2", "b_id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def self_top_k(points: DataFrame, keys, k: int, block=BLOCK) -> DataFrame:
    """k nearest points of the same key for every point, itself included.

    ``points``: keys, pt, vec. Keys above ``block`` points are split into blocks by hash.
    """
    blocks = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_nb"))
    rows = points.join(blocks, list(keys)).withColumn("b_block", F.pmod(F.xxhash64("pt"), F.col("_nb")))
    queries = rows.select(
        *keys,
        F.col("pt").alias("q_id"),
        F.col("b_block").alias("q_block"),
        F.sequence(F.lit(0).cast("long"), F.col("_nb").cast("long") - 1).alias("b_blocks"),
        F.lit(2**62).alias("limit"),
        "vec",
    )
    return block_top_k(queries, rows.withColumnRenamed("pt", "b_id"), keys, k)


def large_keys(points: DataFrame, keys, limit=None) -> DataFrame:
    """Keys of more points than a task takes."""
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > (limit or POINTS_IN_TASK)).select(*keys)


def split_large(frames, keys, limit=None):
    """(small, large): the frames without and with the keys that are too large for a task; large is None if there are none."""
    ids = [f.select(*keys) for f in frames]
    both = ids[0]
    for i in ids[1:]:
        both = both.unionByName(i)
    large = large_keys(both, keys, limit)
    if large.isEmpty():
        return frames, None
    large = materialize(large)
    return [f.join(large, keys, "left_anti") for f in frames], [f.join(large, keys, "left_semi") for f in frames]


def finite_rows(pdf: pd.DataFrame, order: str) -> pd.DataFrame:
    """Rows with a position, in the order of their ids."""
    return pdf[np.isfinite(pdf[["x", "y", "z"]].to_numpy(float)).all(1)].sort_values(order, kind="stable")


def nearest_in_tasks(src: DataFrame, tgt: DataFrame, keys, max_dist: float, carry=()) -> DataFrame:
    """``nearest_in_grid`` for clouds that fit a task: both meet there and only the hits leave it."""
    src, tgt = src.select(*keys, "src_id", "x", "y", "z"), fresh(tgt.select(*keys, "tgt_id", "x", "y", "z", *carry))
    types, given = dict(src.dtypes), dict(tgt.dtypes)
    ddl = [f"`{c}` {types[c]}" for c in src.columns] + ["_d2 double"] + [f"`_{c}` {given[c]}" for c in ("tgt_id", "x", "y", "z", *carry)]
    kept, brought = list(src.columns), ["tgt_id", "x", "y", "z", *carry]
    names = [*kept, "_d2", *(f"_{c}" for c in brought)]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = finite_rows(a, "src_id"), finite_rows(b, "tgt_id")
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in names})
        q, p = a[["x", "y", "z"]].to_numpy(float), b[["x", "y", "z"]].to_numpy(float)
        rows, near, d2 = nearest_of_few(q, p, max_dist * max_dist) or nearest_in_cells(q, p, 1, max_dist * max_dist)
        out = {c: a[c].to_numpy()[rows] for c in kept}
        return pd.DataFrame({**out, "_d2": d2, **{f"_{c}": b[c].to_numpy()[near] for c in brought}})

    known = [d.dropna(subset=keys) for d in (src, tgt)]
    found = known[0].groupBy(*keys).cogroup(known[1].groupBy(*keys)).applyInPandas(run, ", ".join(ddl))
    hit = F.struct(F.col("_d2").alias("d2"), *(F.col(f"_{c}").alias(c) for c in brought))
    return found.select(*kept, hit.alias("hit"))


def _distance_parts(q, b, most=1 << 15):
    """(first row, distances, slack) of runs of ``q`` to all of ``b``, three coordinates; a run stays in the cache.

    Distances are squared, less the square of the query's own length, from one matrix product; two that differ by more
    than ``slack`` are in their true order.
    """
    middle = b.mean(0)
    q, b = np.hstack([q - middle, np.ones((len(q), 1))]), b - middle
    length = (b * b).sum(1)
    axes = np.vstack([-2.0 * b.T, length])
    slack = 1e-14 * (float((q * q).sum(1).max(initial=0.0)) + float(length.max()))
    step = max(1, most // max(1, len(b)))
    buffer = np.empty((step, len(b)))
    for at in range(0, len(q), step):
        yield at, np.matmul(q[at : at + step], axes, out=buffer[: min(step, len(q) - at)]), slack


def nearest_k_of_few(q, b, k, most=1 << 20):
    """Rows of the k nearest points of ``b`` (all, if fewer) per point of ``q``, or None where the distances are too many.

    Of equal distances the lower row is nearer, as in ``nearest_in_cells``.
    """
    if len(q) * len(b) > most:
        return None
    k = min(k, len(b))
    out = np.empty((len(q), k), int)
    for at, d2, slack in _distance_parts(q, b):
        within = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k] + slack
        # Where more than k may lie within the k-th distance, they are measured exactly and the lower rows are kept.
        for i in np.flatnonzero(np.count_nonzero(within, axis=1) > k):
            near = np.flatnonzero(within[i])
            within[i] = False
            within[i, near[np.lexsort((near, ((q[at + i] - b[near]) ** 2).sum(1)))[:k]]] = True
        out[at : at + len(d2)] = (np.flatnonzero(within) % len(b)).reshape(-1, k)
    return out


def nearest_two_of_few(q, b, most=1 << 20):
    """(nearest row of ``b``, its squared distance, a lower bound of that of the second nearest) per point of ``q``, or None where the distances are too many."""
    if len(q) * len(b) > most:
        return None
    near, second, ends = np.empty(len(q), int), np.full(len(q), np.inf), []
    for at, d2, slack in _distance_parts(q, b):
        part, rows = d2.argmin(1), np.arange(len(d2))
        least = d2[rows, part]
        d2[rows, part] = np.inf
        far = d2.min(1)
        near[at : at + len(d2)], second[at : at + len(d2)] = part, far - slack
        ends += [at + i for i in np.flatnonzero(far - least <= slack)]
    second += ((q - b.mean(0)) ** 2).sum(1)
    # Where two are about as near, both are measured exactly and the lower row of equal ones is kept.
    for i in ends:
        exact = ((q[i] - b) ** 2).sum(1)
        near[i] = exact.argmin()
        second[i] = exact[near[i]]
    return near, ((q - b[near]) ** 2).sum(1), np.maximum(second, 0.0)


def nearest_of_few(q, b, bound, most=1 << 20):
    """Nearest point of ``b`` within ``bound`` per point of ``q`` by all distances, or None where these are too many."""
    found = nearest_two_of_few(q, b, most)
    if found is None:
        return None
    near, least, _ = found
    rows = np.flatnonzero(least <= bound)
    return rows, near[rows], least[rows]


def _cells(size, prefix="c"):
    return {f"{prefix}{c}": F.floor(F.col(c) / F.lit(size)) for c in "xyz"}


def nearest_in_grid(src: DataFrame, tgt: DataFrame, keys, max_dist: float, levels=(8, 1),
                    carry=()) -> DataFrame:
    """Nearest target point of each source point of the same key, within ``max_dist``.

    ``src``: keys, src_id, x, y, z. ``tgt``: keys, tgt_id, x, y, z and the columns ``carry``.
    Output: keys, src_id, x, y, z, hit (struct d2, tgt_id, x, y, z, carry...). Copies of one target
    position count once, under the lowest id. Each level searches cells of ``max_dist / level``;
    a partner found within one cell width is final, because every closer point lies in the 27
    cells looked at. Points without one go to the next level. That sends each point to 27 cells a level, so
    only clouds that are too large for a task are searched like this.
    """
    keys = list(keys)
    (src, tgt), large = split_large([src, tgt], keys)
    found = nearest_in_tasks(src, tgt, keys, max_dist, carry)
    if large is None:
        return found
    return found.unionByName(_nearest_over_cells(*large, keys, max_dist, levels, carry))


def _nearest_over_cells(src, tgt, keys, max_dist, levels, carry):
    steps = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    extra = [F.first(c).alias(c) for c in carry]
    uniq = tgt.groupBy(*keys, "x", "y", "z").agg(F.min("tgt_id").alias("tgt_id"), *extra)
    open_src, found = src.select(*keys, "src_id", "x", "y", "z"), None
    for i, level in enumerate(levels):
        size = max_dist / level
        last = i == len(levels) - 1
        cell = [*keys, "cx", "cy", "cz"]
        a = open_src.withColumns(_cells(size))
        for c in "xyz":
            a = a.withColumn("_s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_s"))
        b = uniq.withColumns(_cells(size)).select(
            *cell, F.struct("tgt_id", "x", "y", "z", *carry).alias("_t")
        )
        d2 = sum(((F.col(c) - F.col(f"_t.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        hit = F.struct(d2.alias("d2"), "_t.*")
        best = (
            a.drop("_s")
            .join(b, cell)
            .filter(d2 <= size * size)
            .groupBy(*keys, "src_id")
            .agg(F.min_by(hit, F.struct(d2, "_t.tgt_id")).alias("hit"))
        )
        joined = open_src.join(best, [*keys, "src_id"], "inner" if last else "left")
        if not last:
            # Read twice below; written so that the search is not repeated.
            joined = materialize(joined)
        done = joined.filter(F.col("hit").isNotNull())
        found = done if found is None else found.unionByName(done)
        if not last:
            open_src = joined.filter(F.col("hit").isNull()).drop("hit")
    return found


def nearest_by_position(queries: DataFrame, keyframes: DataFrame, radius=None, block=BLOCK) -> DataFrame:
    """Nearest keyframe in space; strictly within ``radius`` if one is given.

    ``queries``: map_id, query_id, x, y, z. ``keyframes``: map_id, kf_id, opt.
    Output: map_id, query_id, kf_id, distance.
    """
    spots = keyframes.select(
        "map_id", F.col("kf_id").alias("tgt_id"), *(F.col(f"opt.t{c}").alias(c) for c in "xyz")
    )
    if radius is not None:
        src = queries.select("map_id", F.col("query_id").alias("src_id"), "x", "y", "z")
        hits = nearest_in_grid(src, spots, ["map_id"], radius)
        return hits.filter(F.col("hit.d2") < radius * radius).select(
            "map_id",
            F.col("src_id").alias("query_id"),
            F.col("hit.tgt_id").alias("kf_id"),
            F.sqrt("hit.d2").alias("distance"),
        )
    size = spots.groupBy("map_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_nb"))
    vec = F.array("x", "y", "z").alias("vec")
    base = spots.join(size, ["map_id"]).select(
        "map_id", F.col("tgt_id").alias("b_id"), F.pmod(F.xxhash64("tgt_id"), F.col("_nb")).alias("b_block"), vec
    )
    q_size = queries.groupBy("map_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_nq"))
    q = queries.join(size, ["map_id"]).join(q_size, ["map_id"]).select(
        "map_id",
        F.col("query_id").alias("q_id"),
        F.pmod(F.xxhash64("query_id"), F.col("_nq")).alias("q_block"),
        F.sequence(F.lit(0).cast("long"), F.col("_nb").cast("long") - 1).alias("b_blocks"),
        F.lit(2**62).alias("limit"),
        vec,
    )
    return block_top_k(q, base, ["map_id"], 1).select(
        "map_id", F.col("q_id").alias("query_id"), F.col("b_id").alias("kf_id"),
        F.sqrt("d2").alias("distance"),
    )


def grid_levels(max_dist: float, leaf: float):
    """Cell divisors for targets thinned to ``leaf``: start near twice the spacing, then widen."""
    top = max(1, int(max_dist / max(2 * leaf, 1e-6)))
    levels, level = [], top
    while level > 1:
        levels.append(level)
        level = math.floor(level / 4)
    return (*levels, 1)
