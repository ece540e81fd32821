"""Scan registration of many pairs at once.

Pairs of clouds that fit a task are thinned and registered there (``scanmatch``). For larger clouds each round is one set-wise job over all
unconverged pairs: move the source points, find their partners through grid cells, sum the normal
equations per pair, solve, update the pair table; the driver only asks whether any pair is still active.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.pose import (
    identity_pose,
    make_pose,
    pose_between,
    pose_compose,
    rotation_angle,
    transform_xyz,
    translation_norm,
    yaw_pose,
)
from lidarlake.functions.predicates import voxel_coord_in_range
from lidarlake.functions.scores import yaw_seeds
from lidarlake.operators.clouds import voxel_centroid
from lidarlake.operators.neighbors import finite_rows, grid_levels, nearest_in_grid, self_top_k, split_large
from lidarlake.operators.scanmatch import MIN_POINTS, Stages, align_in_tasks, covariances, gathered, thinned, too_large
from lidarlake.session import materialize

UPPER = [(i, j) for i in range(6) for j in range(i, 6)]


def correspondences(src: DataFrame, tgt: DataFrame, max_dist: float, carry=(), leaf=None) -> DataFrame:
    """Nearest target point within ``max_dist`` for each source point of the same pair.

    ``src``: pair_id, src_id, x, y, z (already moved). ``tgt``: pair_id, tgt_id, x, y, z.
    Output: pair_id, src_id, x, y, z, hit (d2, tgt_id, x, y, z, carried columns).
    """
    levels = grid_levels(max_dist, leaf) if leaf else (8, 1)
    return nearest_in_grid(src, tgt, ["pair_id"], max_dist, levels, carry)


def normals_covariances(points: DataFrame, k=20, keys=("pair_id",), pt="tgt_id") -> DataFrame:
    """Covariance and surface normal of each point from its ``k`` nearest neighbours.

    Adds cov (xx, xy, xz, yy, yz, zz) and nx, ny, nz. The normal is the eigenvector of the least
    eigenvalue; its sign is free and carries no meaning.
    """
    keys = list(keys)
    (points,), large = split_large([points], keys)
    found = _covariances_in_tasks(points, k, keys, pt)
    if large is None:
        return found
    return found.unionByName(_covariances_over_blocks(*large, k, keys, pt))


def _covariances_in_tasks(points, k, keys, pt):
    """The same for clouds that fit a task: their points are shuffled once and no pair leaves the task."""
    spots = points.select(*keys, pt, "x", "y", "z")
    types = dict(spots.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in spots.columns) + ", cov array<double>, nx double, ny double, nz double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = finite_rows(pdf, pt).reset_index(drop=True)
        if pdf.empty:
            return pdf.assign(cov=[], nx=[], ny=[], nz=[])
        cov = covariances(pdf[["x", "y", "z"]].to_numpy(float), k)
        axis = np.linalg.eigh(cov)[1][:, :, 0]
        packed = cov.reshape(-1, 9)[:, [0, 1, 2, 4, 5, 8]]
        return pdf.assign(cov=list(packed), nx=axis[:, 0], ny=axis[:, 1], nz=axis[:, 2])

    found = spots.dropna(subset=keys).groupBy(*keys).applyInPandas(run, ddl)
    if set(points.columns) == set(spots.columns):
        return found.select(*points.columns, "cov", "nx", "ny", "nz")
    # Joined again only for what else the points carry.
    return points.join(found.drop("x", "y", "z"), [*keys, pt]).select(*points.columns, "cov", "nx", "ny", "nz")


def _covariances_over_blocks(points, k, keys, pt):
    vec = F.array("x", "y", "z")
    near = self_top_k(points.select(*keys, F.col(pt).alias("pt"), vec.alias("vec")), keys, k)
    spots = points.select(*keys, F.col(pt).alias("b_id"), "x", "y", "z")
    cov = [F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    stats = near.join(spots, [*keys, "b_id"]).groupBy(*keys, F.col("q_id").alias(pt)).agg(*cov)
    packed = F.array("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    return points.join(
        stats.select(*keys, pt, packed.alias("cov"), _least_axis(packed).alias("_n")), [*keys, pt]
    ).select(*points.columns, "cov", "_n.*")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz")]))
def _least_axis(cov: pd.Series) -> pd.DataFrame:
    c = np.stack(cov.to_numpy())
    m = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    return pd.DataFrame(np.linalg.eigh(m)[1][:, :, 0], columns=["nx", "ny", "nz"])


def normal_equations(pairs_of_points: DataFrame) -> DataFrame:
    """Point-to-plane sums per pair, inside code generation.

    Input: pair_id, x, y, z (moved source) and hit with x, y, z, nx, ny, nz. Output: pair_id,
    h (21, upper triangle, translation before rotation), b (6), error, inliers.
    """
    h = F.col("hit")
    p = [F.col(c) for c in "xyz"]
    n = [h[f"n{c}"] for c in "xyz"]
    res = sum((n[i] * (p[i] - h["xyz"[i]]) for i in range(3)), F.lit(0.0))
    turn = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0]]
    terms = pairs_of_points.select(
        "pair_id", res.alias("r"), *(c.alias(f"j{i}") for i, c in enumerate([*n, *turn]))
    )
    sums = terms.groupBy("pair_id").agg(
        *(F.sum(F.col(f"j{i}") * F.col(f"j{j}")).alias(f"h{i}{j}") for i, j in UPPER),
        *(F.sum(F.col(f"j{i}") * F.col("r")).alias(f"b{i}") for i in range(6)),
        F.sum(F.col("r") * F.col("r") * 0.5).alias("error"),
        F.count(F.lit(1)).alias("inliers"),
    )
    return sums.select(
        "pair_id",
        F.array(*(f"h{i}{j}" for i, j in UPPER)).alias("h"),
        F.array(*(f"b{i}" for i in range(6))).alias("b"),
        "error",
        "inliers",
    )


def _gicp_partial(batches):
    """Sums per pair and batch of the plane-to-plane error; covariances follow from the normals."""
    for pdf in batches:
        if pdf.empty:
            continue
        p, q = pdf[["x", "y", "z"]].to_numpy(), pdf[["qx", "qy", "qz"]].to_numpy()
        m, n = pdf[["mx", "my", "mz"]].to_numpy(), pdf[["nx", "ny", "nz"]].to_numpy()
        # A surface patch is flat along its normal: variance 1e-3 there, 1 across.
        flat = 1.0 - 1e-3
        c = 2.0 * np.eye(3) - flat * (n[:, :, None] * n[:, None, :] + m[:, :, None] * m[:, None, :])
        w = np.linalg.inv(c)
        e = p - q
        j = np.zeros((len(p), 3, 6))
        j[:, :, :3] = np.eye(3)
        j[:, 0, 4], j[:, 0, 5] = p[:, 2], -p[:, 1]
        j[:, 1, 3], j[:, 1, 5] = -p[:, 2], p[:, 0]
        j[:, 2, 3], j[:, 2, 4] = p[:, 1], -p[:, 0]
        jw = np.einsum("nki,nkl->nil", j, w)
        hess = np.einsum("nik,nkj->nij", jw, j)
        grad = np.einsum("nik,nk->ni", jw, e)
        err = 0.5 * np.einsum("nk,nkl,nl->n", e, w, e)
        cols = {f"h{a}{b}": hess[:, a, b] for a, b in UPPER}
        cols |= {f"b{a}": grad[:, a] for a in range(6)}
        out = pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy(), **cols, "error": err, "inliers": 1})
        yield out.groupby("pair_id", as_index=False).sum()


def plane_to_plane_equations(pairs_of_points: DataFrame) -> DataFrame:
    """Like ``normal_equations`` for two surfaces; needs source normals mx, my, mz (turned)."""
    names = [f"h{i}{j}" for i, j in UPPER] + [f"b{i}" for i in range(6)] + ["error"]
    ddl = "pair_id long, " + ", ".join(f"{n} double" for n in names) + ", inliers long"
    flat = pairs_of_points.select(
        "pair_id", "x", "y", "z", "mx", "my", "mz",
        *(F.col(f"hit.{c}").alias(f"q{c}") for c in "xyz"), "hit.nx", "hit.ny", "hit.nz",
    )
    sums = flat.mapInPandas(_gicp_partial, ddl).groupBy("pair_id").agg(
        *(F.sum(n).alias(n) for n in [*names, "inliers"])
    )
    return sums.select(
        "pair_id",
        F.array(*(f"h{i}{j}" for i, j in UPPER)).alias("h"),
        F.array(*(f"b{i}" for i in range(6))).alias("b"),
        "error",
        "inliers",
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(h: pd.Series, b: pd.Series) -> pd.Series:
    """Step of each pair; directions the data does not constrain stay put."""
    if h.empty:
        return pd.Series([], dtype=object)
    values, m = np.stack(h.to_numpy()), np.zeros((len(h), 6, 6))
    for k, (i, j) in enumerate(UPPER):
        m[:, i, j] = m[:, j, i] = values[:, k]
    inverse = np.linalg.pinv(m, rcond=1e-10, hermitian=True)
    return pd.Series(list(np.einsum("nij,nj->ni", inverse, -np.stack(b.to_numpy()))))


def step_pose(x):
    """Pose of a small step: three translations, then a rotation vector."""
    v = [F.get(x, F.lit(i)) for i in range(6)]
    angle = F.sqrt(v[3] * v[3] + v[4] * v[4] + v[5] * v[5])
    k = F.when(angle > 1e-12, F.try_divide(F.sin(angle / 2), angle)).otherwise(0.5)
    return make_pose(v[0], v[1], v[2], k * v[3], k * v[4], k * v[5], F.cos(angle / 2))


def match_quality(sums: DataFrame, source_counts: DataFrame, thr=0.3, min_inlier=0.03) -> DataFrame:
    """Fitness, inlier ratio and success of each pair; no inliers leaves the fitness NULL."""
    fitness = F.try_divide("error", "inliers")
    ratio = F.coalesce(F.try_divide("inliers", "n_source"), F.lit(0.0))
    good = F.col("converged") & (F.col("fitness") < thr) & (F.col("inlier_ratio") >= min_inlier)
    return (
        sums.join(source_counts, ["pair_id"], "left")
        .withColumn("fitness", fitness)
        .withColumn("inlier_ratio", ratio)
        .withColumn("success", F.coalesce(good, F.lit(False)))
    )


def _thin(points: DataFrame, leaf: float, name: str) -> DataFrame:
    """One mean point per cell, written, with an id that follows the order of the cells in a task.

    Only points whose cell index does not fit a long are left out; no length is that large.
    """
    safe = points.filter(voxel_coord_in_range("x", "y", "z", leaf, bits=62))
    cells = voxel_centroid(
        safe.select("pair_id", "x", "y", "z", F.lit(0.0).alias("intensity")), leaf, ["pair_id"]
    ).sortWithinPartitions("pair_id", "vx", "vy", "vz")
    return materialize(cells.select("pair_id", F.monotonically_increasing_id().alias(name), "x", "y", "z"))


def _align(pairs, source, target, stages, k):
    """Registration of all pairs through ``stages``: (leaf, max_dist, rounds, kind), coarse to fine.

    ``pairs``: pair_id, T and, where several share their clouds, cloud_id; ``source`` and ``target``
    carry cloud_id, else pair_id. Returns pair_id, T, converged, error, inliers, h, n_source, or no row
    for pairs with fewer than ten points on either side. The pass ``Stages.fine`` is run, as fine_T and so on, where
    the clouds fit a task; pairs of larger ones are marked by ``far``.
    """
    pairs, source, target = (d if "cloud_id" in d.columns else d.withColumn("cloud_id", F.col("pair_id")) for d in (pairs, source, target))
    pairs = pairs.select("pair_id", "cloud_id", "T")
    source, target = (d.select("cloud_id", "x", "y", "z") for d in (source, target))
    points = gathered(source, target)
    wide = too_large(points)
    if wide.isEmpty():
        return materialize(align_in_tasks(pairs, points, stages, k).withColumn("far", F.lit(False)))
    wide = materialize(wide.join(pairs.select("cloud_id").distinct(), "cloud_id", "left_semi"))
    near = align_in_tasks(pairs.join(wide, "cloud_id", "left_anti"), points.join(wide, "cloud_id", "left_anti"), stages, k).withColumn("far", F.lit(False))
    pairs, source, target = (d.join(wide, "cloud_id", "left_semi") for d in (pairs, source, target))
    thin = thinned(source, target, [s[0] for s in stages])
    large = materialize(too_large(thin))
    thin_near = align_in_tasks(pairs.join(large, "cloud_id", "left_anti"), thin.join(large, "cloud_id", "left_anti"), list(stages), k)
    state = near.unionByName(thin_near.withColumn("far", F.lit(True)))
    if large.isEmpty():
        return materialize(state)
    far = materialize(pairs.join(large, "cloud_id"))
    link = far.select("pair_id", "cloud_id")
    rounds = far.select("pair_id", "T")
    clouds = [d.join(link, "cloud_id").drop("cloud_id") for d in (source, target)]
    for stage in stages:
        rounds = _align_over_tables(rounds.select("pair_id", "T"), *clouds, *stage, k)
    return materialize(state.unionByName(rounds.withColumn("far", F.lit(True)), allowMissingColumns=True))


def _align_over_tables(pairs, source, target, leaf, max_dist, rounds, kind, k, eps_t=1e-3, eps_r=math.radians(1.0)):
    """Rounds of registration at one resolution, each over the tables of all pairs.

    ``pairs``: pair_id, T. Returns pair_id, T, converged, error, inliers, h, n_source, or no row
    for pairs with fewer than ten points on either side.
    """
    src = _thin(source.join(pairs.select("pair_id"), "pair_id", "left_semi"), leaf, "src_id")
    tgt = _thin(target.join(pairs.select("pair_id"), "pair_id", "left_semi"), leaf, "tgt_id")
    tgt = materialize(normals_covariances(tgt, k).drop("cov"))
    if kind == "gicp":
        src = materialize(
            normals_covariances(src, k, pt="src_id").drop("cov").withColumnsRenamed(
                {"nx": "mx", "ny": "my", "nz": "mz"}
            )
        )
    n_src = src.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_source"))
    n_tgt = tgt.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"))
    enough = n_src.join(n_tgt, "pair_id").filter(
        (F.col("n_source") >= MIN_POINTS) & (F.col("_n") >= MIN_POINTS)
    ).drop("_n")
    state = materialize(
        pairs.select("pair_id", "T").join(enough, "pair_id").select(
            "pair_id", "T", "n_source", F.lit(False).alias("converged"), F.lit(True).alias("active"),
            F.lit(0.0).alias("error"), F.lit(0).cast("long").alias("inliers"),
            F.lit(None).cast("array<double>").alias("h"),
        )
    )
    for _ in range(rounds):
        live = state.filter("active").select("pair_id", "T")
        if live.isEmpty():
            break
        x, y, z = transform_xyz("T", "x", "y", "z")
        moved = src.join(live, "pair_id").withColumn("_p", F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
        if kind == "gicp":
            zero = make_pose(0.0, 0.0, 0.0, *(F.col(f"T.q{c}") for c in "xyzw"))
            m = transform_xyz(zero, "mx", "my", "mz")
            moved = moved.withColumn("_m", F.struct(*(c.alias(f"m{a}") for c, a in zip(m, "xyz"))))
        spots = moved.select("pair_id", "src_id", "_p.*")
        hits = correspondences(spots, tgt, max_dist, ("nx", "ny", "nz"), leaf)
        if kind == "gicp":
            hits = hits.join(moved.select("pair_id", "src_id", "_m.*"), ["pair_id", "src_id"])
            sums = plane_to_plane_equations(hits)
        else:
            sums = normal_equations(hits)
        steps = sums.withColumn("_x", _solve("h", "b")).withColumn("_s", step_pose(F.col("_x")))
        done = (translation_norm("_s") < eps_t) & (rotation_angle("_s") < eps_r)
        new = live.join(steps, "pair_id", "left").select(
            "pair_id",
            F.when(F.col("_s").isNotNull(), pose_compose("_s", "T")).otherwise(F.col("T")).alias("_T"),
            F.coalesce(done, F.lit(False)).alias("_done"),
            F.col("_s").isNotNull().alias("_moved"),
            F.coalesce("error", F.lit(0.0)).alias("_e"),
            F.coalesce("inliers", F.lit(0)).cast("long").alias("_i"),
            F.col("h").alias("_h"),
        )
        hit = F.col("_T").isNotNull()
        state = materialize(
            state.join(new, "pair_id", "left").select(
                "pair_id",
                F.coalesce("_T", "T").alias("T"),
                "n_source",
                (F.col("converged") | F.coalesce("_done", F.lit(False))).alias("converged"),
                (F.col("active") & F.coalesce(F.col("_moved") & ~F.col("_done"), F.lit(False))).alias("active"),
                F.when(hit, F.col("_e")).otherwise(F.col("error")).alias("error"),
                F.when(hit, F.col("_i")).otherwise(F.col("inliers")).alias("inliers"),
                F.when(hit, F.col("_h")).otherwise(F.col("h")).alias("h"),
            )
        )
    return state.drop("active")


def _result(pairs, state, thr, min_inlier):
    rated = match_quality(state.select("pair_id", "T", "converged", "error", "inliers", "h"), state.select("pair_id", "n_source"), thr, min_inlier)
    ok = F.col("_T").isNotNull()
    return pairs.select("pair_id").join(rated.withColumnRenamed("T", "_T"), "pair_id", "left").select(
        "pair_id",
        F.when(ok, F.col("_T")).otherwise(identity_pose()).alias("T"),
        F.coalesce("converged", F.lit(False)).alias("converged"),
        "fitness",
        F.coalesce("inlier_ratio", F.lit(0.0)).alias("inlier_ratio"),
        F.coalesce("inliers", F.lit(0)).alias("inliers"),
        F.col("h").alias("info"),
        F.coalesce("success", F.lit(False)).alias("success"),
    )


def _refined(pairs, state, thr, min_inlier):
    """``_result`` with the fine pass in place of the first where it converged below ``thr``, and ``far``."""
    names = ("T", "converged", "error", "inliers", "h", "n_source")
    fine = F.try_divide("fine_error", "fine_inliers")
    better = F.coalesce(F.col("fine_converged") & (fine < thr), F.lit(False))
    chosen = state.select("pair_id", "far", better.alias("_better"), *(F.when(better, F.col(f"fine_{c}")).otherwise(F.col(c)).alias(c) for c in names))
    ratio = F.coalesce(F.try_divide("inliers", "n_source"), F.lit(0.0))
    fitness = F.try_divide("error", "inliers")
    good = F.col("_better") | (F.col("converged") & (fitness < thr) & (ratio >= min_inlier))
    ok = F.col("_T").isNotNull()
    return pairs.select("pair_id").join(chosen.withColumnRenamed("T", "_T"), "pair_id", "left").select(
        "pair_id",
        F.when(ok, F.col("_T")).otherwise(identity_pose()).alias("T"),
        F.coalesce("converged", F.lit(False)).alias("converged"),
        fitness.alias("fitness"),
        ratio.alias("inlier_ratio"),
        F.coalesce("inliers", F.lit(0)).alias("inliers"),
        F.col("h").alias("info"),
        F.coalesce(good, F.lit(False)).alias("success"),
        F.coalesce("far", F.lit(False)).alias("far"),
    )


def register_pairs(
    pairs: DataFrame, source: DataFrame, target: DataFrame, leaf=0.1, max_dist=2.0, rounds=30, thr=0.3,
    min_inlier=0.03, k=20, refine=True, refine_leaf=0.05, refine_dist=1.0, refine_rounds=20,
    refine_gate=0.5, gate_t=3.0, gate_r=0.5,
) -> DataFrame:
    """Coarse-to-fine point-to-plane registration of all pairs, then an optional refinement.

    ``pairs``: pair_id, T (start pose, source to target) and, where pairs share clouds, cloud_id.
    ``source`` / ``target``: pair_id (or cloud_id), x, y, z.
    Output: pair_id, T, converged, fitness, inlier_ratio, inliers, info, success.
    """
    leaf = max(1e-3, leaf)
    stages = Stages([(2 * leaf, max(max_dist, 12 * leaf), rounds, "plane"), (leaf, max_dist, rounds, "plane")])
    if refine:
        stages.fine = (refine_leaf, refine_dist, refine_rounds, refine_gate, gate_t, gate_r)
    found = _refined(pairs, _align(pairs, source, target, stages, k), thr, min_inlier)
    if not refine or found.where("far").isEmpty():
        return found.drop("far")
    near, far = found.where("not far").drop("far"), materialize(found.where("far").drop("far"))
    ids = materialize(pairs.join(far.select("pair_id"), "pair_id", "left_semi"))
    fine = refine_pairs(far, ids, source, target, refine_leaf, refine_dist, refine_rounds, thr, refine_gate, gate_t, gate_r, k)
    return near.unionByName(fine)


def refine_pairs(
    matches, pairs, source, target, leaf=0.05, max_dist=1.0, rounds=20, thr=0.3, fitness_gate=0.5,
    gate_t=3.0, gate_r=0.5, k=20,
) -> DataFrame:
    """Second pass, surface to surface, for matches that already fit and moved little.

    The refined result replaces the first only if it converged below ``thr``.
    """
    seeds = pairs.select(*[c for c in ("pair_id", "cloud_id") if c in pairs.columns], F.col("T").alias("_T0"))
    delta = matches.join(seeds, "pair_id").withColumn("_d", pose_between("_T0", "T"))
    todo = delta.filter(
        (F.col("fitness") < fitness_gate)
        & (translation_norm("_d") <= gate_t)
        & (rotation_angle("_d") <= gate_r)
    ).drop("_T0", "_d")
    if "cloud_id" in todo.columns or "cloud_id" in source.columns:
        wanted = todo.select("cloud_id").distinct()
    else:
        wanted = todo.select("pair_id")
    source, target = (d.join(wanted, wanted.columns, "left_semi") for d in (source, target))
    state = _align(todo, source, target, [(leaf, max_dist, rounds, "gicp")], k)
    fine = _result(todo, state, thr, 0.0).filter(F.col("converged") & (F.col("fitness") < thr))
    better = fine.withColumn("success", F.lit(True))
    return matches.join(better.select("pair_id"), "pair_id", "left_anti").unionByName(better)


def verify_pairs_keyframe(
    pairs: DataFrame, source: DataFrame, target: DataFrame, leaf=0.1, max_dist=2.0, rounds=30, thr=0.3,
    min_inlier=0.03, k=20,
) -> DataFrame:
    """One-resolution surface-to-surface registration of single clouds.

    A column ``yaw`` of ``pairs`` turns the start pose about its own vertical axis.
    """
    start = pairs
    if "yaw" in pairs.columns:
        turned = pose_compose("T", yaw_pose(F.coalesce("yaw", F.lit(0.0))))
        start = pairs.withColumn("T", turned)
    state = _align(start, source, target, [(leaf, max_dist, rounds, "gicp")], k)
    return _result(pairs, state, thr, min_inlier)


def align_batch(pairs: DataFrame, source, target, guesses: DataFrame = None, **options) -> DataFrame:
    """Register many pairs from optional start poses; pairs without one start at identity."""
    ids = pairs.select("pair_id")
    if guesses is None:
        start = ids.withColumn("T", identity_pose())
    else:
        start = ids.join(guesses.select("pair_id", "T"), "pair_id", "left").withColumn(
            "T", F.when(F.col("T").isNotNull(), F.col("T")).otherwise(identity_pose())
        )
    return verify_pairs_keyframe(start, source, target, **options)


def seeded_best(candidates: DataFrame, source, target, sector_deg=6.0, n=4, **options) -> DataFrame:
    """Try every start angle of each candidate; keep the converged result of least fitness.

    ``candidates``: pair_id, T (pose of the match), yaw (NULL if unknown). Candidates for which no
    start converges are absent.
    """
    seeds = candidates.select(
        "pair_id", "T", F.posexplode(yaw_seeds("yaw", F.col("yaw").isNotNull(), sector_deg, n)).alias("seed", "_yaw")
    )
    fan = max(3, n)
    tries = materialize(
        seeds.select(
            (F.col("pair_id") * fan + F.col("seed")).alias("pair_id"),
            F.col("pair_id").alias("parent"),
            pose_compose("T", yaw_pose(F.col("_yaw"))).alias("T"),
        )
    )

    # All starts of a candidate share its clouds.
    shared = tries.withColumnRenamed("parent", "cloud_id")
    clouds = [c.withColumnRenamed("pair_id", "cloud_id") for c in (source, target)]
    tried = register_pairs(shared, *clouds, **options)
    best = tried.filter("converged").join(tries.select("pair_id", "parent"), "pair_id")
    rest = [c for c in tried.columns if c != "pair_id"]
    return best.groupBy(F.col("parent").alias("pair_id")).agg(
        F.min_by(F.struct(*rest), F.struct("fitness", F.col("pair_id"))).alias("_r")
    ).select("pair_id", "_r.*")
