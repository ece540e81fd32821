"""Closing loops: verify candidates, build edges, report, relax; within a map and across maps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.functions.pose import (
    identity_pose,
    pose_between,
    pose_compose,
    pose_inverse,
    rotation_angle,
    translation_norm,
)
from lidarlake.functions.predicates import loop_passes, registration_passes
from lidarlake.functions.scores import diagonal_information
from lidarlake.operators.clouds import member_points, submap_members
from lidarlake.operators.posegraph import mean_residual, pose_delta, relax_pose_graph
from lidarlake.operators.ranking import best_per_query
from lidarlake.operators.register import register_pairs, verify_pairs_keyframe
from lidarlake.operators.sequence import chunked_fold
from lidarlake.session import materialize


def thin_queries(queries: DataFrame, gap=5, chunk=100_000) -> DataFrame:
    """Keep a query id only if it lies at least ``gap`` after the last one kept, per map.

    ``queries``: map_id, query_id; only queries that produced candidates belong here.
    """

    def fold(last, rows):
        for r in rows:
            q = r["query_id"]
            if last is None or q - last >= gap:
                yield {"query_id": q}
                last = q
        return last

    ids = queries.select("map_id", "query_id").distinct()
    return chunked_fold(
        ids, ["map_id"], F.floor(F.col("query_id") / chunk), "query_id", fold, "query_id long", None
    )


def _pairs(candidates, keyframes):
    """Candidates with a pair id and the poses of both keyframes."""
    q = keyframes.select("map_id", F.col("kf_id").alias("query_id"), F.col("opt").alias("q_opt"))
    m = keyframes.select("map_id", F.col("kf_id").alias("match_id"), F.col("opt").alias("m_opt"))
    both = candidates.join(q, ["map_id", "query_id"]).join(m, ["map_id", "match_id"])
    # Written before use, so the ids stay the same wherever they are read.
    return materialize(
        both.withColumn("pair_id", F.monotonically_increasing_id()).withColumn(
            "estimate", pose_between("m_opt", "q_opt")
        )
    )


def verify_loops(
    candidates: DataFrame, keyframes: DataFrame, points: DataFrame, radius=5, fitness=0.3, inlier=0.5,
    max_t=5.0, max_r=0.5, use_icp_information=False, **options,
) -> DataFrame:
    """Register each query scan against the submap around its match.

    Both clouds are in the frame of the match and registration starts at identity, so the result
    is the residual on top of the current estimate. A query near its match is no part of its own
    target, or it would only find itself. Output: candidates' columns plus T (residual),
    T_match_query, fitness, inlier_ratio, converged, verified, info.
    """
    pairs = _pairs(candidates, keyframes)
    query = pairs.select("pair_id", "map_id", F.col("query_id").alias("kf_id"), F.col("estimate").alias("pose"))
    source = member_points(query, points).select("pair_id", "x", "y", "z")
    around = submap_members(
        pairs.select("pair_id", "map_id", F.col("match_id").alias("center_id"), F.col("match_id").alias("root_id"), "query_id"),
        keyframes, radius, radius, "root_id",
    ).filter(F.col("kf_id") != F.col("query_id"))
    target = member_points(around, points).select("pair_id", "x", "y", "z")
    start = pairs.select("pair_id", identity_pose().alias("T"))
    found = register_pairs(start, source, target, **options)
    if not use_icp_information:
        unit = F.array(*(F.lit(v) for v in diagonal_information(1.0, 1.0)))
        found = found.withColumn("info", unit)
    ok = registration_passes(fitness, inlier, max_t, max_r)
    return (
        pairs.join(found.drop("success"), "pair_id")
        .withColumn("verified", ok)
        .withColumn("T_match_query", F.when(F.col("verified"), pose_compose("T", "estimate")))
        .drop("pair_id", "q_opt", "m_opt")
    )


def verify_cross_loops(candidates, keyframes, points, **options) -> DataFrame:
    """Register single scans of both keyframes, starting from the estimate turned by the yaw hint."""
    pairs = _pairs(candidates, keyframes)

    def cloud(name):
        ids = pairs.select("pair_id", "map_id", F.col(name).alias("kf_id"))
        return ids.join(points, ["map_id", "kf_id"]).select("pair_id", "x", "y", "z")

    start = pairs.select("pair_id", F.col("estimate").alias("T"), "yaw")
    found = verify_pairs_keyframe(start, cloud("query_id"), cloud("match_id"), **options)
    return (
        pairs.join(found.withColumnRenamed("success", "verified"), "pair_id")
        .withColumn("T_match_query", F.when(F.col("verified"), F.col("T")))
        .drop("pair_id", "q_opt", "m_opt")
    )


def cross_map_only(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Candidates whose match belongs to the map as it was loaded (``bounds``: map_id, max_id)."""
    return candidates.join(bounds, ["map_id"]).filter(F.col("match_id") <= F.col("max_id")).drop("max_id")


def loop_edges(matches: DataFrame, direction="match_to_query") -> DataFrame:
    """Loop constraints from the match to the query, or inverted."""
    forward = direction == "match_to_query"
    a, b = ("match_id", "query_id") if forward else ("query_id", "match_id")
    meas = F.col("T_match_query") if forward else pose_inverse("T_match_query")
    return matches.select(
        "map_id", F.col(a).alias("from_id"), F.col(b).alias("to_id"), meas.alias("meas"), "info",
        F.lit("LOOP").alias("type"),
    )


def accepted_loops(matches, min_inlier=0.5, max_fitness=0.3, best=True) -> DataFrame:
    """Verified loops within the limits; the best per query, or all of them."""
    good = matches.filter(loop_passes(min_inlier, max_fitness))
    return best_per_query(good) if best else good


def loop_report(edges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per map: mean loop residual before and after, and how far the poses moved."""

    def residual(poses, name):
        return mean_residual(edges, poses).select(
            "map_id", F.col("mean_t").alias(f"residual_t_{name}"), F.col("mean_r").alias(f"residual_r_{name}"),
            F.col("edges").alias(f"_{name}"),
        )

    moved = pose_delta(before, after).select(
        "map_id", F.col("mean_t").alias("update_mean_t"), F.col("max_t").alias("update_max_t"),
        F.col("mean_r").alias("update_mean_r"), F.col("max_r").alias("update_max_r"),
        F.col("count").alias("updated"),
    )
    return (
        residual(before, "before")
        .join(residual(after, "after"), ["map_id"], "full")
        .join(moved, ["map_id"], "left")
        .withColumnRenamed("_before", "loop_edges")
        .drop("_after")
    )


def gate_reason(fitness=0.3, inlier=0.5, max_t=5.0, max_r=0.5, pose="T"):
    """First limit a registration breaks, or ``accepted``."""
    return (
        F.when(~F.coalesce("converged", F.lit(False)), "not converged")
        .when(F.col("fitness").isNull() | (F.col("fitness") >= fitness), "fitness")
        .when(F.col("inlier_ratio") < inlier, "inlier ratio")
        .when(translation_norm(pose) > max_t, "translation")
        .when(rotation_angle(pose) > max_r, "rotation")
        .otherwise("accepted")
    )


def _roll_pitch_yaw(pose):
    x, y, z, w = (pose.getField(f"q{c}") for c in "xyzw")
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    return roll, pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def loop_diagnostics(matches: DataFrame, before: DataFrame, after: DataFrame, **limits) -> DataFrame:
    """One row per candidate: scores, residual by axis, gate reason, information, pose change of the query."""
    roll, pitch, yaw = _roll_pitch_yaw(F.col("T"))
    a = before.select("map_id", F.col("kf_id").alias("query_id"), F.col("pose").alias("_a"))
    b = after.select("map_id", F.col("kf_id").alias("query_id"), F.col("pose").alias("_b"))
    out = matches.join(a, ["map_id", "query_id"], "left").join(b, ["map_id", "query_id"], "left")
    extra = [c for c in ("rhpd_distance", "sc_distance", "fused_score", "yaw") if c in matches.columns]
    return out.select(
        "map_id", "query_id", "match_id", *extra,
        F.col("T.tx").alias("residual_x"), F.col("T.ty").alias("residual_y"), F.col("T.tz").alias("residual_z"),
        roll.alias("residual_roll"), pitch.alias("residual_pitch"), yaw.alias("residual_yaw"),
        "fitness", "inlier_ratio", gate_reason(**limits).alias("reason"), "info",
        translation_norm(pose_between("_a", "_b")).alias("pose_change"),
    )


def close_loops(candidates: DataFrame, keyframes: DataFrame, edges: DataFrame, points: DataFrame, gap=5,
                min_inlier=0.5, max_fitness=0.3, graph_options=None, **options):
    """One round: thin, verify, select, add edges, relax. Returns loops, edges, poses, report."""
    kept = thin_queries(candidates, gap)
    chosen = candidates.join(kept, ["map_id", "query_id"], "left_semi")
    matches = verify_loops(chosen, keyframes, points, inlier=min_inlier, fitness=max_fitness, **options)
    loops = materialize(accepted_loops(matches, min_inlier, max_fitness))
    new_edges = loop_edges(loops)
    all_edges = edges.unionByName(new_edges)
    before = keyframes.select("map_id", "kf_id", F.col("opt").alias("pose"))
    touched = loops.select("map_id").distinct()
    nodes = before.join(touched, ["map_id"], "left_semi")
    solved = relax_pose_graph(nodes, all_edges.join(touched, ["map_id"], "left_semi"), **(graph_options or {}))
    rest = before.join(touched, ["map_id"], "left_anti")
    after = materialize(solved.unionByName(rest))
    return loops, all_edges, after, loop_report(new_edges, before, after)

