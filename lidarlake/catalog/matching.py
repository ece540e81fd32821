"""Queries over ranked matches, evaluation results, range images, registration and graphs."""

import math

from pyspark.sql import functions as F

from lidarlake.catalog import sqlpose as S
from lidarlake.catalog.points import keyframes, points
from lidarlake.catalog.registry import query
from lidarlake.catalog.views import flat_pose, r6, view, with_views
from lidarlake.functions.pose import (
    identity_pose,
    make_pose,
    pose_between,
    pose_compose,
    transform_xyz,
    translation_distance,
    yaw_of,
    yaw_pose,
)
from lidarlake.functions.scores import diagonal_information, edge_information
from lidarlake.operators import evaluate, posegraph, ranking, register
from lidarlake.plans import loops
from lidarlake.session import materialize

MATCHES = with_views("matches")
CLOUD = ["map_id", "kf_id"]


def matches(spark, sf):
    return view(spark, sf, "matches")


@query(
    "best_per_query",
    f"{MATCHES} select map_id, query_id, match_id, {S.r6('fitness')} as fitness from (select *, row_number() over (partition by map_id, query_id order by fitness, match_id) as rn from matches) where rn = 1",
)
def best_per_query(spark, sf):
    b = ranking.best_per_query(matches(spark, sf))
    return b.select("map_id", "query_id", "match_id", r6("fitness").alias("fitness"))


# Candidates of a query: its ten best matches, placed in the plane by their residual.
_CAND = (
    f"{MATCHES}, c0 as (select map_id, query_id, match_id, fitness, inlier_ratio, converged, rhpd_distance, sc_distance, t_tx*1.5e0 as x, t_ty*1.5e0 as y, case when sc_distance is null then null else "
    "rhpd_distance/100.0e0 end as fused_score, row_number() over (partition by map_id, query_id order by rhpd_distance, match_id) - 1 as rank from matches), cand as (select * from c0 where rank < 10)"
)


def candidates(spark, sf):
    m = matches(spark, sf)
    from lidarlake.operators.retrieval import _rank

    return _rank(m, ["rhpd_distance", "match_id"], "rank").filter("rank < 10").select(
        "map_id", "query_id", "match_id", "fitness", "inlier_ratio", "converged", "rhpd_distance", "sc_distance",
        (F.col("T.tx") * 1.5).alias("x"), (F.col("T.ty") * 1.5).alias("y"),
        F.when(F.col("sc_distance").isNotNull(), F.col("rhpd_distance") / 100.0).alias("fused_score"), "rank",
    )


def _hyp(a, b):
    return f"sqrt(({a}.x-{b}.x)**2+({a}.y-{b}.y)**2)"


_BASIN = (
    f"{_CAND}, l0 as (select * from cand where rank = 0), l1 as (select * from (select c.*, row_number() over (partition by c.map_id, c.query_id order by c.rank) as rn from cand c join l0 a on c.map_id = "
    f"a.map_id and c.query_id = a.query_id where {_hyp('c', 'a')} > 4) where rn = 1), l2 as (select * from (select c.*, row_number() over (partition by c.map_id, c.query_id order by c.rank) as rn from cand c "
    f"join l0 a on c.map_id = a.map_id and c.query_id = a.query_id join l1 b on c.map_id = b.map_id and c.query_id = b.query_id where {_hyp('c', 'a')} > 4 and {_hyp('c', 'b')} > 4) where rn = 1), lead as "
    "(select map_id, query_id, match_id, rank, x, y, 0 as basin from l0 union all select map_id, query_id, match_id, rank, x, y, 1 from l1 union all select map_id, query_id, match_id, rank, x, y, 2 from l2), "
    f"asg as (select c.*, l.basin, l.match_id as basin_center, {_hyp('c', 'l')} as d, row_number() over (partition by c.map_id, c.query_id, c.match_id order by {_hyp('c', 'l')}, l.basin) as rn from cand c join "
    "lead l on c.map_id = l.map_id and c.query_id = l.query_id and l.rank <= c.rank), basin as (select * from asg where rn = 1 and d <= 4)"
)
_OK = "converged and fitness < 0.3 and inlier_ratio >= 0.03 and greatest(0e0, least(1e0, exp(-fitness/0.15e0))) >= 0.3"
_BEST = (
    f"{_BASIN}, t3 as (select *, fitness + coalesce(fused_score, 1e0) as score, row_number() over (partition by map_id, query_id, basin order by rank) as n from basin), best as (select * from (select *, "
    f"row_number() over (partition by map_id, query_id, basin order by score, rank) as k from t3 where n <= 3 and {_OK}) where k = 1)"
)


@query("basins", f"{_BASIN} select map_id, query_id, match_id, basin, basin_center from basin")
def basins(spark, sf):
    return ranking.basins(candidates(spark, sf)).select("map_id", "query_id", "match_id", "basin", "basin_center")


@query("best_per_basin", f"{_BEST} select map_id, query_id, basin, match_id, {S.r6('score')} as selection_score from best")
def best_per_basin(spark, sf):
    b = ranking.best_per_basin(ranking.basins(candidates(spark, sf)))
    return b.select("map_id", "query_id", "basin", "match_id", r6("selection_score").alias("selection_score"))


@query(
    "ambiguous_basins",
    f"{_BEST}, o as (select *, row_number() over (partition by map_id, query_id order by score, basin) as o from best) select a.map_id, a.query_id, coalesce({_hyp('a', 'b')} >= 3 and abs(a.fitness - b.fitness) "
    "<= 0.03, false) as ambiguous from (select * from o where o = 1) a left join (select * from o where o = 2) b on a.map_id = b.map_id and a.query_id = b.query_id",
)
def ambiguous_basins(spark, sf):
    return ranking.ambiguous_basins(ranking.best_per_basin(ranking.basins(candidates(spark, sf))))


@query(
    "best_candidate",
    f"{MATCHES}, g as (select *, min(fitness) over (partition by map_id, query_id) as low from matches where {_OK}) select map_id, query_id, match_id from (select *, row_number() over (partition by map_id, "
    "query_id order by coalesce(rhpd_distance, sc_distance), fitness, match_id) as rn from g where fitness <= low + 0.05) where rn = 1",
)
def best_candidate(spark, sf):
    return ranking.best_candidate(matches(spark, sf), eps=0.05).select("map_id", "query_id", "match_id")


@query("loop_pair_history", f"{MATCHES} select distinct map_id, match_id % 1000 as match_id, query_id from matches where verified")
def loop_pair_history(spark, sf):
    m = matches(spark, sf).filter("verified").withColumn("match_id", F.col("match_id") % 1000)
    return ranking.loop_pair_history(m)


_T = S.cols("t_")


@query(
    "loop_edges",
    f"{MATCHES} select map_id, 'match_to_query' as direction, match_id as from_id, query_id as to_id, {S.rounded(_T, 'm_')} from matches where verified union all select map_id, 'query_to_match', query_id, "
    f"match_id, {S.rounded(S.inverse(_T), 'm_')} from matches where verified",
)
def loop_edges(spark, sf):
    m = matches(spark, sf).filter("verified").withColumn("T_match_query", F.col("T")).withColumn(
        "info", F.array(*(F.lit(v) for v in diagonal_information(1.0, 1.0)))
    )
    parts = [
        loops.loop_edges(m, d).select("map_id", F.lit(d).alias("direction"), "from_id", "to_id", *flat_pose("meas", "m_"))
        for d in ("match_to_query", "query_to_match")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "cross_map_only",
    f"{with_views('matches', 'keyframes')} select m.map_id, query_id, match_id % 100 as match_id, count(*) as n from matches m join (select map_id, max(kf_id) as max_id from keyframes where from_loaded group by "
    "1) b on m.map_id = b.map_id where match_id % 100 <= max_id group by 1, 2, 3",
)
def cross_map_only(spark, sf):
    m = matches(spark, sf).withColumn("match_id", F.col("match_id") % 100)
    bounds = keyframes(spark, sf).filter("from_loaded").groupBy("map_id").agg(F.max("kf_id").alias("max_id"))
    kept = loops.cross_map_only(m, bounds)
    return kept.groupBy("map_id", "query_id", "match_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "thin_queries",
    f"with recursive ids as (select distinct map_id, query_id from (select cast(floor(l_suppkey / 25.0e0) as bigint) as map_id, l_partkey as query_id from lineitem)), r as (select map_id, min(query_id) as query_id "
    "from ids group by 1 union all select * from (select i.map_id, min(i.query_id) as query_id from r join ids i on i.map_id = r.map_id and i.query_id >= r.query_id + 5 group by i.map_id)) select * from r",
)
def thin_queries(spark, sf):
    return loops.thin_queries(matches(spark, sf), 5, chunk=500)


_GATE = (
    f"case when not converged then 'not converged' when fitness >= 0.3 then 'fitness' when inlier_ratio < 0.5 then 'inlier ratio' when {S.norm(_T)} > 5 then 'translation' when {S.angle(_T)} > 0.5 then 'rotation' "
    "else 'accepted' end"
)


@query(
    "loop_diagnostics",
    f"{with_views('matches', 'keyframes')} select m.map_id, m.match_id, m.query_id, {_GATE} as reason, {S.r6('t_tx')} as residual_x, {S.r6('t_tz')} as residual_z, {S.r6(S.yaw(_T))} as residual_yaw, "
    f"{S.r6('asin(greatest(-1e0, least(1e0, 2*(t_qw*t_qy - t_qz*t_qx))))')} as residual_pitch, {S.r6('fitness')} as fitness, {S.r6(S.norm(S.between(S.cols('o_'), S.cols('p_'))))} as pose_change from matches m left join "
    "keyframes k on m.map_id = k.map_id and m.query_id = k.kf_id",
)
def loop_diagnostics(spark, sf):
    m = matches(spark, sf).withColumn("info", F.lit(None).cast("array<double>"))
    k = keyframes(spark, sf)
    d = loops.loop_diagnostics(
        m, k.select("map_id", "kf_id", F.col("odom").alias("pose")), k.select("map_id", "kf_id", F.col("opt").alias("pose"))
    )
    return d.select(
        "map_id", "match_id", "query_id", "reason",
        *(r6(c).alias(c) for c in ("residual_x", "residual_z", "residual_yaw", "residual_pitch", "fitness", "pose_change")),
    )


_LOOPS_IN = "e as (select map_id, kf_id - 3 as from_id, kf_id as to_id from keyframes where kf_id % 5 = 0)"


@query(
    "loop_report",
    f"{with_views('keyframes')}, {_LOOPS_IN}, j as (select e.map_id, {S.named(S.between(['a.' + c for c in S.cols('o_')], ['b.' + c for c in S.cols('o_')]), 'd_')}, {S.named(S.between(['a.' + c for c in S.cols('p_')], ['b.' + c for c in S.cols('p_')]), 'g_')} "
    "from e join keyframes a on e.map_id = a.map_id and e.from_id = a.kf_id join keyframes b on e.map_id = b.map_id and e.to_id = b.kf_id), r as (select map_id, avg("
    + S.norm(["(d_tx-2)", "d_ty", "d_tz"]) + ") as rb, avg(" + S.norm(["(g_tx-2)", "g_ty", "g_tz"]) + f") as ra, count(*) as n from j group by 1), u as (select map_id, avg({S.norm(S.between(S.cols('o_'), S.cols('p_')))}) as um, "
    "count(*) as c from keyframes group by 1) select r.map_id, n as loop_edges, " + f"{S.r6('rb')} as residual_t_before, {S.r6('ra')} as residual_t_after, {S.r6('um')} as update_mean_t, c as updated from r join u on r.map_id = u.map_id",
)
def loop_report(spark, sf):
    k = keyframes(spark, sf)
    zero = F.lit(0.0)
    e = k.filter("kf_id % 5 = 0").select(
        "map_id", (F.col("kf_id") - 3).alias("from_id"), F.col("kf_id").alias("to_id"),
        make_pose(F.lit(2.0), zero, zero, zero, zero, zero, F.lit(1.0)).alias("meas"),
    )
    r = loops.loop_report(
        e, k.select(*CLOUD, F.col("odom").alias("pose")), k.select(*CLOUD, F.col("opt").alias("pose"))
    )
    return r.filter("loop_edges is not null").select(
        "map_id", "loop_edges", r6("residual_t_before").alias("residual_t_before"),
        r6("residual_t_after").alias("residual_t_after"), r6("update_mean_t").alias("update_mean_t"), "updated",
    )


# --- evaluation -------------------------------------------------------------------------------

RES = with_views("results")
_ACC = "(locked and translation_error_m <= 1.0 and yaw_error_deg <= 10.0 and roll_pitch_error_deg <= 5.0)"
_RATES = (
    "count(*) as tested, sum(locked::int) as lock_success, sum({a}::int) as pose_success, sum((locked and match_id = query_id)::int) as self_matches, "
    + S.r6("sum(locked::int) / count(*)") + " as lock_success_rate, " + S.r6("sum({a}::int) / count(*)") + " as pose_success_rate, "
    + ", ".join(
        f"{S.r6(f'quantile_cont(case when locked then {c} end, {q})')} as {n}_{c}"
        for c in evaluate.ERRORS for n, q in (("median", 0.5), ("p95", 0.95))
    )
).replace("{a}", _ACC)
_STATS = [f"{n}_{c}" for c in evaluate.ERRORS for n in ("median", "p95")] + ["lock_success_rate", "pose_success_rate"]


@query(
    "pose_accurate",
    f"{RES} select query_id, {_ACC} as accurate from results",
)
def pose_accurate(spark, sf):
    from lidarlake.functions.predicates import pose_accurate as ok

    return view(spark, sf, "results").select("query_id", ok().alias("accurate"))


@query(
    "eval_summary",
    f"{RES} select {_RATES}, list_sort(list(query_id) filter (where not locked)) as failed_ids, list_sort(list(query_id) filter (where not {_ACC})) as inaccurate_ids from results",
)
def eval_summary(spark, sf):
    return evaluate.eval_summary(view(spark, sf, "results")).withColumns({c: r6(c) for c in _STATS})


@query("eval_matrix", f"{RES} select {S.r6('dropout')} as dropout, {S.r6('noise_sigma')} as noise_sigma, fake_yaw_deg, query_source, {_RATES} from results group by 1, 2, 3, 4")
def eval_matrix(spark, sf):
    res = view(spark, sf, "results").withColumn("dropout", r6("dropout")).withColumn("noise_sigma", r6("noise_sigma"))
    return evaluate.eval_matrix(res).withColumns({c: r6(c) for c in _STATS})


@query(
    "strict_pass",
    f"{RES}, m as (select query_source, {_RATES} from results group by 1) select query_source, pose_success_rate >= 0.2 and median_translation_error_m <= 0.66 and median_yaw_error_deg <= 6.1 as strict_pass from m",
)
def strict_pass(spark, sf):
    m = evaluate.eval_matrix(view(spark, sf, "results"), ["query_source"])
    return evaluate.strict_pass(m, 0.2, 0.66, 6.1).select("query_source", "strict_pass")


_RAY = (
    "ray as (select map_id, kf_id, sqrt(x*x+y*y+z*z) as r, (case when degrees(atan2(y, x)) < 0 then degrees(atan2(y, x)) + 360 else degrees(atan2(y, x)) end) as az, degrees(atan2(z, sqrt(x*x+y*y))) as el, "
    "x, y, z, pt_id from {src})"
)
# The rear half of each cloud is mirrored to the front, so that the field of view is not full.
_HALF = f"{with_views('points')}, half as (select * replace (abs(x) + 1.0 as x) from points), {_RAY.format(src='half')}"
_ENV = (
    f"{_HALF}, ok as (select * from ray where r between 0.5 and 30), gp as (select map_id, kf_id, az as a, coalesce(lead(az) over w, first_value(az) over (partition by map_id, kf_id order by az) + 360) as b from "
    "ok window w as (partition by map_id, kf_id order by az)), g as (select map_id, kf_id, max(b - a) as gap, arg_max(b, (b - a, -a)) as b from gp group by 1, 2), q as (select map_id, kf_id, quantile_cont(el, 0.01) as v1, "
    "quantile_cont(el, 0.99) as v99, count(*) as n from ok group by 1, 2), env as (select g.map_id, g.kf_id, 360 - gap as span, gap, b - 360*floor(b/360) as start, v1, v99 from g join q on g.map_id = q.map_id and "
    "g.kf_id = q.kf_id), env2 as (select map_id, kf_id, span >= 330 as azimuth_full, case when span >= 330 then 0e0 else start end as azimuth_start, case when span >= 330 then 360e0 else span end as azimuth_span, v1 as "
    "vertical_min, v99 as vertical_max from env)"
)


def half_points(spark, sf):
    return points(spark, sf).withColumn("x", F.abs("x") + 1.0)


def envelope(spark, sf):
    return evaluate.scan_envelope(half_points(spark, sf))


_ENV_COLS = ("azimuth_start", "azimuth_span", "vertical_min", "vertical_max")


@query("scan_envelope", f"{_ENV} select map_id, kf_id, azimuth_full, {', '.join(f'{S.r6(c)} as {c}' for c in _ENV_COLS)} from env2")
def scan_envelope(spark, sf):
    return envelope(spark, sf).select(*CLOUD, "azimuth_full", *(r6(c).alias(c) for c in _ENV_COLS))


# Range images in the forward half with a fixed wide envelope, ten-degree cells.
_IMG = (
    f"{with_views('points')}, {_RAY.format(src='points')}, vis as (select *, floor(az/10)::bigint as col, floor((el+30)/10)::bigint as row from ray where r between 0.5 and 30 and el between -30 and 30), hit as (select * from "
    "(select *, row_number() over (partition by map_id, kf_id, least(row, 5), col order by r, x, y, z) as rn from vis) where rn = 1), hits as (select map_id, kf_id, least(row, 5) as row, col, r, x, y, z from hit)"
)


def wide(spark, sf):
    return keyframes(spark, sf).select(
        *CLOUD, F.lit(True).alias("azimuth_full"), F.lit(0.0).alias("azimuth_start"), F.lit(360.0).alias("azimuth_span"),
        F.lit(-30.0).alias("vertical_min"), F.lit(30.0).alias("vertical_max"),
    )


@query("range_image", f'{_IMG} select map_id, kf_id, "row", col, {S.r6("r")} as "range", {S.r6("x")} as x from hits')
def range_image(spark, sf):
    h = evaluate.range_image(points(spark, sf), wide(spark, sf), res_deg=10.0)
    return h.select(*CLOUD, "row", "col", r6("range").alias("range"), r6("x").alias("x"))


@query(
    "occlusion_filter",
    f'{_IMG} select a.map_id, a.kf_id, a."row", a.col from hits a join hits b on a.map_id = b.map_id and a.kf_id = b.kf_id and abs(a."row" - b."row") <= 1 and (abs(a.col - b.col) <= 1 or abs(a.col - b.col) = 35) group by '
    '1, 2, 3, 4, a.r having a.r <= min(b.r) + 0.3',
)
def occlusion_filter(spark, sf):
    h = evaluate.range_image(points(spark, sf), wide(spark, sf), res_deg=10.0)
    return evaluate.occlusion_filter(h).select(*CLOUD, "row", "col")


# --- registration -----------------------------------------------------------------------------


def _moved(df, tx, ty, tz, yaw):
    x, y, z = transform_xyz(_shift(tx, ty, tz, yaw), "x", "y", "z")
    return df.withColumn("_m", F.struct(x.alias("x"), y.alias("y"), z.alias("z"))).withColumns(
        {c: F.col(f"_m.{c}") for c in "xyz"}
    ).drop("_m")


def _shift(tx, ty, tz, yaw):
    t = yaw_pose(F.lit(yaw))
    return make_pose(F.lit(tx), F.lit(ty), F.lit(tz), *(t.getField(f"q{c}") for c in "xyzw"))


def source(spark, sf):
    return points(spark, sf).select(F.col("kf_id").alias("pair_id"), "pt_id", "x", "y", "z")


_NN = (
    f"{with_views('points')}, t as (select kf_id, pt_id, x + 0.4e0 as x, y - 0.3e0 as y, z + 0.1e0 as z from points), pr as (select s.kf_id, s.pt_id as src_id, t.pt_id as tgt_id, s.x, s.y, s.z, t.x as qx, t.y as qy, t.z as qz, (s.x-t.x)**2 + "
    "(s.y-t.y)**2 + (s.z-t.z)**2 as d2 from points s join t on s.kf_id = t.kf_id and abs(s.x-t.x) <= 2 and abs(s.y-t.y) <= 2 and abs(s.z-t.z) <= 2), nn as (select * from (select *, row_number() over (partition by kf_id, "
    "src_id order by d2, tgt_id) as rn from pr where d2 <= 4) where rn = 1)"
)


def _hits(spark, sf, carry=()):
    s = source(spark, sf)
    t = _moved(s, 0.4, -0.3, 0.1, 0.0).withColumnRenamed("pt_id", "tgt_id")
    if carry:
        t = t.withColumns({"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8)})
    return register.correspondences(s.withColumnRenamed("pt_id", "src_id"), t, 2.0, carry=carry)


@query("correspondences", f"{_NN} select kf_id as pair_id, src_id, tgt_id, {S.r6('d2')} as d2 from nn")
def correspondences(spark, sf):
    h = _hits(spark, sf)
    return h.select("pair_id", "src_id", F.col("hit.tgt_id").alias("tgt_id"), r6("hit.d2").alias("d2"))


_J = ["0.6e0", "0e0", "0.8e0", "(y*0.8e0)", "(z*0.6e0 - x*0.8e0)", "(-y*0.6e0)"]
_RES = "(0.6e0*(x-qx) + 0.8e0*(z-qz))"


@query(
    "normal_equations",
    f"{_NN} select kf_id as pair_id, [" + ", ".join(f"round(sum({_J[i]}*{_J[j]}), 4) + 0e0" for i in range(6) for j in range(i, 6))
    + "] as h, [" + ", ".join(f"round(sum({v}*{_RES}), 4) + 0e0" for v in _J) + f"] as b, round(sum({_RES}**2/2), 4) + 0e0 as error, count(*) as inliers from nn group by 1",
)
def normal_equations(spark, sf):
    n = register.normal_equations(_hits(spark, sf, ("nx", "ny", "nz")))

    def r4(c):
        return F.round(c, 4) + F.lit(0.0)

    return n.select(
        "pair_id", F.transform("h", r4).alias("h"), F.transform("b", r4).alias("b"), r4("error").alias("error"), "inliers"
    )


@query(
    "match_quality",
    f"{MATCHES}, m as (select map_id * 100 + query_id % 100 as pair_id, sum(case when verified then fitness else 0 end) as error, sum(verified::int) as inliers, count(*) as n, bool_or(converged) as converged from matches group by 1), "
    f"q as (select *, error / nullif(inliers, 0) as fitness, inliers / n as inlier_ratio from m) select pair_id, {S.r6('fitness * 0.7310585e0')} as scaled_fitness, {S.r6('inlier_ratio')} as inlier_ratio, coalesce(converged and fitness < 0.3 and inlier_ratio >= "
    "0.03, false) as success from q",
)
def match_quality(spark, sf):
    m = matches(spark, sf).withColumn("pair_id", F.col("map_id") * 100 + F.col("query_id") % 100)
    sums = m.groupBy("pair_id").agg(
        F.sum(F.when(F.col("verified"), F.col("fitness")).otherwise(0.0)).alias("error"),
        F.count_if("verified").alias("inliers"), F.bool_or("converged").alias("converged"),
    )
    n = m.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_source"))
    q = register.match_quality(sums, n)
    # Scaled by an odd factor so that no value lies halfway between two roundings.
    fitness = r6(F.col("fitness") * 0.7310585).alias("scaled_fitness")
    return q.select("pair_id", fitness, r6("inlier_ratio").alias("inlier_ratio"), "success")


@query(
    "neighbor_covariances",
    f"{with_views('points')}, d as (select a.kf_id, a.pt_id, b.x, b.y, b.z, row_number() over (partition by a.kf_id, a.pt_id order by (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, b.pt_id) as rn from points a join points b on "
    "a.kf_id = b.kf_id) select kf_id as pair_id, pt_id as tgt_id, round(covar_pop(x, x) * 0.7310585e0, 4) + 0e0 as cxx, round(covar_pop(x, y) * 0.7310585e0, 4) + 0e0 as cxy, round(covar_pop(z, z) * 0.7310585e0, 4) + 0e0 as czz from d where rn <= 10 group by 1, 2",
)
def neighbor_covariances(spark, sf):
    n = register.normals_covariances(source(spark, sf).withColumnRenamed("pt_id", "tgt_id"), k=10)

    def at(i):
        return F.round(F.get("cov", F.lit(i)) * 0.7310585, 4) + F.lit(0.0)

    return n.select("pair_id", "tgt_id", at(0).alias("cxx"), at(1).alias("cxy"), at(5).alias("czz"))


def _truth_sql(yaw):
    """The transform each cloud was moved by, at two digits."""
    return (
        "select s_suppkey as pair_id, 0.21e0 as tx, -0.14e0 as ty, 0.11e0 as tz, "
        f"{yaw}e0 as yaw, true as converged, true as success from supplier"
    )


def _recovered(found):
    def r2(c):
        return F.round(c, 2) + F.lit(0.0)

    return found.select(
        "pair_id", r2(F.col("T.tx")).alias("tx"), r2(F.col("T.ty")).alias("ty"), r2(F.col("T.tz")).alias("tz"),
        r2(yaw_of("T")).alias("yaw"), "converged", "success",
    )


def _target(spark, sf):
    return _moved(source(spark, sf), 0.212, -0.142, 0.112, 0.01)


def _starts(spark, sf):
    return keyframes(spark, sf).select(F.col("kf_id").alias("pair_id"), identity_pose().alias("T"))


@query("register_pairs", _truth_sql(0.01))
def register_pairs(spark, sf):
    return _recovered(register.register_pairs(_starts(spark, sf), source(spark, sf), _target(spark, sf)))


@query("refine_pairs", _truth_sql(0.01))
def refine_pairs(spark, sf):
    start = _starts(spark, sf)
    near = start.withColumn("T", pose_compose(_shift(0.2, -0.15, 0.1, 0.0), "T"))
    rough = near.select(
        "pair_id", "T", F.lit(True).alias("converged"), F.lit(0.1).alias("fitness"), F.lit(0.9).alias("inlier_ratio"),
        F.lit(10).cast("long").alias("inliers"), F.lit(None).cast("array<double>").alias("info"), F.lit(True).alias("success"),
    )
    return _recovered(register.refine_pairs(rough, start, source(spark, sf), _target(spark, sf)))


@query("verify_pairs_keyframe", _truth_sql(0.01))
def verify_pairs_keyframe(spark, sf):
    start = _starts(spark, sf).withColumn("yaw", F.lit(0.005))
    return _recovered(register.verify_pairs_keyframe(start, source(spark, sf), _target(spark, sf)))


@query("align_batch", _truth_sql(0.01))
def align_batch(spark, sf):
    ids = _starts(spark, sf)
    guesses = ids.filter("pair_id % 2 = 0").select("pair_id", _shift(0.2, -0.1, 0.1, 0.0).alias("T"))
    return _recovered(register.align_batch(ids, source(spark, sf), _target(spark, sf), guesses))


@query("seeded_best", _truth_sql(0.01))
def seeded_best(spark, sf):
    cands = _starts(spark, sf).withColumn("yaw", F.lit(0.0))
    return _recovered(register.seeded_best(cands, source(spark, sf), _target(spark, sf), sector_deg=1.0))


#: Keyframes between a place and its second visit: more than two submaps apart.
BACK = 12


def second_visits(spark, sf):
    """Keyframes whose later half drifted, every scan also seen from the place BACK keyframes before it."""
    k, p = keyframes(spark, sf), points(spark, sf).select(*CLOUD, "x", "y", "z")
    early = k.select("map_id", (F.col("kf_id") + BACK).alias("kf_id"), F.col("opt").alias("_m"))
    view = k.join(early, CLOUD).select(*CLOUD, pose_between("_m", "opt").alias("_view"))
    x, y, z = transform_xyz("_view", "x", "y", "z")
    seen = view.join(p, CLOUD).select("map_id", (F.col("kf_id") - BACK).alias("kf_id"), x.alias("x"), y.alias("y"), z.alias("z"))
    # One drift for all keyframes of the second half: none within a half, one between them. It turns about the
    # place where it sets in, so it is the same however far from the origin of the coordinates a map lies.
    late = F.col("kf_id") % 25 >= BACK
    c, s, x, y = math.cos(0.004), math.sin(0.004), F.col("opt.tx"), F.col("opt.ty")
    drift = _shift(x - c * x + s * y + 0.15, y - s * x - c * y - 0.1, 0.05, 0.004)
    spots = k.filter(late).groupBy("map_id").agg(F.min_by(drift, "kf_id").alias("_drift"))
    moved = F.when(late, pose_compose("_drift", "opt")).otherwise(F.col("opt"))
    drifted = k.join(materialize(spots), ["map_id"], "left").withColumn("opt", moved).drop("_drift")
    return materialize(drifted), materialize(p.union(seen)), k


def revisits(k, every, back):
    return k.filter(f"kf_id % {every} = {every - 1}").select(
        "map_id", F.col("kf_id").alias("query_id"), (F.col("kf_id") - back).alias("match_id")
    )


_TRUE_LOOP = (
    f"{with_views('keyframes')}, g as (select q.map_id, q.kf_id as query_id, m.kf_id as match_id, "
    + S.named(S.between(["m." + c for c in S.cols("p_")], ["q." + c for c in S.cols("p_")]), "g_")
    + " from keyframes q join keyframes m on q.map_id = m.map_id and m.kf_id = q.kf_id - 12 where q.kf_id % 5 = 4) select map_id, query_id, match_id, true as verified, "
    "true as near_truth from g"
)


@query("verify_loops", _TRUE_LOOP)
def verify_loops(spark, sf):
    """Loops found from drifted poses; true if the result is within 2 cm of the real transform."""
    k, body, truth = second_visits(spark, sf)
    out = loops.verify_loops(revisits(k, 5, BACK), k, body)
    pose = truth.select("map_id", "kf_id", F.col("opt").alias("p"))
    q = pose.withColumnsRenamed({"kf_id": "query_id", "p": "q"})
    m = pose.withColumnsRenamed({"kf_id": "match_id", "p": "m"})
    gap = translation_distance(pose_between("m", "q"), "T_match_query")
    return out.join(q, ["map_id", "query_id"]).join(m, ["map_id", "match_id"]).select(
        "map_id", "query_id", "match_id", "verified", (gap < 0.02).alias("near_truth")
    )


# --- pose graph -------------------------------------------------------------------------------


def graph(spark, sf):
    """Odometry between neighbours, and loops that agree with the optimized poses."""
    k = keyframes(spark, sf)
    odo = ranking.odometry_edges(k)
    far = k.select("map_id", (F.col("kf_id") + 8).alias("kf_id"), F.col("opt").alias("_old"))
    loop = k.filter("kf_id % 4 = 0").join(far, CLOUD).select(
        "map_id", (F.col("kf_id") - 8).alias("from_id"), F.col("kf_id").alias("to_id"),
        pose_between("_old", "opt").alias("meas"), edge_information(F.lit("LOOP")).alias("info"), F.lit("LOOP").alias("type"),
    )
    return k, materialize(odo.unionByName(loop))


@query("relax_pose_graph")
def relax_pose_graph(spark, sf):
    """Objective of each map before and after the relaxation, and the report of the relaxation."""
    k, e = graph(spark, sf)
    start = materialize(posegraph.initial_values(e, ranking.anchor_row(k)))
    priors = ranking.anchor_row(start.withColumnRenamed("pose", "opt")).select(*CLOUD, F.col("opt").alias("_prior"))
    end, report = posegraph.relax_pose_graph(start, e, report=True)
    a = posegraph.objective(e, start, priors).withColumnRenamed("cost", "before")
    b = posegraph.objective(e, end, priors).withColumnRenamed("cost", "after")
    fell = (F.col("after") <= F.col("before")).alias("fell")
    return a.join(b, ["map_id"]).join(report, ["map_id"], "left").select(
        "map_id", fell, "before", "after", "converged", "stalled", "steps", "gradient", "residual"
    )


@query("close_loops")
def close_loops(spark, sf):
    """Report of one loop round over drifted poses."""
    k, body, _ = second_visits(spark, sf)
    _, _, _, report = loops.close_loops(revisits(k, 10, BACK), k, ranking.odometry_edges(k), body)
    return report
