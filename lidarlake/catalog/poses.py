"""Queries over poses, scores, edges, trajectories and time joins."""

from pyspark.sql import functions as F

from lidarlake.catalog import sqlpose as S
from lidarlake.catalog.points import keyframes, points
from lidarlake.catalog.registry import query
from lidarlake.catalog.views import edges, flat_pose, odom_frames, r6, view, with_views
from lidarlake.functions import pose as Q
from lidarlake.functions import predicates as P
from lidarlake.functions import scores as C
from lidarlake.operators import mapcheck, posegraph, ranking, sequence, trajectory
from lidarlake.operators.neighbors import nearest_by_position

O, OPT, M = S.cols("o_"), S.cols("p_"), S.cols("m_")
KF = with_views("keyframes")
MATCHES = with_views("matches")
ODOM = with_views("odom")


def matches(spark, sf):
    return view(spark, sf, "matches")


def _pref(p, cols):
    return [f"{p}.{c}" for c in cols]


def _poses_sql(body):
    return f"{KF} select map_id, kf_id, {body} from keyframes"


@query(
    "pose_normalize",
    _poses_sql(
        S.rounded(O[:3] + [f"{c} * 3.0e0 / sqrt(9.0e0*(o_qx*o_qx+o_qy*o_qy+o_qz*o_qz+o_qw*o_qw))" for c in O[3:]], "n_")
        + ", ["
        + ", ".join(
            S.r6(e)
            for e in (
                "1-2*(o_qy*o_qy+o_qz*o_qz)", "2*(o_qx*o_qy-o_qw*o_qz)", "2*(o_qx*o_qz+o_qw*o_qy)",
                "2*(o_qx*o_qy+o_qw*o_qz)", "1-2*(o_qx*o_qx+o_qz*o_qz)", "2*(o_qy*o_qz-o_qw*o_qx)",
                "2*(o_qx*o_qz-o_qw*o_qy)", "2*(o_qy*o_qz+o_qw*o_qx)", "1-2*(o_qx*o_qx+o_qy*o_qy)",
            )
        )
        + "] as rot"
    ),
)
def pose_normalize(spark, sf):
    p = F.col("odom")
    long = Q.make_pose(*(p[c] for c in ("tx", "ty", "tz")), *(p[c] * 3.0 for c in ("qx", "qy", "qz", "qw")))
    out = keyframes(spark, sf).withColumn("n", Q.pose_normalize(long))
    return out.select("map_id", "kf_id", *flat_pose("n", "n_"), F.transform(Q.quat_to_rot("n"), r6).alias("rot"))


@query(
    "pose_compose",
    _poses_sql(", ".join([S.rounded(S.compose(O, OPT), "c_"), S.rounded(S.inverse(O), "i_"), S.rounded(S.between(O, OPT), "b_")])),
)
def pose_compose(spark, sf):
    return keyframes(spark, sf).select(
        "map_id", "kf_id",
        *flat_pose(Q.pose_compose("odom", "opt"), "c_"),
        *flat_pose(Q.pose_inverse("odom"), "i_"),
        *flat_pose(Q.pose_between("odom", "opt"), "b_"),
    )


@query(
    "pose_distances",
    _poses_sql(
        ", ".join(
            [
                f"{S.r6('sqrt((o_tx-p_tx)**2+(o_ty-p_ty)**2+(o_tz-p_tz)**2)')} as dist",
                f"{S.r6(S.angle(S.between(O, OPT)))} as angle", f"{S.r6(S.yaw(OPT))} as yaw",
            ]
        )
    ),
)
def pose_distances(spark, sf):
    return keyframes(spark, sf).select(
        "map_id", "kf_id", r6(Q.translation_distance("odom", "opt")).alias("dist"),
        r6(Q.rotation_angle(Q.pose_between("odom", "opt"))).alias("angle"), r6(Q.yaw_of("opt")).alias("yaw"),
    )


def _up(p):
    x, y, z, w = p[3:]
    return f"2*({x}*{z}+{w}*{y})", f"2*({y}*{z}-{w}*{x})", f"(1-2*({x}*{x}+{y}*{y}))"


_PREV = (
    f"{KF} select k.map_id, k.kf_id, {{}} from keyframes k join keyframes j on k.map_id = j.map_id and k.kf_id = j.kf_id + 1"
)


def _with_prev(kf):
    prev = kf.select("map_id", (F.col("kf_id") + 1).alias("kf_id"), F.col("opt").alias("prev"))
    return kf.join(prev, ["map_id", "kf_id"])


_YAWDIFF = f"({S.yaw(_pref('k', OPT))} - {S.yaw(_pref('j', OPT))})"
_DOT = " + ".join(f"{a}*{b}" for a, b in zip(_up(_pref("k", OPT)), _up(_pref("j", OPT))))


@query(
    "pose_errors_deg",
    _PREV.format(
        f"{S.r6(f'abs(degrees({_YAWDIFF} - 2*pi()*round({_YAWDIFF}/(2*pi()))))')} as yaw_error, "
        f"round(degrees(acos(greatest(-1.0e0, least(1.0e0, {_DOT})))), 4) + 0e0 as roll_pitch_error"
    ),
)
def pose_errors_deg(spark, sf):
    return _with_prev(keyframes(spark, sf)).select(
        "map_id", "kf_id", r6(Q.planar_yaw_error_deg("opt", "prev")).alias("yaw_error"),
        (F.round(Q.roll_pitch_error_deg("opt", "prev"), 4) + F.lit(0.0)).alias("roll_pitch_error"),
    )


def _lerp_sql(a, b, t):
    dot = "(" + "+".join(f"{x}*{y}" for x, y in zip(a[3:], b[3:])) + ")"
    th = f"acos(least(1.0e0, abs({dot})))"
    near = f"abs({dot}) >= 1 - 1e-15"
    wa = f"(case when {near} then 1-{t} else sin((1-{t})*{th})/sin({th}) end)"
    wb = f"((case when {dot} < 0 then -1 else 1 end) * (case when {near} then {t} else sin({t}*{th})/sin({th}) end))"
    tr = [f"((1-{t})*{x}+{t}*{y})" for x, y in zip(a[:3], b[:3])]
    q = [f"({wa}*{x}+{wb}*{y})" for x, y in zip(a[3:], b[3:])]
    return tr, q


_LT, _LQ = _lerp_sql(_pref("j", OPT), _pref("k", OPT), "0.3e0")
_LIN = (
    f"{KF}, l as (select k.map_id, k.kf_id, "
    + ", ".join(f"{e} as {c}" for e, c in zip(_LT + _LQ, S.cols("l_")))
    + " from keyframes k join keyframes j on k.map_id = j.map_id and k.kf_id = j.kf_id + 1)"
)


@query(
    "pose_lerp",
    f"{_LIN} select map_id, kf_id, "
    + S.rounded(["l_tx", "l_ty", "l_tz"] + [f"{c}" for c in ("l_qx", "l_qy", "l_qz", "l_qw")], "l_")
    + " from l",
)
def pose_lerp(spark, sf):
    return _with_prev(keyframes(spark, sf)).select(
        "map_id", "kf_id", *flat_pose(Q.pose_lerp("prev", "opt", 0.3), "l_")
    )


@query("map_odom", _poses_sql(S.rounded(S.compose(OPT, S.inverse(O)), "t_")))
def map_odom(spark, sf):
    return keyframes(spark, sf).select("map_id", "kf_id", *flat_pose(Q.map_odom("opt", "odom"), "t_"))


@query(
    "stamps",
    "select event_id, event_id * 1000000000 + user_id as ns, (round((event_id * 1000000000 + user_id) * 1e-9, 6) + 0e0) as sec from events",
)
def stamps(spark, sf):
    from lidarlake.catalog.views import table

    ns = Q.stamp_ns("event_id", "user_id")
    return table(spark, sf, "events").select("event_id", ns.alias("ns"), r6(Q.ns_to_seconds(ns)).alias("sec"))


_AZ = "(case when degrees(atan2(y, x)) < 0 then degrees(atan2(y, x)) + 360 else degrees(atan2(y, x)) end)"
_PR = "sqrt(x*x+y*y)"


@query(
    "polar_bin",
    f"{with_views('points')} select map_id, kf_id, ring, sector, count(*) as n from (select *, greatest(0, least(19, floor(ln({_PR}/0.5e0)/ln(160)"
    f"*20)))::int as ring, greatest(0, least(59, floor({_AZ}/360*60)))::int as sector from points where {_PR} between 0.5 and 80) group by 1, 2, 3, 4",
)
def polar_bin(spark, sf):
    b = points(spark, sf).withColumn("b", C.polar_bin("x", "y")).filter("b is not null")
    return b.groupBy("map_id", "kf_id", "b.ring", "b.sector").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wrap_deg",
    f"{ODOM} select event_id, {S.r6('180 - ((180 - d) - 360*floor((180 - d)/360))')} as w180, {S.r6('d - 360*floor(d/360)')} as w360 from "
    "(select event_id, degrees(yaw)*7 - 1000 as d from odom)",
)
def wrap_deg(spark, sf):
    d = F.degrees("yaw") * 7 - 1000
    return view(spark, sf, "odom").select("event_id", r6(C.wrap_deg(d)).alias("w180"), r6(C.wrap360(d)).alias("w360"))


@query(
    "circshift",
    f"{with_views('vectors')} select pos, [{', '.join(S.r6(f'vec[{r * 16} + 1 + ((({c} - label) % 16) + 16) % 16]') for r in range(4) for c in range(16))}] as turned from vectors",
)
def circshift(spark, sf):
    v = view(spark, sf, "vectors")
    return v.select("pos", F.transform(C.circshift("vec", 4, 16, F.col("label")), r6).alias("turned"))


def _tri(i, j):
    i, j = min(i, j), max(i, j)
    return sum(6 - r for r in range(i)) + (j - i)


_SWAP = [3, 4, 5, 0, 1, 2]


@query(
    "reorder_information",
    f"{with_views('edges')} select map_id, to_id, ["
    + ", ".join(f"(info_kind + 1.0e0) * {_tri(_SWAP[i], _SWAP[j]) + 1}" for i in range(6) for j in range(i, 6))
    + "] as info from edges where info_kind between 1 and 4",
)
def reorder_information(spark, sf):
    e = edges(spark, sf).filter("size(info) = 21 and info[0] <> 0")
    return e.select("map_id", "to_id", C.reorder_information("info").alias("info"))


def _diag_sql(t, r):
    return "[" + ", ".join(S.r6(f"{v}e0") for v in C.diagonal_information(1 / (t * t), 1 / (r * r))) + "]"


@query(
    "edge_information",
    f"{with_views('edges')} select map_id, to_id, case when type = 'LOOP' then {_diag_sql(*C.NOISE['LOOP'])} else {_diag_sql(*C.NOISE['ODOMETRY'])} end as info from edges",
)
def edge_information(spark, sf):
    return edges(spark, sf).select(
        "map_id", "to_id", F.transform(C.edge_information(F.col("type")), r6).alias("info")
    )


@query(
    "edge_noise",
    f"{with_views('edges')} select map_id, to_id, case when info_kind = 0 then {S.r6('case when type = $$LOOP$$ then 4.0 else 10000.0 end')} else info_kind + 1.0e0 end as first_value from edges".replace("$$", "'"),
)
def edge_noise(spark, sf):
    e = posegraph.edge_noise(edges(spark, sf))
    return e.select("map_id", "to_id", r6(F.get("info", F.lit(0))).alias("first_value"))


_CONF = "greatest(0e0, least(1e0, exp(-fitness/0.15e0)))"
_FUSED = "(rhpd_distance/25.0e0 + 0.15e0*coalesce(sc_distance/0.6e0, 1.0e0))"
_LL = "(case when converged then -fitness/0.3e0 + 2*greatest(inlier_ratio, 0e0) - 0.2e0*rhpd_distance else -8.0e0 end)"
_TN = "sqrt(t_tx*t_tx+t_ty*t_ty+t_tz*t_tz)"
_ALPHA = (
    f"greatest(0.01e0, case when {_TN} <= 0.5 then least({_CONF}*0.3e0, 0.2e0) when {_TN} <= 2 then least({_CONF}*0.15e0, 0.1e0) "
    f"else least({_CONF}*0.08e0, 0.05e0) end)"
)


@query(
    "match_scores",
    f"{MATCHES} select match_id, {S.r6(_CONF)} as confidence, {S.r6(_FUSED)} as fused, {S.r6(_LL)} as reloc_ll, "
    f"{S.r6(_LL.replace('0.2e0*rhpd_distance', '0.5e0*' + _TN))} as track_ll, {S.r6(_ALPHA)} as alpha from matches",
)
def match_scores(spark, sf):
    return matches(spark, sf).withColumn("motion", Q.translation_norm("T")).select(
        "match_id",
        r6(C.confidence("fitness")).alias("confidence"),
        r6(C.fused_score("rhpd_distance", "sc_distance")).alias("fused"),
        r6(C.reloc_log_likelihood(distance="rhpd_distance")).alias("reloc_ll"),
        r6(C.track_log_likelihood()).alias("track_ll"),
        r6(C.blend_alpha(C.confidence("fitness"), "motion")).alias("alpha"),
    )


_RES = f"{MATCHES}, w as (select match_id, rhpd_distance / 10.0e0 as e from matches)"


@query(
    "robust_weight",
    f"{_RES} select match_id, {S.r6('case when e <= 1 then 1.0 else 1.0/e end')} as huber, {S.r6('1.0/(1.0+e*e)')} as cauchy, "
    f"{S.r6('case when e*e > 1 then (2.0/(1+e*e))**2 else 1.0 end')} as dcs from w",
)
def robust_weight(spark, sf):
    e = F.col("rhpd_distance") / 10.0
    names = {"huber": "Huber", "cauchy": "Cauchy", "dcs": "DCS"}
    return matches(spark, sf).select(
        "match_id", *(r6(C.robust_weight(e, kind)).alias(n) for n, kind in names.items())
    )


@query(
    "yaw_seeds",
    f"{MATCHES} select match_id, seed - 1 as seed, {S.r6('yaw')} as yaw from (select match_id, unnest(case when sc_distance is not null then "
    "[sc_distance, sc_distance - radians(6), sc_distance + radians(6)] else [0e0, pi()/2, pi(), 3*pi()/2] end) as yaw, "
    "unnest(case when sc_distance is not null then [1, 2, 3] else [1, 2, 3, 4] end) as seed from matches)",
)
def yaw_seeds(spark, sf):
    seeds = C.yaw_seeds("sc_distance", F.col("sc_distance").isNotNull())
    m = matches(spark, sf).select("match_id", F.posexplode(seeds).alias("seed", "yaw"))
    return m.select("match_id", "seed", r6("yaw").alias("yaw"))


@query(
    "trajectory_source_state",
    f"{with_views('maps')} select map_id, case trajectory_source when 'keyframe_fallback' then 'mixed_keyframe_fallback_and_high_rate' when 'native' "
    "then 'native' else 'native' end as after_append, case when map_id % 5 = 0 then 'none' when trajectory_source in ('', 'none') then 'native' else "
    "trajectory_source end as after_save from maps",
)
def trajectory_source_state(spark, sf):
    rows = F.col("map_id") % 5 != 0
    return view(spark, sf, "maps").select(
        "map_id", C.trajectory_source_state("trajectory_source", F.lit(True)).alias("after_append"),
        C.trajectory_source_state("trajectory_source", rows, "save").alias("after_save"),
    )


@query(
    "loop_filter",
    f"{MATCHES} select match_id from matches where verified and query_id >= 0 and match_id >= 0 and inlier_ratio >= 0.5 and fitness <= 0.3",
)
def loop_filter(spark, sf):
    return matches(spark, sf).filter(P.loop_passes()).select("match_id")


@query(
    "match_gates",
    f"{MATCHES} select match_id, converged and fitness < 0.3 and inlier_ratio >= 0.5 and {_TN} <= 5 and {S.angle(S.cols('t_'))} <= 0.5 as registration_ok, "
    f"converged and fitness < 0.3 and inlier_ratio >= 0.03 and {_CONF} >= 0.3 as reloc_ok from matches",
)
def match_gates(spark, sf):
    return matches(spark, sf).select(
        "match_id", P.registration_passes().alias("registration_ok"), P.reloc_passes().alias("reloc_ok")
    )


# --- joins in time and by id ------------------------------------------------------------------

DAY = 86400.0
_VIEWS2 = f"{ODOM}, a as (select session_id, event_id, ts, tx from odom where event_type <> 'view'), b as (select session_id, event_id as b_id, ts as b_ts, tx as b_tx from odom where event_type = 'view')"
_NEAREST = (
    "select a.session_id, a.event_id, b.b_id, abs(a.ts - b.b_ts) as gap, row_number() over (partition by a.event_id order by abs(a.ts - b.b_ts), "
    "b.b_ts, b.b_id) as rn from a join b on a.session_id = b.session_id"
)


def _sides(spark, sf):
    o = odom_frames(spark, sf)
    a = o.filter("event_type <> 'view'").select("session_id", "event_id", "ts", "pose")
    b = o.filter("event_type = 'view'").select("session_id", F.col("event_id").alias("kf_id"), "ts", "pose")
    return a, b


@query(
    "sync_nearest",
    f"{_VIEWS2} select session_id, event_id, b_id, {S.r6('gap')} as gap from ({_NEAREST}) where rn = 1 and gap <= 7200",
)
def sync_nearest(spark, sf):
    a, b = _sides(spark, sf)
    out = sequence.sync_nearest(a, b, ["session_id"], 7200.0, order="kf_id", chunk_seconds=10 * DAY)
    return out.select(
        "session_id", "event_id", F.col("nearest.kf_id").alias("b_id"), r6(F.abs(F.col("nearest.ts") - F.col("ts"))).alias("gap")
    )


@query(
    "asof_backward",
    f"{_VIEWS2}, j as (select a.session_id, a.event_id, b.b_id from a asof left join b on a.session_id = b.session_id and a.ts >= b.b_ts), f as (select "
    "session_id, min(b_id) as first_id from b group by 1) select j.session_id, event_id, coalesce(b_id, first_id) as anchor_id from j left join f on "
    "j.session_id = f.session_id",
)
def asof_backward(spark, sf):
    a, b = _sides(spark, sf)
    out = sequence.asof_backward(a, b, ["session_id"], chunk_seconds=10 * DAY)
    return out.select("session_id", "event_id", F.col("anchor.kf_id").alias("anchor_id"))


@query(
    "asof_bracket",
    f"{_VIEWS2} select x.session_id, x.event_id, x.b_id as before_id, y.b_id as after_id from (select a.session_id, a.event_id, b.b_id from a asof left "
    "join b on a.session_id = b.session_id and a.ts >= b.b_ts) x join (select a.session_id, a.event_id, b.b_id from a asof left join b on a.session_id = "
    "b.session_id and a.ts <= b.b_ts) y on x.event_id = y.event_id",
)
def asof_bracket(spark, sf):
    a, b = _sides(spark, sf)
    out = sequence.asof_bracket(a, b, ["session_id"], chunk_seconds=10 * DAY)
    return out.select(
        "session_id", "event_id", F.col("before.kf_id").alias("before_id"), F.col("after.kf_id").alias("after_id")
    )


@query("nearest_by_time", f"{_VIEWS2} select session_id, event_id, b_id as kf_id from ({_NEAREST}) where rn = 1")
def nearest_by_time(spark, sf):
    a, b = _sides(spark, sf)
    out = sequence.nearest_by_time(a, b, ["session_id"], chunk_seconds=10 * DAY)
    return out.filter("nearest is not null").select("session_id", "event_id", F.col("nearest.kf_id").alias("kf_id"))


_SPOT = (
    "{}, s as (select k.map_id, o.event_id as query_id, k.kf_id, sqrt((o.tx - k.p_tx)**2 + (o.ty - k.p_ty)**2 + k.p_tz**2) as distance from "
    "odom o join keyframes k on o.session_id % 4 = k.map_id), r as (select *, row_number() over (partition by query_id order by distance, kf_id) as rn from s {}) "
).format(with_views("odom", "keyframes"), "{}")


def _spots(spark, sf):
    return odom_frames(spark, sf).select(
        (F.col("session_id") % 4).alias("map_id"), F.col("event_id").alias("query_id"),
        F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(0.0).alias("z"),
    )


@query("nearest_by_position", _SPOT.format("") + f"select map_id, query_id, kf_id, {S.r6('distance')} as distance from r where rn = 1")
def nearest_position(spark, sf):
    out = nearest_by_position(_spots(spark, sf), keyframes(spark, sf))
    return out.withColumn("distance", r6("distance"))


@query(
    "nearest_by_position_radius",
    _SPOT.format("where distance < 20") + f"select map_id, query_id, kf_id, {S.r6('distance')} as distance from r where rn = 1",
)
def nearest_position_radius(spark, sf):
    out = nearest_by_position(_spots(spark, sf), keyframes(spark, sf), radius=20.0)
    return out.withColumn("distance", r6("distance"))


@query("monotone_time", f"{ODOM} select event_id from (select event_id, ts, max(ts) over (partition by session_id order by event_id rows between unbounded "
       "preceding and 1 preceding) as seen from odom) where seen is null or ts > seen")  # fmt: skip
def monotone_time(spark, sf):
    o = view(spark, sf, "odom")
    return sequence.monotone_time(o, ["session_id"], "event_id", chunk_size=2000).select("event_id")


_RESID_CTE = (
    f"{with_views('edges', 'keyframes')}, rel as (select e.*, "
    + S.named(S.between(_pref("a", OPT), _pref("b", OPT)), "d_")
    + " from edges e join keyframes a on e.map_id = a.map_id and e.from_id = a.kf_id join keyframes b on e.map_id = b.map_id and e.to_id = b.kf_id), "
    "res as (select map_id, from_id, to_id, type, " + S.named(S.compose(S.inverse(M), S.cols("d_")), "r_") + " from rel)"
)
_RN = (S.norm(S.cols("r_")), S.angle(S.cols("r_")))


def opt_poses(spark, sf):
    return keyframes(spark, sf).select("map_id", "kf_id", F.col("opt").alias("pose"))


@query(
    "edge_residuals",
    f"{_RESID_CTE} select map_id, from_id, to_id, {S.r6(_RN[0])} as residual_t, {S.r6(_RN[1])} as residual_r from res",
)
def edge_residuals(spark, sf):
    r = posegraph.edge_residuals(edges(spark, sf), opt_poses(spark, sf))
    return r.select("map_id", "from_id", "to_id", r6("residual_t").alias("residual_t"), r6("residual_r").alias("residual_r"))


@query(
    "mean_residual",
    f"{_RESID_CTE} select map_id, {S.r6(f'avg({_RN[0]})')} as mean_t, {S.r6(f'avg({_RN[1]})')} as mean_r, count(*) as edges from res group by 1",
)
def mean_residual(spark, sf):
    r = posegraph.mean_residual(edges(spark, sf), opt_poses(spark, sf))
    return r.withColumn("mean_t", r6("mean_t")).withColumn("mean_r", r6("mean_r"))


_DELTA = S.between(O, OPT)
_DELTA_SQL = (
    f"{KF} select map_id, " + ", ".join(
        f"{S.r6(f'{f}({e})')} as {n}" for n, f, e in (
            ("sum_t", "sum", S.norm(_DELTA)), ("sum_r", "sum", S.angle(_DELTA)), ("max_t", "max", S.norm(_DELTA)),
            ("max_r", "max", S.angle(_DELTA)), ("mean_t", "avg", S.norm(_DELTA)), ("mean_r", "avg", S.angle(_DELTA)),
        )
    ) + ", count(*) as count from keyframes group by 1"
)
_DELTA_COLS = ("sum_t", "sum_r", "max_t", "max_r", "mean_t", "mean_r")


@query("pose_delta", _DELTA_SQL)
def pose_delta(spark, sf):
    k = keyframes(spark, sf)
    d = posegraph.pose_delta(k.withColumn("pose", F.col("odom")), k.withColumn("pose", F.col("opt")))
    return d.withColumns({c: r6(c) for c in _DELTA_COLS})


@query("running_mean_combine", _DELTA_SQL)
def running_mean_combine(spark, sf):
    k = keyframes(spark, sf)
    parts = [
        posegraph.pose_delta(p.withColumn("pose", F.col("odom")), p.withColumn("pose", F.col("opt")))
        for p in (k.filter("from_loaded"), k.filter("not from_loaded"))
    ]
    d = posegraph.running_mean_combine(parts[0].unionByName(parts[1]))
    return d.withColumns({c: r6(c) for c in _DELTA_COLS})


@query(
    "refresh_poses",
    f"{KF} select map_id, kf_id, {S.r6('case when kf_id % 3 = 0 then o_tx else p_tx end')} as tx from keyframes",
)
def refresh_poses(spark, sf):
    k = keyframes(spark, sf)
    new = k.filter("kf_id % 3 = 0").select("map_id", "kf_id", F.col("odom").alias("pose"))
    return mapcheck.refresh_poses(k, new).select("map_id", "kf_id", r6("opt.tx").alias("tx"))


@query(
    "pose_lookup",
    f"{KF} select map_id, kf_id, {S.r6('case when kf_id % 3 = 0 then p_tx else o_tx end')} as tx from keyframes where kf_id % 3 = 0 or kf_id % 2 = 0",
)
def pose_lookup(spark, sf):
    k = keyframes(spark, sf)
    now = k.filter("kf_id % 3 = 0").withColumn("pose", F.col("opt"))
    first = k.filter("kf_id % 2 = 0").withColumn("pose", F.col("odom"))
    return mapcheck.pose_lookup(now, first).select("map_id", "kf_id", r6("pose.tx").alias("tx"))


@query(
    "keep_last_good",
    f"{KF} select map_id, kf_id, {S.r6('case when map_id = 1 then o_tx else p_tx end')} as tx, map_id = 1 as reverted from keyframes",
)
def keep_last_good(spark, sf):
    k = keyframes(spark, sf)
    nan = F.when(F.col("kf_id") == 30, F.lit(float("nan"))).otherwise(F.col("opt.tx"))
    bad = k.withColumn("pose", F.col("opt").withField("tx", nan))
    out = posegraph.keep_last_good(k.withColumn("pose", F.col("odom")), bad)
    return out.select("map_id", "kf_id", r6("pose.tx").alias("tx"), "reverted")


@query(
    "odometry_edges",
    _PREV.format(
        "k.kf_id - 1 as from_id, " + S.rounded(S.between(_pref("j", O), _pref("k", O)), "m_") + ", 'ODOMETRY' as type"
    ).replace("k.kf_id, ", "k.kf_id as to_id, ", 1),
)
def odometry_edges(spark, sf):
    e = ranking.odometry_edges(keyframes(spark, sf))
    return e.select("map_id", "to_id", "from_id", *flat_pose("meas", "m_"), "type")


@query(
    "bridge_edge",
    f"{KF}, n as (select map_id, min(kf_id) as to_id from keyframes where not from_loaded group by 1), l as (select map_id, min(kf_id) as match_id, case when "
    "map_id % 2 = 0 then max(kf_id) end as last_id from keyframes where from_loaded group by 1) select n.map_id, a.kf_id as from_id, n.to_id, case when last_id is "
    "null then 'LOOP' else 'ODOMETRY' end as type, " + S.rounded(S.between(_pref("a", OPT), _pref("b", O)), "m_")
    + " from n join l on n.map_id = l.map_id join keyframes a on a.map_id = l.map_id and a.kf_id = coalesce(last_id, match_id) join keyframes b on b.map_id = n.map_id and b.kf_id = n.to_id",
)
def bridge_edge(spark, sf):
    k = keyframes(spark, sf)
    old = k.filter("from_loaded")
    locks = old.groupBy("map_id").agg(F.min("kf_id").alias("match_id"), F.max("kf_id").alias("_m")).select(
        "map_id", "match_id", F.when(F.col("map_id") % 2 == 0, F.col("_m")).alias("last_id")
    )
    e = ranking.bridge_edge(k.filter("not from_loaded"), locks, old)
    return e.select("map_id", "from_id", "to_id", "type", *flat_pose("meas", "m_"))


@query("anchor_row", f"{KF} select map_id, min(kf_id) as kf_id, {S.r6('arg_min(p_tx, kf_id)')} as tx from keyframes group by 1")
def anchor_row(spark, sf):
    return ranking.anchor_row(keyframes(spark, sf)).select("map_id", "kf_id", r6("opt.tx").alias("tx"))


@query("latest_keyframe", f"{KF} select map_id, max(kf_id) as kf_id, {S.r6('arg_max(p_tx, kf_id)')} as tx from keyframes group by 1")
def latest_keyframe(spark, sf):
    return ranking.latest_keyframe(keyframes(spark, sf)).select("map_id", "kf_id", r6("opt.tx").alias("tx"))


@query(
    "keyframe_path",
    f"{KF} select map_id, kf_id, {S.r6('p_tx')} as tx, {S.r6('p_ty')} as ty, {S.r6('p_tz')} as tz, case when from_loaded then 'loaded' else 'new' end as origin from keyframes",
)
def keyframe_path(spark, sf):
    return ranking.path(keyframes(spark, sf)).withColumns({c: r6(c) for c in ("tx", "ty", "tz")})


@query(
    "by_id",
    f"{with_views('keyframes', 'edges')} select e.map_id, e.from_id as kf_id, {S.r6('p_tx')} as tx from edges e left join keyframes k on e.map_id = k.map_id and e.from_id = k.kf_id",
)
def by_id(spark, sf):
    ids = edges(spark, sf).select("map_id", F.col("from_id").alias("kf_id"))
    return ranking.by_id(keyframes(spark, sf), ids).select("map_id", "kf_id", r6("opt.tx").alias("tx"))


@query(
    "assign_ids",
    f"{with_views('odom', 'keyframes')}, m as (select map_id, max(kf_id) as max_id from keyframes group by 1) select o.map_id, event_id, coalesce(max_id, -1) + "
    "row_number() over (partition by o.map_id order by event_id) as kf_id from (select session_id % 7 as map_id, event_id from odom) o "
    "left join m on o.map_id = m.map_id",
)
def assign_ids(spark, sf):
    o = view(spark, sf, "odom").select((F.col("session_id") % 7).alias("map_id"), "event_id")
    top = keyframes(spark, sf).groupBy("map_id").agg(F.max("kf_id").alias("max_id"))
    return ranking.assign_ids(o, top, "event_id")


@query(
    "sample_every",
    f"{KF} select map_id, kf_id from (select map_id, kf_id, row_number() over (partition by map_id order by kf_id) - 1 as pos, count(*) over (partition by map_id) as n "
    "from keyframes) where pos % greatest(1, ceil(n / 10.0))::int = 0 and pos / greatest(1, ceil(n / 10.0)) < 10",
)
def sample_every(spark, sf):
    return ranking.sample_every(keyframes(spark, sf), 10).select("map_id", "kf_id")


@query(
    "lock_counter",
    f"{ODOM} select session_id, event_id, row_number() over (partition by session_id order by seq) as lock_count from odom where value > 90",
)
def lock_counter(spark, sf):
    o = view(spark, sf, "odom").withColumn("locked", F.col("value") > 90)
    return mapcheck.lock_counter(o).select("session_id", "event_id", "lock_count")


# --- trajectories -----------------------------------------------------------------------------


def _samples(spark, sf):
    """Odometry rows of one session per map, in the time of the map's keyframes."""
    o = odom_frames(spark, sf)
    return o.select(
        (F.col("session_id") % 4).alias("map_id"), F.col("event_id").alias("seq"),
        ((F.col("event_id") * 37) % 11000 / 100.0).alias("ts"), F.col("pose").alias("raw"),
        F.when(F.col("event_id") % 3 > 0, (F.col("session_id") % 4) * 25 + F.col("event_id") % 30).alias("anchor_id"),
        F.col("pose").withField("ty", F.lit(0.5)).alias("anchor_raw"), (F.col("event_id") % 2 == 0).alias("use_bracket"),
    )


_RAW = ["s.tx", "s.ty", "0e0", "0e0", "0e0", "sin(s.yaw/2)", "cos(s.yaw/2)"]
_ARAW = ["s.tx", "0.5e0", "0e0", "0e0", "0e0", "sin(s.yaw/2)", "cos(s.yaw/2)"]
_SAMPLE_CTE = (
    f"{with_views('odom', 'keyframes')}, s as (select session_id % 4 as map_id, event_id as seq, (event_id * 37) % 11000 / 100.0e0 as ts, tx, ty, yaw, case when "
    "event_id % 3 > 0 then (session_id % 4) * 25 + event_id % 30 end as anchor_id, event_id % 2 = 0 as use_bracket from odom)"
)


def _corr(k):
    return S.compose(_pref(k, OPT), S.inverse(_pref(k, O)))


_CB, _CA = S.cols("cb_"), S.cols("ca_")
_CT, _CQ = _lerp_sql(_CB, _CA, "alpha")
_C = S.cols("c_")
_FIX = S.compose(_pref("k", OPT), S.inverse(_ARAW))
_DENSE = (
    f"{_SAMPLE_CTE}, kb as (select s.seq, k.kf_id from s asof join keyframes k on s.map_id = k.map_id and s.ts >= k.ts), ka as (select s.seq, k.kf_id from s asof join "
    "keyframes k on s.map_id = k.map_id and s.ts <= k.ts), br as (select s.seq, coalesce(kb.kf_id, ka.kf_id) as b_id, coalesce(ka.kf_id, kb.kf_id) as a_id from s left "
    "join kb on s.seq = kb.seq left join ka on s.seq = ka.seq), "
    f"cc as (select s.seq, case when a.ts - b.ts > 1e-9 then greatest(0e0, least(1e0, (s.ts - b.ts)/(a.ts - b.ts))) else 0e0 end as alpha, {S.named(_corr('b'), 'cb_')}, "
    f"{S.named(_corr('a'), 'ca_')} from s join br on s.seq = br.seq join keyframes b on b.map_id = s.map_id and b.kf_id = br.b_id join keyframes a on a.map_id = s.map_id "
    f"and a.kf_id = br.a_id), c0 as (select seq, {', '.join(f'{e} as {c}' for e, c in zip(_CT + _CQ, _C))} from cc), c1 as (select * from c0), "
    + f"fx as (select s.seq, {S.named(_FIX, 'f_')} from s join keyframes k on s.map_id = k.map_id and s.anchor_id = k.kf_id), "
    f"j as (select s.*, {', '.join(f'c1.{c}' for c in _C)}, {', '.join(f'fx.{c}' for c in S.cols('f_'))} from s left join c1 on s.seq = c1.seq left join fx on s.seq = fx.seq) "
    "select map_id, seq, "
    + ", ".join(
        S.r6(f"case when use_bracket and c_qw is not null then {x} when not use_bracket and f_qw is not null then {y} else {z} end") + f" as p_{f}"
        for x, y, z, f in zip(S.compose(_C, _RAW), S.compose(S.cols("f_"), _RAW), _RAW, ("tx", "ty", "tz", "qx", "qy", "qz", "qw"))
    )
    + " from j s"
)


@query("dense_trajectory", _DENSE)
def dense_trajectory(spark, sf):
    t = trajectory.dense_trajectory(_samples(spark, sf), keyframes(spark, sf))
    return t.select("map_id", "seq", *flat_pose("pose", "p_"))


@query(
    "reanchor_trajectory",
    f"{_SAMPLE_CTE}, f as (select map_id, min(kf_id) as first_id from keyframes group by 1), j as (select s.map_id, s.seq, k.kf_id from s asof left join keyframes k on "
    "s.map_id = k.map_id and s.ts >= k.ts), t as (select j.map_id, seq, coalesce(kf_id, first_id) as anchor_id from j left join f on j.map_id = f.map_id) select t.map_id, "
    f"seq, anchor_id, {S.r6('p_tx')} as anchor_tx from t left join keyframes k on t.map_id = k.map_id and t.anchor_id = k.kf_id",
)
def reanchor_trajectory(spark, sf):
    loaded = _samples(spark, sf).select("map_id", "seq", "ts", F.col("raw").alias("pose"))
    t = trajectory.reanchor_trajectory(loaded, keyframes(spark, sf))
    return t.select("map_id", "seq", "anchor_id", r6("anchor_raw.tx").alias("anchor_tx"))


@query(
    "record_trajectory",
    f"{_SAMPLE_CTE} select s.map_id, s.seq, k.kf_id as anchor_id, {S.r6('case when k.from_loaded then k.p_tx else k.o_tx end')} as anchor_tx from s asof left join "
    "keyframes k on s.map_id = k.map_id and s.ts >= k.ts",
)
def record_trajectory(spark, sf):
    odom = _samples(spark, sf).select("map_id", "seq", "ts", F.col("raw").alias("pose"))
    t = trajectory.record_trajectory(odom, keyframes(spark, sf))
    return t.select("map_id", "seq", "anchor_id", r6("anchor_raw.tx").alias("anchor_tx"))


# Chained odometry telescopes: every pose is the anchor's correction times the keyframe's odometry.
_FIRST = "a as (select * from keyframes where kf_id in (select min(kf_id) from keyframes group by map_id)), "


@query(
    "initial_values",
    f"{KF}, {_FIRST} c as (select a.map_id, {S.named(_corr('a'), 'c_')} from a) select k.map_id, k.kf_id, "
    + S.rounded(S.compose(S.cols("c_"), _pref("k", O)), "p_")
    + " from keyframes k join c on k.map_id = c.map_id",
)
def initial_values(spark, sf):
    e = ranking.odometry_edges(keyframes(spark, sf))
    anchors = ranking.anchor_row(keyframes(spark, sf))
    out = posegraph.initial_values(e, anchors, chunk=8)
    return out.select("map_id", "kf_id", *flat_pose("pose", "p_"))
