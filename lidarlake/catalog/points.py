"""Queries over points: predicates, filters, voxels, bounds, submaps, metadata."""

from pyspark.sql import functions as F

from lidarlake.catalog import sqlpose as S
from lidarlake.catalog.registry import query
from lidarlake.catalog.views import edges, r6, table, view, with_views
from lidarlake.functions import predicates as P
from lidarlake.functions import scores as C
from lidarlake.operators import clouds, mapcheck
from lidarlake.operators.mapcheck import CLOUD

RULES = {
    "min_range": 2.0, "max_range": 30.0, "self_box": (-3.0, 1.5, -2.0, 2.0, -1.0, 1.0),
    "center_deg": 180.0, "width_deg": 45.0,
}


def points(spark, sf):
    return view(spark, sf, "points")


def keyframes(spark, sf):
    return view(spark, sf, "keyframes")


def holes(df):
    """Points with some coordinates made non-finite, for the validation queries."""
    k = F.col("pt_id") % 13
    return df.withColumn("x", F.when(k == 1, F.lit(float("nan"))).otherwise(F.col("x"))).withColumn(
        "intensity", F.when(k == 2, F.lit(float("inf"))).otherwise(F.col("intensity"))
    )


HOLES = (
    "holes as (select map_id, kf_id, pt_id, case when pt_id % 13 = 1 then 'nan'::double else x end as x, y, z, "
    "case when pt_id % 13 = 2 then 'inf'::double else intensity end as intensity from points)"
)
FIN_XYZ = "isfinite(x) and isfinite(y) and isfinite(z)"
FIN = FIN_XYZ + " and isfinite(intensity)"
WORLD = (
    "world as (select k.map_id, p.kf_id, p.pt_id, "
    + ", ".join(
        f"{e} as {n}" for e, n in zip(S.transform(["k." + c for c in S.cols("p_")], ("p.x", "p.y", "p.z")), "xyz")
    )
    + ", p.intensity from points p join keyframes k on p.map_id = k.map_id and p.kf_id = k.kf_id)"
)
POINTS = with_views("points")
POINTS_KF = with_views("points", "keyframes")


def vox(leaf, x="x", y="y", z="z"):
    inv = f"(1.0e0 / {leaf}e0)"
    return ", ".join(f"cast(floor({v} * {inv}) as bigint) as v{n}" for v, n in zip((x, y, z), "xyz"))


MEANS = ", ".join(f"{S.r6(f'avg({c})')} as {c}" for c in ("x", "y", "z", "intensity"))


@query(
    "global_map_voxels",
    f"{POINTS_KF}, {WORLD} select map_id, vx, vy, vz, count(*) as n, {MEANS} from "
    f"(select *, {vox(0.5)} from world where {FIN_XYZ}) group by map_id, vx, vy, vz",
)
def global_map_voxels(spark, sf):
    world = clouds.transform_points(points(spark, sf), keyframes(spark, sf))
    out = clouds.voxel_centroid(world, 0.5)
    return out.select("map_id", "vx", "vy", "vz", "n", *(r6(c).alias(c) for c in ("x", "y", "z", "intensity")))


@query(
    "finite_points",
    f"{POINTS}, {HOLES} select map_id, kf_id, count(*) as n, sum(case when {FIN_XYZ} then 1 else 0 end) as n_xyz, "
    f"sum(case when {FIN} then 1 else 0 end) as n_all from holes group by map_id, kf_id",
)
def finite_points(spark, sf):
    return holes(points(spark, sf)).groupBy(*CLOUD).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(P.is_finite_point()).alias("n_xyz"),
        F.count_if(P.is_finite_point("x", "y", "z", "intensity")).alias("n_all"),
    )


@query(
    "finite_poses",
    f"{with_views('keyframes')} select kf_id, isfinite(case when kf_id % 4 = 0 then 'nan'::double else o_tx end) and "
    "(case when kf_id % 5 = 0 then 0.0 else 1.0 end) * (o_qx*o_qx+o_qy*o_qy+o_qz*o_qz+o_qw*o_qw) > 1e-12 as ok "
    "from keyframes",
)
def finite_poses(spark, sf):
    k = F.col("kf_id")
    p = F.col("odom")
    nan = F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(p["tx"])
    zero = k % 5 == 0
    q = [F.when(zero, 0.0).otherwise(p[c]).alias(c) for c in ("qx", "qy", "qz", "qw")]
    bad = F.struct(nan.alias("tx"), p["ty"].alias("ty"), p["tz"].alias("tz"), *q)
    return keyframes(spark, sf).select("kf_id", P.is_finite_pose(bad).alias("ok"))


@query(
    "voxel_coord_in_range",
    f"{POINTS} select map_id, kf_id, sum(case when abs(floor(x * 1e6)) <= 16777216 and floor(x * 1e6) <= 16777215 and "
    "floor(y * 1e6) between -16777216 and 16777215 and floor(z * 1e6) between -16777216 and 16777215 then 1 else 0 "
    "end) as n_ok from points group by map_id, kf_id",
)
def voxel_coord_in_range(spark, sf):
    ok = P.voxel_coord_in_range("x", "y", "z", 1e-6, bits=24)
    return points(spark, sf).groupBy(*CLOUD).agg(F.count_if(ok).alias("n_ok"))


@query(
    "voxel_extent_ok",
    f"{POINTS}, b as (select map_id, kf_id, "
    + ", ".join(f"cast(floor(max({c}) / 0.001e0) - floor(min({c}) / 0.001e0) + 1 as bigint) as n{c}" for c in "xyz")
    + " from points group by map_id, kf_id) select *, greatest(nx, ny, nz) <= 2147483647 and nx::double * ny * nz <= "
    "2147483647 as extent_ok from b",
)
def voxel_extent_ok(spark, sf):
    return clouds.voxel_extent_ok(points(spark, sf), 0.001)


def _checked_keyframes(spark, sf):
    kf = keyframes(spark, sf)
    k = F.col("kf_id")
    kf = kf.withColumn("ts", F.when(k % 33 == 3, F.lit(float("nan"))).otherwise(F.col("ts")))
    kf = kf.unionByName(kf.filter(k % 50 == 32)).withColumn(
        "kf_id", F.when(k % 51 == 4, -k).otherwise(k)
    )
    pts = points(spark, sf).withColumn("z", F.when(F.col("kf_id") % 57 == 5, F.lit(float("inf"))).otherwise(F.col("z")))
    return mapcheck.validate_keyframes(kf, pts)


_CHECKED = (
    f"{POINTS_KF}, k0 as (select map_id, kf_id, case when kf_id % 33 = 3 then 'nan'::double else ts end as ts from "
    "keyframes), k1 as (select map_id, case when kf_id % 51 = 4 then -kf_id else kf_id end as kf_id, ts from (select * "
    "from k0 union all select * from k0 where kf_id % 50 = 32)), c as (select map_id, kf_id, bool_or(kf_id % 57 = 5) as "
    "bad from points group by map_id, kf_id), k2 as (select k1.*, case when k1.kf_id < 0 then 'invalid id' when not "
    "isfinite(ts) then 'non-finite time' when c.bad is null then 'empty cloud' when c.bad then 'non-finite point' end "
    "as r from k1 left join c on k1.map_id = c.map_id and k1.kf_id = c.kf_id), k3 as (select map_id, kf_id, ts, "
    "coalesce(r, case when count(*) filter (where r is null) over (partition by map_id, kf_id) > 1 then 'duplicate id' "
    "end) as reason from k2)"
)


@query("validate_keyframes", f"{_CHECKED} select map_id, kf_id, reason from k3")
def validate_keyframes(spark, sf):
    return _checked_keyframes(spark, sf).select("map_id", "kf_id", "reason")


@query(
    "accepted_keyframes",
    f"{_CHECKED} select 'SALVAGE' as policy, map_id, kf_id from k3 where reason is null and map_id not in (select map_id "
    "from k3 where reason = 'duplicate id') union all select 'STRICT', map_id, kf_id from k3 where reason is null and "
    "map_id not in (select map_id from k3 where reason is not null)",
)
def accepted_keyframes(spark, sf):
    checked = _checked_keyframes(spark, sf)
    parts = [
        mapcheck.accepted_keyframes(checked, p).select(F.lit(p).alias("policy"), "map_id", "kf_id")
        for p in ("SALVAGE", "STRICT")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "validate_cloud_layout",
    f"{POINTS} select kf_id, count(*) as n, true as ok, false as short, count(*) <= 600 as capped from points group by kf_id",
)
def validate_cloud_layout(spark, sf):
    flat = points(spark, sf).groupBy("kf_id").agg(
        F.flatten(F.collect_list(F.array("x", "y", "z", "intensity"))).alias("v"), F.count(F.lit(1)).alias("n")
    )
    return flat.select(
        "kf_id", "n", P.cloud_layout_ok("v", "n").alias("ok"),
        P.cloud_layout_ok(F.slice("v", F.lit(1), F.size("v") - 1), "n").alias("short"),
        P.cloud_layout_ok("v", "n", cap=600).alias("capped"),
    )


@query(
    "validate_descriptors",
    f"{with_views('vectors')} select pos, label % 3 <> 0 as kept, label % 3 <> 0 as same from vectors",
)
def validate_descriptors(spark, sf):
    v = view(spark, sf, "vectors")
    bad = F.when(F.col("label") % 3 == 0, F.concat(F.slice("vec", 1, 63), F.array(F.lit(float("nan"))))).otherwise(F.col("vec"))
    checked = v.withColumn("d", P.valid_descriptor(bad, 8, 8))
    return checked.select("pos", F.col("d").isNotNull().alias("kept"), F.coalesce(F.col("d") == F.col("vec"), F.lit(False)).alias("same"))


def _tri(i, j):
    i, j = min(i, j), max(i, j)
    return sum(6 - r for r in range(i)) + (j - i)


@query(
    "unpack_information",
    f"{with_views('edges')} select map_id, to_id, case when info_kind between 1 and 4 then ["
    + ", ".join(f"(info_kind + 1.0e0) * {_tri(i, j) + 1}" for i in range(6) for j in range(6))
    + "] when info_kind = 0 then [" + ", ".join(["0.0e0"] * 36) + "] end as full_info from edges",
)
def unpack_information(spark, sf):
    return edges(spark, sf).select("map_id", "to_id", C.unpack_information("info").alias("full_info"))


@query(
    "validate_edges",
    f"{with_views('edges', 'keyframes')} select e.map_id, from_id, to_id, case when info_kind = 5 then 'malformed edge' "
    "when a.kf_id is null or b.kf_id is null then 'missing endpoint' end as reason from edges e left join keyframes a on "
    "e.map_id = a.map_id and e.from_id = a.kf_id left join keyframes b on e.map_id = b.map_id and e.to_id = b.kf_id",
)
def validate_edges(spark, sf):
    return mapcheck.validate_edges(edges(spark, sf), keyframes(spark, sf)).select("map_id", "from_id", "to_id", "reason")


@query(
    "validate_trajectory",
    f"{with_views('odom', 'maps')} select o.map_id, n as rows, bad as bad_rows, trajectory_source, case when "
    "trajectory_source = 'none' then 'invalid source' when bad > 0 then 'non-finite pose' end as reason from (select "
    "session_id % 25 as map_id, count(*) as n, sum(case when event_id % 3001 = 5 then 1 else 0 end) as bad from odom "
    "group by 1) o left join maps m on o.map_id = m.map_id",
)
def validate_trajectory(spark, sf):
    from lidarlake.catalog.views import odom_frames

    t = odom_frames(spark, sf).select(
        (F.col("session_id") % 25).alias("map_id"),
        F.when(F.col("event_id") % 3001 == 5, F.lit(float("nan"))).otherwise(F.col("ts")).alias("ts"),
        "pose",
    )
    return mapcheck.validate_trajectory(t, view(spark, sf, "maps"))


_ANG = "degrees(atan2(y, x))"
_DIFF = f"(180 - ((180 - ({_ANG} - 180)) - 360 * floor((180 - ({_ANG} - 180)) / 360)))"
_REAR = f"abs({_DIFF}) <= 22.5 + 1e-6"


@query(
    "rear_sector",
    f"{POINTS} select map_id, kf_id, sum(case when {_REAR} then 1 else 0 end) as rear, sum(case when {_REAR.replace('y, x', '-x, y')} "
    "then 1 else 0 end) as rear_y from points group by map_id, kf_id",
)
def rear_sector(spark, sf):
    return points(spark, sf).groupBy(*CLOUD).agg(
        F.count_if(P.rear_sector()).alias("rear"), F.count_if(P.rear_sector(axis="y")).alias("rear_y")
    )


_BOX = "x between -3.0 and 1.5 and y between -2.0 and 2.0 and z between -1.0 and 1.0"


@query(
    "out_of_range_and_self_box",
    f"{POINTS} select map_id, kf_id, sum(case when sqrt(x*x+y*y) < 2 or sqrt(x*x+y*y) > 30 then 1 else 0 end) as out_of_range, "
    f"sum(case when {_BOX} then 1 else 0 end) as self_box from points group by map_id, kf_id",
)
def out_of_range_and_self_box(spark, sf):
    return points(spark, sf).groupBy(*CLOUD).agg(
        F.count_if(P.out_of_range("x", "y", 2.0, 30.0)).alias("out_of_range"),
        F.count_if(P.self_box("x", "y", "z", RULES["self_box"])).alias("self_box"),
    )


_REASON = (
    f"case when not ({FIN}) then 'non_finite' when sqrt(x*x+y*y) < 2 or sqrt(x*x+y*y) > 30 then 'range' when {_BOX} then "
    f"'self' when {_REAR} then 'rear' else 'keep' end"
)
_CLASSIFIED = f"{POINTS}, {HOLES}, cls as (select *, {_REASON} as reason from holes)"
_CLASSIFIED_KF = f"{POINTS_KF}, {HOLES}, cls as (select *, {_REASON} as reason from holes)"
_CLASSIFIED_MAPS = f"{with_views('points', 'maps')}, {HOLES}, cls as (select *, {_REASON} as reason from holes)"


def classified(spark, sf):
    return mapcheck.classify_point(holes(points(spark, sf)), RULES)


@query("classify_point", f"{_CLASSIFIED} select map_id, reason, count(*) as n from cls group by map_id, reason")
def classify_point(spark, sf):
    return classified(spark, sf).groupBy("map_id", "reason").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = (
    "count(*) as original_points, sum(case when reason = 'keep' then 1 else 0 end) as kept_points, sum(case when reason <> 'keep' then 1 "
    "else 0 end) as removed_points, "
    + ", ".join(f"sum(case when reason = '{r}' then 1 else 0 end) as removed_{r}" for r in mapcheck.REASONS)
)


@query(
    "filter_counts",
    f"{_CLASSIFIED} select *, {S.r6('removed_points / original_points')} as removed_ratio from (select map_id, kf_id, {_COUNTS} "
    "from cls group by map_id, kf_id)",
)
def filter_counts(spark, sf):
    return mapcheck.filter_counts(classified(spark, sf)).withColumn("removed_ratio", r6("removed_ratio"))


@query(
    "kept_removed_split",
    f"{_CLASSIFIED} select map_id, kf_id, reason = 'keep' as kept, count(*) as n, {S.r6('sum(y)')} as sy from cls group by 1, 2, 3",
)
def kept_removed_split(spark, sf):
    kept, removed = mapcheck.kept_removed_split(classified(spark, sf))
    both = kept.withColumn("kept", F.lit(True)).unionByName(
        removed.drop("reason").withColumn("kept", F.lit(False))
    )
    return both.groupBy(*CLOUD, "kept").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("y")).alias("sy"))


@query(
    "nav_filter",
    f"{_CLASSIFIED_KF}, moved as (select c.map_id, c.kf_id, c.reason, c.x as bx, "
    + ", ".join(f"{e} as w{n}" for e, n in zip(S.transform(["k." + c for c in S.cols("p_")], ("c.x", "c.y", "c.z")), "xyz"))
    + " from cls c join keyframes k on c.map_id = k.map_id and c.kf_id = k.kf_id where reason not in "
    f"('keep', 'non_finite')) select map_id, kf_id, count(*) as n, {S.r6('sum(wx)')} as sx, {S.r6('sum(wy)')} as sy, "
    f"{S.r6('sum(wz)')} as sz from moved group by 1, 2",
)
def nav_filter(spark, sf):
    from lidarlake.plans.navfilter import nav_filter as run

    out = run(holes(points(spark, sf)), keyframes(spark, sf), RULES)
    removed = out.removed.filter(P.is_finite_point("x", "y", "z", "intensity"))
    return removed.groupBy(*CLOUD).agg(
        F.count(F.lit(1)).alias("n"), *(r6(F.sum(c)).alias(f"s{c}") for c in "xyz")
    )


@query(
    "cut_backward_sector",
    f"{POINTS} select map_id, kf_id, sum(case when abs(atan2(y, x)) < pi() - radians(60) / 2 then 1 else 0 end) as n from points group by 1, 2",
)
def cut_backward_sector(spark, sf):
    return points(spark, sf).groupBy(*CLOUD).agg(F.count_if(P.outside_backward_sector(60.0)).alias("n"))


@query(
    "transform_points",
    f"{POINTS_KF}, {WORLD} select map_id, kf_id, pt_id, {S.r6('x')} as x, {S.r6('y')} as y, {S.r6('z')} as z from world",
)
def transform_points(spark, sf):
    w = clouds.transform_points(points(spark, sf), keyframes(spark, sf))
    return w.select(*CLOUD, "pt_id", *(r6(c).alias(c) for c in "xyz"))


@query(
    "voxel_downsample",
    f"{POINTS} select map_id, kf_id, vx, vy, vz, count(*) as n, {MEANS} from (select *, {vox(1.0)} from points) group by 1, 2, 3, 4, 5",
)
def voxel_downsample(spark, sf):
    out = clouds.voxel_downsample(points(spark, sf), 1.0)
    return out.select(*CLOUD, "vx", "vy", "vz", "n", *(r6(c).alias(c) for c in ("x", "y", "z", "intensity")))


@query(
    "voxel_merge",
    f"{POINTS_KF}, {WORLD} select map_id, vx, vy, vz, count(*) as n, {MEANS} from (select *, {vox(2.0)} from world) group by 1, 2, 3, 4",
)
def voxel_merge(spark, sf):
    world = clouds.transform_points(points(spark, sf), keyframes(spark, sf))
    old = world.filter("kf_id % 25 < 12")
    state = clouds.voxel_sums(old, 2.0)
    merged, _, _ = clouds.voxel_merge(state, old.select(*CLOUD).distinct(), world, 2.0)
    out = clouds.voxel_means(merged)
    return out.select("map_id", "vx", "vy", "vz", "n", *(r6(c).alias(c) for c in ("x", "y", "z", "intensity")))


@query(
    "bounding_box",
    f"{POINTS} select map_id, kf_id, "
    + ", ".join(f"{S.r6(f'{f}({c})')} as {f}_{c}" for c in "xyz" for f in ("min", "max"))
    + " from points group by 1, 2",
)
def bounding_box(spark, sf):
    b = clouds.bounding_box(points(spark, sf))
    return b.select(*CLOUD, *(r6(f"{f}_{c}").alias(f"{f}_{c}") for c in "xyz" for f in ("min", "max")))


_MEMBERS = (
    "members as (select c.map_id, c.kf_id as center_id, k.kf_id, "
    + S.named(S.between(["r." + c for c in S.cols("p_")], ["k." + c for c in S.cols("p_")]), "g_")
    + ", k.rk - c.rk as off, "
    + ", ".join(f"k.{c}" for c in S.cols("p_"))
    + " from ranked c join ranked k on c.map_id = k.map_id and abs(c.kf_id - k.kf_id) <= 5 join ranked r on r.map_id = c.map_id and r.kf_id = c.kf_id)"
)
_RANKED = "ranked as (select *, row_number() over (partition by map_id order by kf_id) as rk from keyframes)"


def _submap_sql(where, prefix):
    t = S.transform(["m." + c for c in S.cols(prefix)], ("p.x", "p.y", "p.z"))
    return (
        f"{POINTS_KF}, {_RANKED}, {_MEMBERS} select m.map_id, center_id, count(*) as n, {S.r6(f'sum({t[0]})')} as sx, "
        f"{S.r6(f'sum({t[1]})')} as sy, {S.r6(f'sum({t[2]})')} as sz from members m join points p on m.map_id = p.map_id and m.kf_id = "
        f"p.kf_id where {where} group by 1, 2"
    )


def _submap_sums(df):
    return df.groupBy("map_id", "center_id").agg(
        F.count(F.lit(1)).alias("n"), *(r6(F.sum(c)).alias(f"s{c}") for c in "xyz")
    )


def centers(spark, sf):
    return keyframes(spark, sf).select("map_id", F.col("kf_id").alias("center_id"))


@query("submap", _submap_sql("abs(m.center_id - m.kf_id) <= 2", "p_"))
def submap(spark, sf):
    return _submap_sums(clouds.submap(centers(spark, sf), keyframes(spark, sf), points(spark, sf), 2))


@query("causal_submap", _submap_sql("m.center_id - m.kf_id between 0 and 3", "g_"))
def causal_submap(spark, sf):
    return _submap_sums(clouds.causal_submap(centers(spark, sf), keyframes(spark, sf), points(spark, sf), 3))


@query("submap_by_rank", _submap_sql("abs(m.off) <= 1", "p_"))
def submap_by_rank(spark, sf):
    return _submap_sums(clouds.submap_by_rank(centers(spark, sf), keyframes(spark, sf), points(spark, sf), 1))


@query("concat_clouds", f"{POINTS} select map_id, kf_id, 2 * count(*) as n from points group by 1, 2")
def concat_clouds(spark, sf):
    p = points(spark, sf)
    return clouds.concat_clouds(p, p).groupBy(*CLOUD).agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_version_gate",
    f"{with_views('maps')} select map_id, version, case when version in ('2.x.1', '2.3') then 'rebuild' when version in ('2.10.0', "
    "'3.0.0') then 'reject' when version = '2.2.9' then 'rebuild' else 'load' end as version_action from maps",
)
def map_version_gate(spark, sf):
    return mapcheck.map_version_gate(view(spark, sf, "maps")).select("map_id", "version", "version_action")


@query(
    "descriptor_schema_gate",
    f"{with_views('maps')} select map_id, map_id % 3 <> 0 as rebuild_descriptors from maps",
)
def descriptor_schema_gate(spark, sf):
    return mapcheck.descriptor_schema_gate(view(spark, sf, "maps")).select("map_id", "rebuild_descriptors")


@query(
    "descriptor_restore",
    f"{with_views('vectors')}, v as (select pos % 25 as map_id, pos as kf_id, vec, case when label = 3 then null else vec end as old from "
    "vectors), f as (select map_id, bool_or(old is null) or map_id % 3 <> 0 as rebuilt from v group by map_id) select v.map_id, kf_id, "
    f"rebuilt, {S.r6('case when rebuilt then -vec[1] else old[1] end')} as first_value from v join f on v.map_id = f.map_id",
)
def descriptor_restore(spark, sf):
    v = view(spark, sf, "vectors").select(
        (F.col("pos") % 25).alias("map_id"), F.col("pos").alias("kf_id"), F.col("vec").alias("rhpd"), "label"
    )
    stored = v.withColumn("rhpd", F.when(F.col("label") != 3, F.col("rhpd")))
    rebuilt = v.withColumn("rhpd", F.transform("rhpd", lambda x: -x))
    force = mapcheck.descriptor_schema_gate(view(spark, sf, "maps"))
    out = mapcheck.descriptor_restore(v, stored, rebuilt, force, dim=64)
    return out.select("map_id", "kf_id", "rebuilt", r6(F.get("rhpd", F.lit(0))).alias("first_value"))


@query(
    "stamp_filter_metadata",
    f"{_CLASSIFIED_MAPS}, c as (select map_id, {_COUNTS} from cls group by map_id) select m.map_id, true "
    f"as filter_applied, '{mapcheck.policy_text(RULES)}' as filter_policy, coalesce(original_points, 0) as raw_points, coalesce(kept_points, 0) "
    "as kept_points, coalesce(removed_points, 0) as removed_points from maps m left join c on m.map_id = c.map_id",
)
def stamp_filter_metadata(spark, sf):
    counts = mapcheck.filter_counts(classified(spark, sf))
    out = mapcheck.stamp_filter_metadata(view(spark, sf, "maps"), counts, RULES)
    return out.select("map_id", "filter_applied", "filter_policy", "raw_points", "kept_points", "removed_points")


@query(
    "map_metadata",
    f"{with_views('maps')} select map_id, version, coalesce(nullif(map_frame, ''), 'map') as map_frame, coalesce(nullif(body_frame, ''), "
    "'body') as body_frame from maps",
)
def map_metadata(spark, sf):
    return mapcheck.map_metadata(view(spark, sf, "maps")).select("map_id", "version", "map_frame", "body_frame")


@query(
    "map_counts",
    f"{with_views('keyframes', 'edges')} select coalesce(k.map_id, e.map_id) as map_id, coalesce(nk, 0) as num_keyframes, coalesce(no, 0) as "
    "num_odometry_edges, coalesce(nl, 0) as num_loop_edges from (select map_id, count(*) as nk from keyframes group by 1) k full join (select "
    "map_id, sum((type = 'ODOMETRY')::int) as no, sum((type = 'LOOP')::int) as nl from edges group by 1) e on k.map_id = e.map_id",
)
def map_counts(spark, sf):
    return mapcheck.map_counts(keyframes(spark, sf), edges(spark, sf))


@query(
    "trajectory_or_fallback",
    f"{with_views('keyframes', 'odom')}, t as (select session_id % 2 as map_id, event_id as seq, ts, tx from odom) select map_id, seq, "
    f"{S.r6('tx')} as tx, false as degraded, 'native' as source from t union all select map_id, row_number() over (partition by map_id "
    f"order by kf_id) - 1, {S.r6('p_tx')}, true, 'keyframe_fallback' from keyframes where map_id not in (select map_id from t)",
)
def trajectory_or_fallback(spark, sf):
    from lidarlake.catalog.views import odom_frames

    t = odom_frames(spark, sf).select(
        (F.col("session_id") % 2).alias("map_id"), F.col("event_id").alias("seq"), "ts", "pose"
    )
    out = mapcheck.trajectory_or_fallback(t, keyframes(spark, sf))
    return out.select("map_id", "seq", r6("pose.tx").alias("tx"), "degraded", "source")


@query(
    "session_counts",
    "select user_id as session_id, count(*) as frames, sum((event_type = 'view')::int) as keyframes, sum((value > 50)::int) as loops "
    "from events group by 1",
)
def session_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("session_id", F.col("user_id"))
    frames = e.select("session_id", (F.col("event_type") == "view").alias("accepted"))
    return mapcheck.session_counts(frames, e.filter("value > 50"))
