"""Queries over descriptors, distances and retrieval."""

from pyspark.sql import functions as F

from lidarlake.catalog import sqlpose as S
from lidarlake.catalog.points import keyframes, points
from lidarlake.catalog.registry import query
from lidarlake.catalog.views import r6, view, with_views
from lidarlake.functions import vectors as V
from lidarlake.operators import descriptors as D
from lidarlake.operators import mapcheck, retrieval
from lidarlake.session import materialize

POINTS = with_views("points")
CLOUD = ["map_id", "kf_id"]


def r6cols(df, keep, cols):
    return df.select(*keep, *(r6(c).alias(c) for c in cols))


_PCA = (
    "pca0 as (select map_id, kf_id, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy, var_pop(y) as cyy from "
    "points group by 1, 2), pca as (select *, 0.5e0*atan2(2*cxy, cxx-cyy) as angle, sqrt(((cxx-cyy)/2)**2 + cxy**2)*2/(cxx+cyy) as confidence from pca0)"
)
_PCA_COLS = ("mx", "my", "cxx", "cxy", "cyy", "angle", "confidence")


@query(
    "pca_2d",
    f"{POINTS}, {_PCA} select map_id, kf_id, n, {', '.join(f'{S.r6(c)} as {c}' for c in _PCA_COLS)} from pca",
)
def pca_2d(spark, sf):
    return r6cols(D.pca_2d(points(spark, sf)), [*CLOUD, "n"], _PCA_COLS)


def _bin(v, lo, hi):
    return f"greatest(0, least(13, floor(({v} - ({lo}))/(({hi}) - ({lo}))*14)))::int"


_R = "sqrt(x*x+y*y)"
_AZ36 = "greatest(0, least(35, floor((atan2(y, x)+pi())/(2*pi())*36)))::int"
_ALIGNED = (
    f"{POINTS}, {_PCA}, al as (select p.map_id, p.kf_id, p.x*cos(angle)+p.y*sin(angle) as ax, p.y*cos(angle)-p.x*sin(angle) as ay, z from points p join pca "
    "on p.map_id = pca.map_id and p.kf_id = pca.kf_id), pp as (select map_id, kf_id, 0 as plane, ax as a, ay as b, -30 as b0, 30 as b1, (z+2)/8 as h from al union all "
    "select map_id, kf_id, 1, ax, z, -2, 6, (ay+30)/60 from al union all select map_id, kf_id, 2, ay, z, -2, 6, (ax+30)/60 from al), "
    f"pb as (select *, {_bin('a', -30, 30)} as i0, {_bin('b', 'b0', 'b1')} as i1 from pp where a >= -30 and a < 30 and b >= b0 and b < b1), "
    "pc as (select map_id, kf_id, plane, i0, i1, count(*) as n, avg(least(1e0, greatest(0e0, h))) as mean_height, max(least(1e0, greatest(0e0, h))) - "
    "min(least(1e0, greatest(0e0, h))) as height_extent from pb group by 1, 2, 3, 4, 5), planes as (select *, n / sum(n) over (partition by map_id, kf_id, plane) as "
    "density, n / max(n) over (partition by map_id, kf_id, plane) as hit_ratio from pc)"
)
_PLANE_COLS = ("density", "mean_height", "hit_ratio", "height_extent")


def cells(spark, sf, parts=("plane", "ring", "sector")):
    p = points(spark, sf)
    pca = materialize(D.pca_2d(p))
    return D._cells_by_cloud(p, pca, parts), pca


@query(
    "plane_histogram",
    f"{_ALIGNED} select map_id, kf_id, plane, i0, i1, n, {', '.join(f'{S.r6(c)} as {c}' for c in _PLANE_COLS)} from planes",
)
def plane_histogram(spark, sf):
    c, _ = cells(spark, sf, ("plane",))
    return r6cols(D.plane_histogram(c), [*CLOUD, "plane", "i0", "i1", "n"], _PLANE_COLS)


@query(
    "plane_visibility",
    f"{_ALIGNED}, fr as (select map_id, kf_id, plane, greatest(0, least(71, floor((atan2(b, a)+pi())/(2*pi())*72)))::int as s, max(sqrt(a*a+b*b)) as hi from pb group by "
    "1, 2, 3, 4), grid0 as (select plane, i::int as i0, j::int as i1, -30 + (i+0.5e0)/14*60 as ca, case when plane = 0 then -30 + (j+0.5e0)/14*60 else -2 + "
    "(j+0.5e0)/14*8 end as cb from range(3) t(plane), range(14) u(i), range(14) v(j)), grid as (select *, sqrt(ca*ca+cb*cb) as rc, greatest(0, least(71, "
    "floor((atan2(cb, ca)+pi())/(2*pi())*72)))::int as s from grid0), ids as (select distinct map_id, kf_id from points), st as (select ids.map_id, ids.kf_id, "
    "g.plane, g.i0, g.i1, case when pc.n is not null then 1e0 when fr.hi > 1e-6 and g.rc + 0.15 < fr.hi then 0.5e0 else 0e0 end as visibility from ids cross join "
    "grid g left join pc on pc.map_id = ids.map_id and pc.kf_id = ids.kf_id and pc.plane = g.plane and pc.i0 = g.i0 and pc.i1 = g.i1 left join fr on fr.map_id = "
    "ids.map_id and fr.kf_id = ids.kf_id and fr.plane = g.plane and fr.s = g.s) select a.map_id, a.kf_id, a.plane::int as plane, a.i0, a.i1, a.visibility, "
    f"{S.r6('avg(abs(a.visibility - b.visibility))')} as boundary from st a join st b on a.map_id = b.map_id and a.kf_id = b.kf_id and a.plane = b.plane and abs(a.i0 - "
    "b.i0) + abs(a.i1 - b.i1) = 1 group by 1, 2, 3, 4, 5, 6",
)
def plane_visibility(spark, sf):
    c, _ = cells(spark, sf, ("plane", "front"))
    return r6cols(D.plane_visibility(c), [*CLOUD, "plane", "i0", "i1", "visibility"], ["boundary"])


_RINGS = (
    f"rc as (select map_id, kf_id, greatest(0, least(15, floor({_R}/30*16)))::int as ring, greatest(0, least(7, floor(z+2)))::int as layer, {_AZ36} as az, {_R} as r "
    f"from points where {_R} > 0.1 and {_R} < 30 and z >= -2 and z < 6)"
)
_RING_STATS = (
    f"{_RINGS}, ra as (select map_id, kf_id, ring, layer, az, count(*) as c, sum(r) as sr, sum(r*r) as srr from rc group by 1, 2, 3, 4, 5), rb as (select map_id, kf_id, ring, "
    "layer, sum(c) as n, sum(c*c) as cc, sum(sr) as sr, sum(srr) as srr from ra group by 1, 2, 3, 4), rings as (select map_id, kf_id, ring, layer, n::bigint as n, n / "
    "sum(n) over (partition by map_id, kf_id) as density, least(10e0, ((cc - n*n/36)/36) / ((n/36)*(n/36)))/10 as azimuth_var, sr/n/30 as mean_range, sqrt(greatest(0e0, "
    "srr/n - (sr/n)*(sr/n)))/30 as range_std from rb)"
)
_RING_COLS = ("density", "azimuth_var", "mean_range", "range_std")


@query(
    "ring_height_stats",
    f"{POINTS}, {_RING_STATS} select map_id, kf_id, ring, layer, n, {', '.join(f'{S.r6(c)} as {c}' for c in _RING_COLS[:3])}, round(range_std, 5) + 0e0 as range_std from rings",
)
def ring_height_stats(spark, sf):
    c, _ = cells(spark, sf, ("ring",))
    out = D.ring_height_stats(c).withColumn("range_std", F.round("range_std", 5) + F.lit(0.0))
    return r6cols(out, [*CLOUD, "ring", "layer", "n", "range_std"], _RING_COLS[:3])


_SECTORS = (
    f"se as (select map_id, kf_id, {_AZ36} as sector, min({_R}) as lo, max({_R}) as hi from points where {_R} > 0.1 and {_R} < 30 group by 1, 2, 3), sp as (select i.map_id, "
    "i.kf_id, s::int as sector, lo, hi from (select distinct map_id, kf_id from points) i cross join range(36) t(s) left join se on se.map_id = i.map_id and se.kf_id = i.kf_id "
    "and se.sector = s), sectors as (select a.map_id, a.kf_id, a.sector, coalesce(a.lo/30, 1e0) as nearest, coalesce((a.hi-a.lo)/30, 0e0) as span, case when a.hi >= 22.5 then 1e0 when a.hi is not "
    "null then 0e0 when bool_or(b.hi is not null) then 0.75e0 else 0.5e0 end as state from sp a join sp b on a.map_id = b.map_id and a.kf_id = b.kf_id and ((a.sector+1)%36 = "
    "b.sector or (a.sector+35)%36 = b.sector) group by a.map_id, a.kf_id, a.sector, a.lo, a.hi)"
)


@query(
    "negative_space",
    f"{POINTS}, {_SECTORS} select map_id, kf_id, sector, {S.r6('nearest')} as nearest, {S.r6('span')} as span, state from sectors",
)
def negative_space(spark, sf):
    c, _ = cells(spark, sf, ("sector",))
    return r6cols(D.negative_space(c), [*CLOUD, "sector", "state"], ["nearest", "span"])


_TOKENS = (
    f"{_RINGS}, tk as (select map_id, kf_id, ring // 4 as ring, az, bit_or((1 << (layer // 2))::int) as token from rc group by 1, 2, 3, 4), tokens as (select map_id, kf_id, ring, "
    "token, n, n / sum(n) over (partition by map_id, kf_id, ring) as share from (select map_id, kf_id, ring, token, count(*) as n from tk group by 1, 2, 3, 4))"
)


@query("vertical_tokens", f"{POINTS}, {_TOKENS} select map_id, kf_id, ring, token, n, {S.r6('share')} as share from tokens")
def vertical_tokens(spark, sf):
    c, _ = cells(spark, sf, ("ring",))
    return r6cols(D.vertical_tokens(c), [*CLOUD, "ring", "token", "n"], ["share"])


_VALUES = (
    f"{_ALIGNED}, {_RING_STATS}, {_SECTORS}, {_TOKENS.replace(_RINGS + ', ', '')}, vals as ("
    + " union all ".join(
        [f"select map_id, kf_id, plane*784 + (i0*14+i1)*4 + {i} as idx, {c} as v from planes" for i, c in enumerate(_PLANE_COLS)]
        + [f"select map_id, kf_id, 2352 + (ring*8+layer)*4 + {i}, {c} from rings" for i, c in enumerate(_RING_COLS)]
        + [f"select map_id, kf_id, 2864 + sector*3 + {i}, {c} from sectors" for i, c in enumerate(("nearest", "span", "state"))]
        + ["select map_id, kf_id, 2972 + ring*16 + token, share from tokens", "select map_id, kf_id, 3036, confidence from pca"]
    )
    + ")"
)


@query(
    "assemble_descriptor",
    f"{_VALUES} select map_id, kf_id, idx::int as idx, (round(v, 5) + 0e0) as v from vals where round(v, 5) <> 0",
)
def assemble_descriptor(spark, sf):
    d = D.rhpd_descriptors(points(spark, sf))
    v = d.select(*CLOUD, F.posexplode("rhpd").alias("idx", "v"))
    return v.select(*CLOUD, "idx", (F.round("v", 5) + F.lit(0.0)).alias("v")).filter("v <> 0")


_DENSE = (
    f"{_VALUES}, vec as (select i.map_id, i.kf_id, d.idx::int as idx, coalesce(v, 0e0) as v from (select distinct map_id, kf_id from points) i cross join range(3037) d(idx) left "
    "join vals on vals.map_id = i.map_id and vals.kf_id = i.kf_id and vals.idx = d.idx)"
)
_COARSE = " union all ".join(
    [
        "select map_id, kf_id, (idx - 2352) // 32 as k, sum(v) as v from vec where idx >= 2352 and idx < 2864 and (idx - 2352) % 4 = 0 group by 1, 2, 3",
        "select map_id, kf_id, 16 + (idx - 2864) // 3 as k, sum(v * case (idx - 2864) % 3 when 0 then 0.6e0 when 1 then 0.25e0 else 0.15e0 end) from vec where idx >= 2864 "
        "and idx < 2972 group by 1, 2, 3",
        "select map_id, kf_id, 52 + idx - 2972, v from vec where idx >= 2972 and idx < 3036",
        "select map_id, kf_id, 116, v from vec where idx = 3036",
    ]
)


@query(
    "coarse_key",
    f"{_DENSE}, ck as ({_COARSE}) select map_id, kf_id, k::int as k, (round(v, 5) + 0e0) as v from ck where round(v, 5) <> 0",
)
def coarse_key(spark, sf):
    d = D.rhpd_descriptors(points(spark, sf)).select(*CLOUD, F.posexplode(V.coarse_key("rhpd")).alias("k", "v"))
    return d.select(*CLOUD, "k", (F.round("v", 5) + F.lit(0.0)).alias("v")).filter("v <> 0")


_FLIP = (
    "case when idx < 784 then (13 - idx//56)*56 + (13 - (idx//4)%14)*4 + idx%4 when idx < 2352 then (idx//784)*784 + (13 - (idx%784)//56)*56 + idx%56 when idx >= 2864 and idx < "
    "2972 then 2864 + (((idx - 2864)//3 + 18)%36)*3 + (idx - 2864)%3 else idx end"
)


@query(
    "rhpd_distance",
    f"{_DENSE}, fl as (select map_id, kf_id, idx, v, {_FLIP} as src from vec), af as (select f.map_id, f.kf_id, f.idx, f.v, g.v as w from fl f join vec g on f.map_id = g.map_id and "
    "f.kf_id = g.kf_id and f.src = g.idx), s as (select a.map_id, a.kf_id as a_id, b.kf_id as b_id, 0.35 + 0.65*min(case when a.idx = 3036 then least(a.v, b.v) end) as wa, "
    + ", ".join(
        f"sum(case when {c} then (a.{x} - b.v)**2 else 0e0 end) as {n}{x}"
        for x in "vw"
        for n, c in (("p", "a.idx < 2352"), ("q", "a.idx >= 2352 and a.idx < 2864"), ("r", "a.idx >= 2864"))
    )
    + " from af a join vec b on a.map_id = b.map_id and a.idx = b.idx and b.kf_id between a.kf_id + 1 and a.kf_id + 3 group by 1, 2, 3) select map_id, a_id, b_id, round(sqrt(least("
    "wa*pv+qv+0.5e0*rv, wa*pw+qw+0.5e0*rw)), 5) + 0e0 as distance from s",
)
def rhpd_distance(spark, sf):
    d = materialize(D.rhpd_descriptors(points(spark, sf)))
    p = _near_distances(d, "rhpd", retrieval._rhpd_kernel, [("distance", "double")])
    return p.select("map_id", "a_id", "b_id", (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


def _near_distances(d, col, kernel, fields, reach=3):
    """Distances of each cloud to the next few of its map; each vector travels once per block of clouds, not per pair."""
    ids = d.select("map_id", F.col("kf_id").alias("query_id"))
    near = ids.withColumn("match_pos", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + reach)))
    pairs = near.join(ids.withColumnRenamed("query_id", "match_pos"), ["map_id", "match_pos"])
    queries, base = (d.select("map_id", F.col("kf_id").alias(n), col) for n in ("query_id", "pos"))
    scored = retrieval.score_pairs(pairs, queries, base, col, kernel, fields)
    return scored.withColumnsRenamed({"query_id": "a_id", "match_pos": "b_id"})


_AZD = "(case when degrees(atan2(y, x)) < 0 then degrees(atan2(y, x)) + 360 else degrees(atan2(y, x)) end)"
_POLAR = (
    f"pl as (select *, greatest(0, least(19, floor(ln({_R}/0.5e0)/ln(160)*20)))::int as ring, greatest(0, least(59, floor({_AZD}/360*60)))::int as sector, case when z >= -2 and z < 6 then "
    f"least(3, floor((z+2)/2))::int end as layer from points where {_R} between 0.5 and 80), pm as (select map_id, kf_id, ring, sector, max(z+2) as max_height, stddev_pop(z+2) as "
    "height_std, count(*) as n, "
    + ", ".join(f"sum(case when layer = {i} then 1 else 0 end)/count(*) as layer{i}" for i in range(4))
    + " from pl group by 1, 2, 3, 4), pv as (select map_id, kf_id, ring, sector, max_height, height_std, n/max(n) over (partition by map_id, kf_id) as density, layer0, layer1, layer2, "
    "layer3 from pm)"
)


@query(
    "polar_cells",
    f"{POINTS}, {_POLAR} select map_id, kf_id, ring, sector, {', '.join(f'{S.r6(c)} as {c}' for c in D.POLAR_COLUMNS)} from pv",
)
def polar_cells(spark, sf):
    return r6cols(D.polar_cells(points(spark, sf)), [*CLOUD, "ring", "sector"], D.POLAR_COLUMNS)


_LONG = (
    f"{POINTS}, {_POLAR}, lv as ("
    + " union all ".join(f"select map_id, kf_id, {i} as ch, ring, sector, {c} as v from pv" for i, c in enumerate(D.POLAR_COLUMNS))
    + ")"
)


@query("ring_key", f"{_LONG} select map_id, kf_id, ch, ring, {S.r6('sum(v)/60')} as mean from lv group by 1, 2, 3, 4")
def ring_key(spark, sf):
    return r6cols(D.ring_key(D.polar_values(D.polar_cells(points(spark, sf)))), [*CLOUD, "ch", "ring"], ["mean"])


@query("sector_key", f"{_LONG} select map_id, kf_id, sector, {S.r6('sum(v)/140')} as mean from lv group by 1, 2, 3")
def sector_key(spark, sf):
    return r6cols(D.sector_key(D.polar_values(D.polar_cells(points(spark, sf)))), [*CLOUD, "sector"], ["mean"])


def _polar_distance_sql(lv, rows, weights, ids="select distinct map_id, kf_id from points"):
    """Distance and shift of near pairs by explicit enumeration of shifts."""
    w = "1e0"
    if weights:
        w = "case ch " + " ".join(f"when {i} then {v}e0" for i, v in enumerate(weights)) + " end"
    return (
        f"ids as ({ids}), sk0 as (select map_id, kf_id, sector, sum(v)/{rows} as k from {lv} group by all), sk as (select i.map_id, i.kf_id, s::int as sector, coalesce(k, 0e0) as k from "
        "ids i cross join range(60) t(s) left join sk0 on sk0.map_id = i.map_id and sk0.kf_id = i.kf_id and sk0.sector = s), prs as (select a.map_id, a.kf_id as a_id, b.kf_id as b_id from ids "
        "a join ids b on a.map_id = b.map_id and b.kf_id between a.kf_id + 1 and a.kf_id + 3), co as (select p.map_id, a_id, b_id, sh, sqrt(sum((a.k - b.k)**2)) as d from prs p cross join "
        "range(60) t(sh) join sk a on a.map_id = p.map_id and a.kf_id = a_id join sk b on b.map_id = p.map_id and b.kf_id = b_id and (b.sector + sh) % 60 = a.sector group by all), c1 as "
        "(select map_id, a_id, b_id, arg_min(sh, (round(d, 9), sh)) as sh from co group by all), tr as (select map_id, a_id, b_id, (sh + o + 60) % 60 as sh, abs(o)*2 - (o > 0)::int as ord from c1 cross "
        f"join range(-3, 4) t(o)), nm as (select map_id, kf_id, ch, sector, sqrt(sum(v*v)) as n from {lv} group by all), dt as (select t.map_id, a_id, b_id, t.sh, a.ch, a.sector, "
        f"sum(a.v*b.v) as dot from tr t join {lv} a on a.map_id = t.map_id and a.kf_id = a_id join {lv} b on b.map_id = t.map_id and b.kf_id = b_id and a.ch = b.ch and a.ring = b.ring and "
        "(b.sector + t.sh) % 60 = a.sector group by all), ct as (select t.map_id, a_id, b_id, t.sh, t.ord, a.ch, a.sector, a.n as an, b.n as bn from tr t join nm a on a.map_id = "
        "t.map_id and a.kf_id = a_id join nm b on b.map_id = t.map_id and b.kf_id = b_id and a.ch = b.ch and (b.sector + t.sh) % 60 = a.sector where a.n >= 1e-6 and b.n >= 1e-6), cd as (select "
        "ct.map_id, ct.a_id, ct.b_id, ct.sh, ct.ord, ct.ch, 1 - sum(coalesce(dot, 0e0)/(an*bn))/count(*) as cd from ct left join dt on ct.map_id = dt.map_id and ct.a_id = dt.a_id and ct.b_id = "
        f"dt.b_id and ct.sh = dt.sh and ct.ch = dt.ch and ct.sector = dt.sector group by all), fin as (select map_id, a_id, b_id, sh, ord, sum({w}*cd)/sum({w}) as distance from cd "
        f"group by all) select map_id, a_id, b_id, {S.r6('min(distance)')} as distance, arg_min(sh, (distance, ord))::int as shift from fin group by all"
    )


@query("polar_distance", f"{_LONG}, {_polar_distance_sql('lv', 140, V.POLAR_WEIGHTS)}")
def polar_distance(spark, sf):
    p = points(spark, sf)
    p = retrieval.near_polar(p.select(*CLOUD).distinct(), D.polar_cells(p))
    return p.select("map_id", "a_id", "b_id", r6("distance").alias("distance"), "shift")


_CLASSIC = (
    f"{POINTS}, cv as (select map_id, kf_id, 0 as ch, greatest(1, least(20, ceil({_R}/80*20)))::int - 1 as ring, greatest(1, least(60, ceil({_AZD}/360*60)))::int - 1 as sector, max(z+2) as v from "
    f"points where {_R} <= 80 group by all)"
)


@query("classic_polar", f"{_CLASSIC} select map_id, kf_id, ch, ring, sector, {S.r6('v')} as v from cv")
def classic_polar(spark, sf):
    return r6cols(D.classic_polar_values(points(spark, sf)), [*CLOUD, "ch", "ring", "sector"], ["v"])


def _one_channel(text):
    """The same SQL without its channel column."""
    for a, b in (
        ("a.ch, ", ""), ("ct.ch, ", ""), (" and a.ch = b.ch", ""), (" and ct.ch = dt.ch", ""),
        ("kf_id, ch, sector", "kf_id, sector"),
    ):
        text = text.replace(a, b)
    return text


@query("polar_distance_classic", f"{_CLASSIC}, {_one_channel(_polar_distance_sql('cv', 20, None))}")
def polar_distance_classic(spark, sf):
    d = materialize(D.classic_polar_descriptors(points(spark, sf)))
    p = _near_distances(d, "polar", retrieval._classic_kernel, [("distance", "double"), ("shift", "int")])
    return p.select("map_id", "a_id", "b_id", r6("distance").alias("distance"), "shift")


# --- retrieval on the embeddings --------------------------------------------------------------

VEC = with_views("vectors")
_C8 = "[" + ", ".join(f"list_sum(vec[{i * 8 + 1}:{i * 8 + 8}])" for i in range(8)) + "]"


def vectors(spark, sf):
    v = view(spark, sf, "vectors")
    parts = [F.aggregate(F.slice("vec", i * 8 + 1, 8), F.lit(0.0), lambda a, x: a + x) for i in range(8)]
    return v.withColumn("coarse", F.array(*parts)).withColumn("full", F.col("vec")).withColumn("query_id", F.col("pos"))


@query(
    "l2_sq",
    f"{VEC} select a.pos, {S.r6('list_distance(a.vec, b.vec)**2')} as d2 from vectors a join vectors b on a.pos = b.pos + 1",
)
def l2_sq(spark, sf):
    v = vectors(spark, sf)
    b = v.select((F.col("pos") + 1).alias("pos"), F.col("vec").alias("b"))
    return v.join(b, "pos").select("pos", r6(V.l2_sq("vec", "b")).alias("d2"))


@query("loop_search_range", f"{VEC} select a.pos, count(*) as n from vectors a join vectors b on b.pos < a.pos - 50 group by 1")
def loop_search_range(spark, sf):
    return retrieval.loop_search_range(vectors(spark, sf)).select("pos", F.col("limit").alias("n"))


_TWO = (
    f"{VEC}, v as (select *, {_C8} as coarse from vectors), c as (select a.pos as query_id, b.pos as match_pos, a.vec as av, b.vec as bv, row_number() over (partition by a.pos order by "
    "list_distance(a.coarse, b.coarse), b.pos) as rn from v a join v b on b.pos < a.pos - 50), f as (select query_id, match_pos, list_distance(av, bv) as distance from c where rn <= 20), g as "
    "(select *, row_number() over (partition by query_id order by distance, match_pos) - 1 as rank from f)"
)


@query("knn_two_stage", f"{_TWO} select query_id, match_pos, {S.r6('distance')} as distance, rank from g where rank < 5")
def knn_two_stage(spark, sf):
    v = vectors(spark, sf)
    hits = retrieval.knn_two_stage(
        retrieval.loop_search_range(v), v, 5, 20, coarse="coarse", full="full", metric="l2", block=128
    )
    return hits.select("query_id", "match_pos", r6("distance").alias("distance"), "rank")


@query(
    "attach_polar",
    f"{_TWO} select g.query_id, match_pos as match_id, {S.r6('sc')} as sc_distance from g left join (select query_id as q, match_pos as m, query_id % 10 / 10.0e0 as sc from g where match_pos % 3 = 0) "
    "p on g.query_id = q and match_pos = m where rank < 5 and (sc is null or sc <= 0.6)",
)
def attach_polar(spark, sf):
    v = vectors(spark, sf)
    hits = retrieval.knn_two_stage(retrieval.loop_search_range(v), v, 5, 20, full="full", metric="l2")
    pairs = materialize(hits.select("map_id", "query_id", F.col("match_pos").alias("match_id")))
    polar = pairs.filter("match_id % 3 = 0").withColumn("sc_distance", (F.col("query_id") % 10) / 10.0)
    out = retrieval.attach_polar(pairs, polar, veto=0.6)
    return out.select("query_id", "match_id", r6("sc_distance").alias("sc_distance"))


@query(
    "rank_candidates",
    f"{with_views('matches')}, t as (select *, row_number() over (partition by map_id, query_id order by rhpd_distance, match_id) - 1 as rhpd_rank from matches where rhpd_distance <= 25), s as "
    "(select *, rhpd_distance/25.0e0 + 0.15e0*coalesce(sc_distance/0.6e0, 1e0) as fused from t where sc_distance is null or sc_distance <= 0.55), u as (select *, row_number() over (partition by "
    "map_id, query_id order by fused, rhpd_distance, match_id) - 1 as fused_rank from s) select map_id, query_id, match_id, rhpd_rank, fused_rank, "
    f"{S.r6('fused')} as fused_score from u where fused_rank < 4",
)
def rank_candidates(spark, sf):
    m = view(spark, sf, "matches")
    c = retrieval.rank_candidates(m, k=4, veto=0.55)
    return c.select("map_id", "query_id", "match_id", "rhpd_rank", "fused_rank", r6("fused_score").alias("fused_score"))


@query(
    "merge_frame_candidates",
    f"{with_views('matches')}, m as (select map_id, query_id % 50 as query_id, match_id % 40 as match_id, fitness as fused_score, rhpd_distance, case when verified then 'rhpd' else 'rhpd_frame' end as "
    "source from matches), b as (select *, row_number() over (partition by map_id, query_id, match_id order by fused_score, rhpd_distance, source) as rn from m), r as (select map_id, query_id, match_id, "
    "fused_score, rhpd_distance, row_number() over (partition by map_id, query_id order by fused_score, rhpd_distance, match_id) - 1 as fused_rank from b where rn = 1) select map_id, query_id, "
    f"match_id, {S.r6('fused_score')} as fused_score, fused_rank from r where fused_rank < 10",
)
def merge_frame_candidates(spark, sf):
    m = view(spark, sf, "matches").select(
        "map_id", (F.col("query_id") % 50).alias("query_id"), (F.col("match_id") % 40).alias("match_id"),
        F.col("fitness").alias("fused_score"), "rhpd_distance",
        F.when(F.col("verified"), "rhpd").otherwise("rhpd_frame").alias("source"), F.lit(0).alias("fused_rank"),
    )
    out = retrieval.merge_frame_candidates(m.filter("source = 'rhpd'"), m.filter("source = 'rhpd_frame'"))
    return out.select("map_id", "query_id", "match_id", r6("fused_score").alias("fused_score"), "fused_rank")


_FIRST = (
    f"{with_views('matches')}, d as (select map_id, query_id as kf_id, min(match_id) as arrival from matches group by 1, 2)"
)


@query("dedupe_keep_first", f"{_FIRST} select d.map_id, kf_id, arrival, {S.r6('fitness')} as fitness from d join matches m on d.arrival = m.match_id and d.map_id = m.map_id and d.kf_id = m.query_id")
def dedupe_keep_first(spark, sf):
    m = view(spark, sf, "matches").select(
        "map_id", F.col("query_id").alias("kf_id"), F.col("match_id").alias("arrival"), r6("fitness").alias("fitness")
    )
    return retrieval.dedupe_keep_first(m)


@query("arrival_position", f"{_FIRST} select map_id, kf_id, row_number() over (partition by map_id order by arrival) - 1 as pos from d")
def arrival_position(spark, sf):
    m = view(spark, sf, "matches").select(
        "map_id", F.col("query_id").alias("kf_id"), F.col("match_id").alias("arrival"), "fitness"
    )
    return retrieval.arrival_position(m).select("map_id", "kf_id", "pos")


def place_frames(spark, sf):
    """All descriptors of every keyframe with its arrival position.

    The searches over them run with the operators' defaults but for thresholds wider than those and a
    shorter gap to recent frames: maps here have 25 keyframes, and a gap of 50 would leave no query.
    """
    p, k = points(spark, sf), keyframes(spark, sf)
    cells = materialize(D.polar_cells(p))
    rhpd = D.submap_descriptors(k, p)
    frames = k.select(*CLOUD, F.col("kf_id").alias("arrival"))
    pos = retrieval.arrival_position(frames)
    keys = D.ring_key_vectors(D.polar_values(cells), frames)
    out = pos.join(rhpd, CLOUD).join(keys, CLOUD).join(D.polar_descriptors(p, cells=cells), CLOUD)
    return materialize(out.withColumn("coarse", V.coarse_key("rhpd")))


@query("knn_ring_key")
def knn_ring_key(spark, sf):
    f = place_frames(spark, sf)
    q = retrieval.loop_search_range(f, 5).withColumn("query_id", F.col("pos"))
    return retrieval.knn_ring_key(q, f, thr=0.6).drop("shift")


@query("detect_loops")
def detect_loops(spark, sf):
    return retrieval.detect_loops(place_frames(spark, sf), exclude_recent=5, sc_thr=0.6)


@query("reloc_candidates")
def reloc_candidates(spark, sf):
    f = place_frames(spark, sf)
    q = f.withColumn("query_id", F.col("pos")).drop("kf_id", "arrival", "pos")
    single = D.rhpd_descriptors(points(spark, sf)).withColumn("coarse", V.coarse_key("rhpd"))
    frame_base = materialize(f.drop("rhpd", "coarse").join(single, CLOUD))
    return retrieval.reloc_candidates(q, f, frame_base)


@query("polar_scan")
def polar_scan(spark, sf):
    f = place_frames(spark, sf)
    q = f.select("map_id", F.col("pos").alias("query_id"), "polar")
    return retrieval.polar_scan(q, f, thr=0.5).drop("shift")


@query("classic_detect")
def classic_detect(spark, sf):
    p = points(spark, sf)
    values = D.classic_polar_values(p)
    frames = keyframes(spark, sf).select(*CLOUD, F.col("kf_id").alias("arrival"))
    f = retrieval.arrival_position(frames).join(
        D.ring_key_vectors(values, frames, channels=1), CLOUD
    ).join(D.classic_polar_descriptors(p), CLOUD)
    return retrieval.classic_detect(materialize(f), thr=0.9, exclude_recent=5).drop("shift")


@query(
    "descriptor_lookup",
    f"{VEC} select pos % 25 as map_id, pos as kf_id, case when pos % 2 = 0 then 'recomputed' when pos % 3 = 0 then 'keyframe' when pos % 5 = 0 then 'index' end as origin from vectors",
)
def descriptor_lookup(spark, sf):
    pad = F.array_repeat(F.lit(0.5), V.RHPD_DIM - 64)
    v = view(spark, sf, "vectors").select(
        (F.col("pos") % 25).alias("map_id"), F.col("pos").alias("kf_id"), F.concat("vec", pad).alias("rhpd")
    )
    short = v.withColumn("rhpd", F.when(F.col("kf_id") % 2 == 0, F.col("rhpd")).otherwise(F.slice("rhpd", 1, 64)))
    zero = v.withColumn(
        "rhpd", F.when(F.col("kf_id") % 3 == 0, F.col("rhpd")).otherwise(F.transform("rhpd", lambda x: x * 0))
    )
    out = mapcheck.descriptor_lookup(v, short, zero, v.filter("kf_id % 5 = 0"))
    return out.select("map_id", "kf_id", "origin")
