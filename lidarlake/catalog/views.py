"""Map-shaped views over the test tables.

The test tables hold no scans, so fixed expressions turn their rows into points, keyframes,
edges, odometry, matches and results. One SQL text serves both engines; names in braces stand
for tables and for the few functions that are spelled differently.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.functions.pose import make_pose
from lidarlake.schema import POSE_FIELDS

_SPARK = {
    "epoch": "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6)",
    "dvec": "cast(embedding as array<double>)",
}
_DUCK = {"epoch": "(epoch_us(ts) / 1e6)", "dvec": "cast(embedding as double[])"}

_MAP_OF = "cast(floor({} / 25.0e0) as bigint)"

# Unique id of a line item row.
_ROW_ID = (
    "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000) * 10000 + l_suppkey % 10000) * 64 "
    "+ cast(l_quantity as bigint)"
)


def _pose_sql(prefix, tx, ty, tz, yaw, roll):
    y, r = f"(({yaw}) / 2)", f"(({roll}) / 2)"
    return (
        f"{tx} as {prefix}tx, {ty} as {prefix}ty, {tz} as {prefix}tz, "
        f"cos{y} * sin{r} as {prefix}qx, sin{y} * sin{r} as {prefix}qy, "
        f"sin{y} * cos{r} as {prefix}qz, cos{y} * cos{r} as {prefix}qw"
    )


VIEWS = {
    # 600 points per cloud; offsets keep points off cell edges.
    "points": (
        "lineitem",
        f"select {_MAP_OF.format('l_suppkey')} as map_id, l_suppkey as kf_id, "
        f"{_ROW_ID} as pt_id, l_quantity - 25.37e0 as x, "
        "(l_extendedprice % 1000.0e0) / 20.0e0 - 25.01323e0 as y, l_discount * 70.0e0 - 1.98731459e0 as z, "
        "l_tax * 100.0e0 as intensity from {lineitem}",
    ),
    "keyframes": (
        "supplier",
        f"select {_MAP_OF.format('s_suppkey')} as map_id, s_suppkey as kf_id, "
        "s_suppkey * 1.0e0 as ts, s_suppkey % 25 < 12 as from_loaded, "
        + _pose_sql(
            "o_", "s_suppkey * 0.7e0 + (s_nationkey % 5) * 0.05e0", "(s_nationkey - 12) * 0.3e0",
            "(s_nationkey % 4) * 0.01e0", "s_acctbal * 0.0003e0", "(s_nationkey % 3) * 0.02e0",
        )
        + ", "
        + _pose_sql(
            "p_", "s_suppkey * 0.7e0 + (s_nationkey % 5) * 0.05e0 + (s_suppkey % 7) * 0.01e0",
            "(s_nationkey - 12) * 0.3e0 + (s_suppkey % 3) * 0.02e0", "(s_nationkey % 4) * 0.01e0",
            "s_acctbal * 0.0003e0 + (s_suppkey % 5) * 0.01e0", "(s_nationkey % 3) * 0.02e0",
        )
        + " from {supplier}",
    ),
    "edges": (
        "supplier",
        f"select {_MAP_OF.format('s_suppkey')} as map_id, s_suppkey - 1 as from_id, s_suppkey as to_id, "
        + _pose_sql(
            "m_", "0.7e0 + (s_nationkey % 3) * 0.01e0", "(s_nationkey % 5) * 0.02e0",
            "(s_nationkey % 2) * 0.005e0", "s_acctbal * 0.00001e0", "(s_nationkey % 3) * 0.01e0",
        )
        + ", s_nationkey % 6 as info_kind, "
        "case when s_nationkey % 4 = 0 then 'LOOP' else 'ODOMETRY' end as type from {supplier}",
    ),
    "odom": (
        "events",
        "select user_id as session_id, event_id, {epoch} as ts, event_type, value, "
        "row_number() over (partition by user_id order by ts, event_id) - 1 as seq, "
        "sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding "
        "and current row) / 100.0e0 as tx, (event_id % 7) * 0.1e0 as ty, "
        "cast((event_id % 97) * 0.06471 as double) as yaw from {events}",
    ),
    "vectors": (
        "embeddings",
        "select cast(0 as bigint) as map_id, vec_id as pos, {dvec} as vec, label from {embeddings}",
    ),
    "matches": (
        "lineitem",
        f"select {_MAP_OF.format('l_suppkey')} as map_id, l_partkey as query_id, "
        f"{_ROW_ID} as match_id, l_discount * 3.0e0 + l_tax as fitness, "
        "l_quantity / 50.0e0 as inlier_ratio, l_returnflag <> 'R' as verified, "
        "l_linestatus = 'O' as converged, l_extendedprice % 40.0e0 as rhpd_distance, "
        "case when l_linenumber % 3 = 0 then null else l_tax * 8.0e0 end as sc_distance, "
        + _pose_sql(
            "t_", "l_quantity * 0.15e0 - 2.0e0", "l_discount * 20.0e0", "l_tax * 2.0e0",
            "l_discount * 8.0e0", "l_tax * 1.0e0",
        )
        + " from {lineitem}",
    ),
    "results": (
        "orders",
        "select o_orderkey as query_id, case when o_custkey % 3 = 0 then o_orderkey else o_custkey end "
        "as match_id, o_orderstatus <> 'F' as locked, (o_totalprice % 1300.0e0) / 1000.0e0 as translation_error_m, "
        "(o_totalprice % 1700.0e0) / 140.0e0 as yaw_error_deg, (o_totalprice % 900.0e0) / 170.0e0 as "
        "roll_pitch_error_deg, (o_custkey % 4) * 0.1e0 as dropout, (o_custkey % 3) * 0.02e0 as noise_sigma, "
        "(o_orderkey % 2) * 45.0e0 as fake_yaw_deg, o_orderpriority as query_source from {orders}",
    ),
    "maps": (
        "nation",
        "select cast(n_nationkey as bigint) as map_id, case n_nationkey % 6 when 0 then '2.3.0' when 1 then '2.2.9' "
        "when 2 then '2.10.0' when 3 then '3.0.0' when 4 then '2.x.1' else '2.3' end as version, "
        "case n_nationkey % 3 when 0 then '{schema_ok}' when 1 then '' else n_name end as rhpd_schema, "
        "case when n_nationkey % 2 = 0 then '' else n_name end as map_frame, "
        "case when n_nationkey % 3 = 0 then cast(null as varchar(20)) else lower(n_name) end as body_frame, "
        "case n_nationkey % 4 when 0 then 'none' when 1 then 'native' when 2 then 'keyframe_fallback' else '' end "
        "as trajectory_source from {nation}",
    ),
}


def _schema_ok():
    from lidarlake.operators.mapcheck import descriptor_schema

    return descriptor_schema()


def sql(name: str) -> str:
    """Text of a view for the checking engine."""
    table, text = VIEWS[name]
    return "(" + text.format(**{table: table}, **_DUCK, schema_ok=_schema_ok()) + ")"


def with_views(*names: str) -> str:
    return "with " + ", ".join(f"{n} as {sql(n)}" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pose_of(prefix: str):
    return make_pose(*(F.col(prefix + f) for f in POSE_FIELDS))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; flat pose columns become structs."""
    source, text = VIEWS[name]
    sql_text = text.format(**{source: "{" + source + "}"}, **_SPARK, schema_ok=_schema_ok())
    df = spark.sql(sql_text, **{source: table(spark, sf_dir, source)})
    for prefix, out in (("o_", "odom"), ("p_", "opt"), ("m_", "meas"), ("t_", "T")):
        if f"{prefix}qw" in df.columns:
            df = df.withColumn(out, pose_of(prefix)).drop(*(prefix + f for f in POSE_FIELDS))
    return df


def r6(c):
    """Six digits, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def flat_pose(c, prefix):
    p = F.col(c) if isinstance(c, str) else c
    return [r6(p.getField(f)).alias(prefix + f) for f in POSE_FIELDS]


def info21(kind="info_kind"):
    """Packed information of the edge view; one kind is all zero, one has the wrong length."""
    k = F.col(kind)
    full = F.array(*((k + 1.0) * (i + 1) for i in range(21)))
    zero = F.array(*(F.lit(0.0) for _ in range(21)))
    return F.when(k == 0, zero).when(k == 5, F.slice(full, 1, 20)).otherwise(full)


def edges(spark, sf_dir):
    return view(spark, sf_dir, "edges").withColumn("info", info21()).drop("info_kind")


def odom_frames(spark, sf_dir):
    """Odometry rows with a planar pose."""
    o = view(spark, sf_dir, "odom")
    half = F.col("yaw") / 2
    zero = F.lit(0.0)
    pose = make_pose(F.col("tx"), F.col("ty"), zero, zero, zero, F.sin(half), F.cos(half))
    return o.withColumn("pose", pose)
