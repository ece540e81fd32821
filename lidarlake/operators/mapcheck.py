"""Validation, metadata and version rules of stored maps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.functions.predicates import (
    all_finite,
    is_finite,
    is_finite_point,
    is_finite_pose,
    keep_reason,
)
from lidarlake.schema import MAP_VERSION

CLOUD = ["map_id", "kf_id"]


def validate_keyframes(keyframes: DataFrame, points: DataFrame, cap=None) -> DataFrame:
    """Add ``reason``: NULL for a good keyframe, else why it is refused.

    ``cap`` refuses clouds with more points; without it a cloud may have any size.
    """
    clouds = points.groupBy(*CLOUD).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~is_finite_point("x", "y", "z", "intensity")).alias("_bad"),
    )
    own = (
        F.when(F.col("kf_id").isNull() | (F.col("kf_id") < 0), "invalid id")
        .when(~is_finite("ts"), "non-finite time")
        .when(~is_finite_pose("odom") | ~is_finite_pose("opt"), "non-finite pose")
    )
    cloud = (
        F.when(F.col("_n").isNull(), "empty cloud")
        .when(F.lit(False) if cap is None else F.col("_n") > cap, "malformed cloud")
        .when(F.col("_bad") > 0, "non-finite point")
    )
    checked = keyframes.join(clouds, CLOUD, "left").withColumn("_r", F.coalesce(own, cloud))
    # Only rows that are otherwise good compete for an id.
    copies = (
        checked.filter("_r is null").groupBy(*CLOUD).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    )
    return (
        checked.join(copies, CLOUD, "left")
        .withColumn("reason", F.coalesce("_r", F.when(F.col("_c").isNotNull(), "duplicate id")))
        .drop("_n", "_bad", "_r", "_c")
    )


def accepted_keyframes(checked: DataFrame, policy="STRICT") -> DataFrame:
    """Good keyframes of acceptable maps.

    STRICT refuses a map with any bad keyframe. SALVAGE skips bad keyframes but refuses a map
    with duplicate ids.
    """
    fatal = F.col("reason").isNotNull() if policy == "STRICT" else F.col("reason") == "duplicate id"
    refused = checked.filter(fatal).select("map_id").distinct()
    return checked.filter("reason is null").drop("reason").join(refused, ["map_id"], "left_anti")


def validate_edges(edges: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Add ``reason``: malformed measurement or information, or a missing endpoint."""
    ids = keyframes.select("map_id", F.col("kf_id").alias("_id"), F.lit(True).alias("_ok")).distinct()
    ends = edges
    for side in ("from", "to"):
        ends = ends.join(
            ids.withColumnsRenamed({"_id": f"{side}_id", "_ok": f"_{side}"}), ["map_id", f"{side}_id"], "left"
        )
    good = is_finite_pose("meas") & F.coalesce(F.size("info") == 21, F.lit(False)) & all_finite("info")
    reason = F.when(~good, "malformed edge").when(
        F.col("_from").isNull() | F.col("_to").isNull(), "missing endpoint"
    )
    return ends.withColumn("reason", reason).drop("_from", "_to")


def accepted_edges(checked: DataFrame, policy="STRICT") -> DataFrame:
    """Good edges; STRICT refuses all edges of a map with a bad one."""
    good = checked.filter("reason is null").drop("reason")
    if policy == "SALVAGE":
        return good
    refused = checked.filter("reason is not null").select("map_id").distinct()
    return good.join(refused, ["map_id"], "left_anti")


def validate_trajectory(trajectory: DataFrame, maps: DataFrame) -> DataFrame:
    """Per map with stored poses: ``reason`` NULL, or why its trajectory is refused."""
    bad = F.count_if(~is_finite("ts") | ~is_finite_pose("pose"))
    stats = trajectory.groupBy("map_id").agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad_rows"))
    reason = F.when(F.col("trajectory_source") == "none", "invalid source").when(
        F.col("bad_rows") > 0, "non-finite pose"
    )
    return stats.join(maps.select("map_id", "trajectory_source"), ["map_id"], "left").withColumn(
        "reason", reason
    )


def version_action(version, supported=MAP_VERSION):
    """Column: ``reject`` a newer version, ``rebuild`` an older or unreadable one, else ``load``."""
    parts = F.split(version, r"\.")
    got = F.struct(*(F.get(parts, F.lit(i)).try_cast("int").alias(f"v{i}") for i in range(3)))
    want = F.struct(*(F.lit(int(v)).alias(f"v{i}") for i, v in enumerate(supported.split("."))))
    known = F.coalesce(
        got["v0"].isNotNull() & got["v1"].isNotNull() & got["v2"].isNotNull(), F.lit(False)
    )
    return (
        F.when(~known, "rebuild").when(got > want, "reject").when(got < want, "rebuild").otherwise("load")
    )


def map_version_gate(maps: DataFrame, supported=MAP_VERSION) -> DataFrame:
    return maps.withColumn("version_action", version_action(F.col("version"), supported))


# Parameters written into the schema string of stored descriptors, in their order; fixed values.
DESCRIPTOR_PARAMS = (
    ("dim", 3037), ("submap_mode", "causal"), ("submap_kf_radius", 3), ("submap_voxel_size", 0.15),
    ("azimuth_bins", 36), ("v2", True), ("v3", False), ("v3_visibility_bins", 72),
    ("v3_free_space_margin_m", 0.15), ("negative_space", True), ("vertical_tokens", True),
    ("pca_confidence", True), ("max_range", 30.0), ("z_min", -2.0), ("z_max", 6.0),
)


def descriptor_schema(**overrides) -> str:
    """Schema string: name=value pairs, reals with six digits, flags as 0 or 1."""

    def text(v):
        if isinstance(v, bool):
            return str(int(v))
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return ";".join(f"{k}={text(overrides.get(k, v))}" for k, v in DESCRIPTOR_PARAMS)


def descriptor_schema_gate(maps: DataFrame, expected=None) -> DataFrame:
    """Whether stored descriptors of a map were built with other parameters."""
    expected = expected or descriptor_schema()
    stale = F.coalesce(F.col("rhpd_schema"), F.lit("")) != expected
    return maps.withColumn("rebuild_descriptors", stale)


def descriptor_restore(
    keyframes: DataFrame, stored: DataFrame, rebuilt: DataFrame, force: DataFrame, dim=3037
) -> DataFrame:
    """Stored descriptors of a map if all its keyframes have one and nothing forces a rebuild.

    ``force``: map_id, rebuild_descriptors. Output: map_id, kf_id, rhpd, rebuilt.

    Descriptors are never broadcast: encoded files and the planner's guess for arrays are far smaller than they are.
    """
    old = stored.select(*CLOUD, F.when(F.size("rhpd") == dim, F.col("rhpd")).alias("_old"))
    have = keyframes.select(*CLOUD).join(old.hint("merge"), CLOUD, "left")
    missing = have.groupBy("map_id").agg(F.bool_or(F.col("_old").isNull()).alias("_missing"))
    flags = missing.join(force, ["map_id"], "left").select(
        "map_id",
        (F.col("_missing") | F.coalesce("rebuild_descriptors", F.lit(False))).alias("rebuilt"),
    )
    fresh = rebuilt.select(*CLOUD, F.col("rhpd").alias("_new"))
    return (
        have.join(flags, ["map_id"])
        .join(fresh.hint("merge"), CLOUD, "left")
        .select(*CLOUD, F.when(F.col("rebuilt"), F.col("_new")).otherwise(F.col("_old")).alias("rhpd"), "rebuilt")
    )


def descriptor_lookup(keyframes: DataFrame, recomputed: DataFrame, stored: DataFrame, indexed: DataFrame):
    """First usable descriptor (right size, not all zero) of three sources."""

    def usable(df, name):
        ok = (F.size("rhpd") == 3037) & F.exists("rhpd", lambda v: v != 0)
        return df.filter(ok).select(*CLOUD, F.col("rhpd").alias(name))

    out = keyframes.select(*CLOUD)
    for name, df in (("_a", recomputed), ("_b", stored), ("_c", indexed)):
        out = out.join(usable(df, name), CLOUD, "left")
    origin = (
        F.when(F.col("_a").isNotNull(), "recomputed")
        .when(F.col("_b").isNotNull(), "keyframe")
        .when(F.col("_c").isNotNull(), "index")
    )
    return out.select(*CLOUD, F.coalesce("_a", "_b", "_c").alias("rhpd"), origin.alias("origin"))


def map_metadata(maps: DataFrame) -> DataFrame:
    """One row per map; empty frame names get their defaults."""

    def named(c, default):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)

    rest = [c for c in maps.columns if c not in ("map_frame", "body_frame")]
    return maps.select(*rest, named("map_frame", "map"), named("body_frame", "body"))


def map_counts(keyframes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keyframes, odometry and loop edges per map."""
    nodes = keyframes.groupBy("map_id").agg(F.count(F.lit(1)).alias("num_keyframes"))
    links = edges.groupBy("map_id").agg(
        F.count_if(F.col("type") == "ODOMETRY").alias("num_odometry_edges"),
        F.count_if(F.col("type") == "LOOP").alias("num_loop_edges"),
    )
    zero = {"num_keyframes": 0, "num_odometry_edges": 0, "num_loop_edges": 0}
    return nodes.join(links, ["map_id"], "full").fillna(zero)


def trajectory_or_fallback(trajectory: DataFrame, keyframes: DataFrame, allow=True, maps=None) -> DataFrame:
    """Stored poses, else one pose per keyframe of maps that have none, marked degraded.

    ``maps`` (map_id, trajectory_source, trajectory_degraded) tells where stored poses came from;
    without it, or with an empty source, they are native and not degraded.
    """
    from lidarlake.operators.sequence import dense_position

    rows = trajectory.select("map_id", "seq", "ts", "pose")
    if maps is not None:
        rows = rows.join(maps.select("map_id", "trajectory_source", "trajectory_degraded"), ["map_id"], "left")
    else:
        none = F.lit(None)
        rows = rows.withColumns({"trajectory_source": none.cast("string"), "trajectory_degraded": none.cast("boolean")})
    native = rows.select(
        "map_id", "seq", "ts", "pose",
        F.coalesce("trajectory_degraded", F.lit(False)).alias("degraded"),
        F.coalesce(F.nullif("trajectory_source", F.lit("")), F.lit("native")).alias("source"),
    )
    if not allow:
        return native
    bare = keyframes.join(trajectory.select("map_id").distinct(), ["map_id"], "left_anti")
    made = dense_position(bare, ["map_id"], "kf_id").select(
        "map_id", F.col("pos").alias("seq"), "ts", F.col("opt").alias("pose"),
        F.lit(True).alias("degraded"), F.lit("keyframe_fallback").alias("source"),
    )
    return native.unionByName(made)


def classify_point(points: DataFrame, rules=None) -> DataFrame:
    """Add ``reason``: the first rule a point breaks, or ``keep``."""
    return points.withColumn("reason", keep_reason(rules or {}))


REASONS = ("non_finite", "range", "self", "rear")


def filter_counts(classified: DataFrame, keys=CLOUD) -> DataFrame:
    """Totals by reason, kept and removed points and the removed ratio, per key."""
    removed = F.count_if(F.col("reason") != "keep")
    n = F.count(F.lit(1))
    return classified.groupBy(*keys).agg(
        n.alias("original_points"),
        F.count_if(F.col("reason") == "keep").alias("kept_points"),
        removed.alias("removed_points"),
        *(F.count_if(F.col("reason") == r).alias(f"removed_{r}") for r in REASONS),
        F.coalesce(removed / n, F.lit(0.0)).alias("removed_ratio"),
    )


def kept_removed_split(classified: DataFrame):
    """The kept points and their complement."""
    kept = classified.filter("reason = 'keep'").drop("reason")
    return kept, classified.filter("reason <> 'keep'")


def policy_text(rules=None) -> str:
    """The filter rules as one string, for the map row."""
    rules = rules or {}

    def number(v):
        return f"{v:g}"

    flags = {True: "true", False: "false"}
    values = (
        ("rear_sector_enable", flags[bool(rules.get("rear_sector", True))]),
        ("rear_sector_center_deg", number(rules.get("center_deg", 180.0))),
        ("rear_sector_width_deg", number(rules.get("width_deg", 45.0))),
        ("forward_axis", rules.get("axis", "x")),
        ("min_range", number(rules.get("min_range", 0.0))),
        ("max_range", number(rules.get("max_range", 1e9))),
        ("self_filter_enable", flags[bool(rules.get("self_box"))]),
    )
    return ";".join(f"{k}={v}" for k, v in values)


def stamp_filter_metadata(maps: DataFrame, counts: DataFrame, rules=None) -> DataFrame:
    """Write the filter policy and the point counts of ``counts`` (per map) on the map rows."""
    per_map = counts.groupBy("map_id").agg(
        F.sum("original_points").alias("_raw"), F.sum("kept_points").alias("_kept"),
        F.sum("removed_points").alias("_removed"),
    )
    return maps.join(per_map, ["map_id"], "left").withColumns(
        {
            "filter_applied": F.lit(True),
            "filter_policy": F.lit(policy_text(rules)),
            "raw_points": F.coalesce("_raw", F.lit(0)),
            "kept_points": F.coalesce("_kept", F.lit(0)),
            "removed_points": F.coalesce("_removed", F.lit(0)),
        }
    ).drop("_raw", "_kept", "_removed")


def emptied_keyframes(counts: DataFrame) -> DataFrame:
    """Keyframes that a filter would leave without points."""
    return counts.filter("kept_points = 0").select(*CLOUD)


def session_counts(frame_results: DataFrame, loops: DataFrame) -> DataFrame:
    """Frames, keyframes and accepted loops per session."""
    frames = frame_results.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("accepted").alias("keyframes")
    )
    closed = loops.groupBy("session_id").agg(F.count(F.lit(1)).alias("loops"))
    return frames.join(closed, ["session_id"], "left").fillna({"loops": 0})


def lock_counter(frame_results: DataFrame, keys=("session_id",), order="seq") -> DataFrame:
    """Running number of lock events per session, on the rows that lock."""
    from lidarlake.operators.sequence import dense_position

    locked = dense_position(frame_results.filter("locked"), list(keys), order)
    return locked.withColumn("lock_count", F.col("pos") + 1).drop("pos")


def pose_lookup(current: DataFrame, initial: DataFrame) -> DataFrame:
    """Current estimate of a node, else its start value."""
    return (
        current.select(*CLOUD, F.col("pose").alias("_c"))
        .join(initial.select(*CLOUD, F.col("pose").alias("_i")), CLOUD, "full")
        .select(*CLOUD, F.coalesce("_c", "_i").alias("pose"))
    )


def refresh_poses(keyframes: DataFrame, poses: DataFrame) -> DataFrame:
    """Overwrite the optimized pose where a new one exists."""
    fresh = poses.select(*CLOUD, F.col("pose").alias("_p"))
    return keyframes.join(fresh, CLOUD, "left").withColumn("opt", F.coalesce("_p", "opt")).drop("_p")
