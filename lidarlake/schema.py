"""Explicit schemas of the map tables. Readers never infer."""

POSE_FIELDS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
POSE_DDL = "struct<" + ",".join(f"{f}:double" for f in POSE_FIELDS) + ">"

POINTS_DDL = (
    "map_id long, kf_id long, pt_id long, x double, y double, z double, intensity double"
)
KEYFRAMES_DDL = (
    f"map_id long, kf_id long, ts double, odom {POSE_DDL}, opt {POSE_DDL}, from_loaded boolean"
)
EDGES_DDL = (
    f"map_id long, from_id long, to_id long, meas {POSE_DDL}, info array<double>, type string"
)
TRAJECTORY_DDL = f"map_id long, seq long, ts double, pose {POSE_DDL}"
DESCRIPTORS_DDL = "map_id long, kf_id long, polar array<double>, rhpd array<double>"
MAPS_DDL = (
    "map_id long, version string, rhpd_schema string, map_frame string, body_frame string, "
    "num_keyframes long, num_odometry_edges long, num_loop_edges long, filter_applied boolean, "
    "filter_policy string, raw_points long, kept_points long, removed_points long, "
    "trajectory_source string, trajectory_degraded boolean"
)

# Table name -> schema; the layout of a stored map.
MAP_TABLES = {
    "maps": MAPS_DDL,
    "keyframes": KEYFRAMES_DDL,
    "points": POINTS_DDL,
    "descriptors": DESCRIPTORS_DDL,
    "edges": EDGES_DDL,
    "trajectory": TRAJECTORY_DDL,
}

# Fixed values that stored maps agree on.
MAP_VERSION = "2.3.0"
