"""Point clouds in long form: transforms, voxels, bounds, submaps."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.functions.pose import pose_between, transform_xyz
from lidarlake.functions.predicates import is_finite_point

CLOUD = ("map_id", "kf_id")


def transform_points(points: DataFrame, poses: DataFrame, pose="opt", on=CLOUD) -> DataFrame:
    """Move each point by the pose of its cloud.

    The join side is left to the planner: small pose tables are broadcast by their known size,
    large ones are joined on the cloud key, the key that per-cloud aggregates use afterwards.
    """
    moved = points.join(poses.select(*on, F.col(pose).alias("_pose")), list(on))
    x, y, z = transform_xyz("_pose", "x", "y", "z")
    return (
        moved.withColumn("_xyz", F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
        .withColumns({c: F.col(f"_xyz.{c}") for c in "xyz"})
        .drop("_pose", "_xyz")
    )


def voxel_cells(leaf, x="x", y="y", z="z"):
    """The three integer cell columns of a point."""
    inv = 1.0 / leaf
    return {f"v{c}": F.floor(F.col(v) * F.lit(inv)) for c, v in zip("xyz", (x, y, z), strict=True)}


def voxel_sums(points: DataFrame, leaf: float, keys=("map_id",)) -> DataFrame:
    """Mergeable sums per cell over points with finite coordinates."""
    cells = points.filter(is_finite_point()).withColumns(voxel_cells(leaf))
    return cells.groupBy(*keys, "vx", "vy", "vz").agg(
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum("z").alias("sz"),
        F.sum("intensity").alias("si"),
        F.count(F.lit(1)).alias("n"),
    )


def voxel_means(sums: DataFrame) -> DataFrame:
    mean = {c: F.col(f"s{c[0]}") / F.col("n") for c in ("x", "y", "z", "intensity")}
    return sums.withColumns(mean).drop("sx", "sy", "sz", "si")


def voxel_centroid(points: DataFrame, leaf: float, keys=("map_id",)) -> DataFrame:
    """One mean point per cell and key; ``leaf <= 0`` returns the finite points as they are."""
    if not (math.isfinite(leaf) and leaf > 0):
        return points.filter(is_finite_point())
    return voxel_means(voxel_sums(points, leaf, keys))


def voxel_downsample(points: DataFrame, leaf: float, keys=CLOUD) -> DataFrame:
    """One mean point per cell within each cloud."""
    return voxel_centroid(points, leaf, keys)


def voxel_merge(
    state: DataFrame, seen: DataFrame, world_points: DataFrame, leaf: float, keys=("map_id",)
):
    """Add clouds not seen before to stored sums.

    Returns the new sums, the new set of seen clouds, and per map the flag ``changed``. Clouds
    already seen are ignored even if their pose moved; pass empty ``state`` and ``seen`` to rebuild.
    """
    fresh = world_points.filter(is_finite_point()).join(seen, list(CLOUD), "left_anti")
    added = fresh.select(*CLOUD).distinct()
    sums = ("sx", "sy", "sz", "si", "n")
    merged = (
        state.unionByName(voxel_sums(fresh, leaf, keys))
        .groupBy(*keys, "vx", "vy", "vz")
        .agg(*(F.sum(c).alias(c) for c in sums))
    )
    changed = added.groupBy(*keys).agg(F.lit(True).alias("changed"))
    return merged, seen.unionByName(added), changed


def next_revision(revisions: DataFrame, changed: DataFrame, keys=("map_id",)) -> DataFrame:
    """Advance the revision of maps that changed."""
    return revisions.join(changed, list(keys), "full").select(
        *keys,
        (F.coalesce("revision", F.lit(0)) + F.when(F.col("changed"), 1).otherwise(0)).alias("revision"),
    )


def bounding_box(points: DataFrame, keys=CLOUD) -> DataFrame:
    aggs = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]
    return points.filter(is_finite_point()).groupBy(*keys).agg(*aggs)


def voxel_extent_ok(points: DataFrame, leaf: float, keys=CLOUD, limit=2**31 - 1) -> DataFrame:
    """Whether the cell grid over the bounding box fits 32-bit indices, per axis and in total."""
    box = bounding_box(points, keys)
    cells = {
        f"n{c}": F.floor(F.col(f"max_{c}") / leaf) - F.floor(F.col(f"min_{c}") / leaf) + 1
        for c in "xyz"
    }
    ok = (
        F.greatest("nx", "ny", "nz") <= limit
    ) & (F.col("nx").cast("double") * F.col("ny").cast("double") * F.col("nz").cast("double") <= limit)
    return box.withColumns(cells).withColumn("extent_ok", ok).select(*keys, "nx", "ny", "nz", "extent_ok")


def concat_clouds(*clouds: DataFrame) -> DataFrame:
    """Bag union."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out


def submap_members(centers: DataFrame, keyframes: DataFrame, before: int, after: int,
                   root=None) -> DataFrame:
    """Keyframes with ids from ``center - before`` to ``center + after`` of each center.

    ``root`` names a column of ``centers`` with the keyframe whose frame to use; without it the
    pose stays in the map frame. Output: map_id, center_id, [root], kf_id, pose.
    """
    slots = centers.withColumn(
        "kf_id", F.explode(F.sequence(F.col("center_id") - before, F.col("center_id") + after))
    )
    poses = keyframes.select("map_id", "kf_id", F.col("opt").alias("_opt"))
    out = slots.join(poses, ["map_id", "kf_id"])
    if root is None:
        return out.withColumnRenamed("_opt", "pose")
    roots = keyframes.select("map_id", F.col("kf_id").alias(root), F.col("opt").alias("_root"))
    return (
        out.join(roots, ["map_id", root])
        .withColumn("pose", pose_between("_root", "_opt"))
        .drop("_opt", "_root")
    )


def member_points(members: DataFrame, points: DataFrame) -> DataFrame:
    """Points of all members, moved by each member's pose; keeps the member columns."""
    joined = members.join(points, ["map_id", "kf_id"])
    x, y, z = transform_xyz("pose", "x", "y", "z")
    return (
        joined.withColumn("_xyz", F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
        .withColumns({c: F.col(f"_xyz.{c}") for c in "xyz"})
        .drop("pose", "_xyz")
    )


def submap(centers, keyframes, points, radius=5, root=None) -> DataFrame:
    """Union of the clouds within ``radius`` ids of each center."""
    return member_points(submap_members(centers, keyframes, radius, radius, root), points)


def causal_submap(centers, keyframes, points, radius=3, root="root_id") -> DataFrame:
    """Same, but only the center and earlier ids."""
    if root == "root_id" and root not in centers.columns:
        centers = centers.withColumn(root, F.col("center_id"))
    return member_points(submap_members(centers, keyframes, radius, 0, root), points)


def submap_by_rank(centers, keyframes, points, radius=2) -> DataFrame:
    """Neighbours by position in id order instead of by id."""
    from lidarlake.operators.sequence import dense_position

    ranked = dense_position(keyframes.select("map_id", "kf_id", "opt"), ["map_id"], "kf_id")
    at = ranked.select("map_id", F.col("kf_id").alias("center_id"), F.col("pos").alias("_c"))
    slots = (
        centers.join(at, ["map_id", "center_id"])
        .withColumn("pos", F.explode(F.sequence(F.col("_c") - radius, F.col("_c") + radius)))
        .drop("_c")
    )
    members = slots.join(ranked, ["map_id", "pos"]).drop("pos").withColumnRenamed("opt", "pose")
    return member_points(members, points)
