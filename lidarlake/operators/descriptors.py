"""Place descriptors of clouds, built by grouped aggregation.

``cloud_cells`` bins every point once into the cells of all parts, so one scan and one shuffle
(with map-side combination) serve planes, rings, sectors and tokens together.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions import vectors as V
from lidarlake.functions.scores import azimuth_bin, azimuth_deg, clamp, polar_bin
from lidarlake.operators.neighbors import POINTS_IN_TASK, split_large
from lidarlake.operators.placevec import submap_vectors
from lidarlake.session import materialize

CLOUD = ["map_id", "kf_id"]
RANGE, Z_MIN, Z_MAX, MIN_POINTS = 30.0, -2.0, 6.0, 20
LIDAR_HEIGHT = 2.0


def pca_2d(points: DataFrame, min_points=MIN_POINTS, confidence=True) -> DataFrame:
    """Mean, covariance, principal angle and elongation of each cloud in the ground plane."""
    stats = points.groupBy(*CLOUD).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.var_pop("x").alias("cxx"),
        F.covar_pop("x", "y").alias("cxy"),
        F.var_pop("y").alias("cyy"),
    )
    half_gap = F.sqrt(((F.col("cxx") - F.col("cyy")) / 2) ** 2 + F.col("cxy") ** 2)
    mid = (F.col("cxx") + F.col("cyy")) / 2
    l1, l2 = F.greatest(mid + half_gap, F.lit(0.0)), F.greatest(mid - half_gap, F.lit(0.0))
    elongation = F.when(l1 + l2 <= 1e-9, 0.0).otherwise(clamp(F.try_divide(l1 - l2, l1 + l2), 0.0, 1.0))
    few = F.col("n") < min_points
    conf = F.when(few, 0.0).otherwise(elongation) if confidence else F.lit(1.0)
    return stats.withColumn(
        "angle", F.when(few, 0.0).otherwise(0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")))
    ).withColumn("confidence", conf)


def _scaled_bin(v, lo, hi, n):
    return clamp(F.floor((v - lo) / (hi - lo) * n).cast("int"), 0, n - 1)


def _plane_axes(ax, ay, z, rng, z_min, z_max):
    """(first axis, second axis, height) of the three planes, each with its limits."""
    flat, tall = (-rng, rng), (z_min, z_max)
    return [
        ((ax, *flat), (ay, *flat), (z, *tall)),
        ((ax, *flat), (z, *tall), (ay, *flat)),
        ((ay, *flat), (z, *tall), (ax, *flat)),
    ]


def cloud_cells(
    points: DataFrame, pca: DataFrame = None, parts=("plane", "ring", "sector"), rng=RANGE,
    z_min=Z_MIN, z_max=Z_MAX, azimuths=36, frontier_sectors=72,
) -> DataFrame:
    """Counts and sums per cell: map_id, kf_id, part, c0, c1, c2, n, s1, s2, lo, hi.

    Parts: ``plane`` (plane, row, column; height), ``front`` (plane, sector; range), ``ring``
    (ring, layer, azimuth; range), ``sector`` (sector; range). Only planes need ``pca``.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r = F.sqrt(x * x + y * y)

    def cell(part, keep, c0, c1, c2, value):
        return F.when(
            keep,
            F.struct(
                F.lit(part).alias("part"),
                _int(c0).alias("c0"), _int(c1).alias("c1"), _int(c2).alias("c2"),
                value.alias("v"),
            ),
        )

    cells = []
    if "plane" in parts or "front" in parts:
        angles = pca.select(*CLOUD, F.cos("angle").alias("_c"), F.sin("angle").alias("_s"))
        points = points.join(angles, CLOUD)
        ax = x * F.col("_c") + y * F.col("_s")
        ay = y * F.col("_c") - x * F.col("_s")
        for p, (a, b, h) in enumerate(_plane_axes(ax, ay, z, rng, z_min, z_max)):
            inside = (a[0] >= a[1]) & (a[0] < a[2]) & (b[0] >= b[1]) & (b[0] < b[2])
            if "plane" in parts:
                i0, i1 = (_scaled_bin(*axis, V.BINS) for axis in (a, b))
                height = clamp((h[0] - h[1]) / (h[2] - h[1]), 0.0, 1.0)
                cells.append(cell("plane", inside, p, i0, i1, height))
            if "front" in parts:
                sector = azimuth_bin(a[0], b[0], frontier_sectors)
                cells.append(cell("front", inside, p, sector, 0, F.hypot(a[0], b[0])))
    near = (r > 0.1) & (r < rng)
    if "ring" in parts:
        ring = clamp(F.floor(r / rng * V.RINGS).cast("int"), 0, V.RINGS - 1)
        cells.append(
            cell("ring", near & (z >= z_min) & (z < z_max), ring,
                 _scaled_bin(z, z_min, z_max, V.LAYERS), azimuth_bin(x, y, azimuths), r)
        )
    if "sector" in parts:
        cells.append(cell("sector", near, azimuth_bin(x, y, V.SECTORS), 0, 0, r))
    return (
        points.select(*CLOUD, F.explode(F.array(*cells)).alias("c"))
        .filter("c is not null")
        .select(*CLOUD, "c.*")
        .groupBy(*CLOUD, "part", "c0", "c1", "c2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("v").alias("s1"),
            F.sum(F.col("v") * F.col("v")).alias("s2"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
    )


def _int(v):
    return F.lit(v) if isinstance(v, int) else v


def plane_histogram(cells: DataFrame) -> DataFrame:
    """Per occupied bin: density, mean height, count over the largest count, height extent."""
    w = Window.partitionBy(*CLOUD, "c0")
    return cells.filter("part = 'plane'").select(
        *CLOUD,
        F.col("c0").alias("plane"),
        F.col("c1").alias("i0"),
        F.col("c2").alias("i1"),
        "n",
        (F.col("n") / F.sum("n").over(w)).alias("density"),
        (F.col("s1") / F.col("n")).alias("mean_height"),
        (F.col("n") / F.max("n").over(w)).alias("hit_ratio"),
        (F.col("hi") - F.col("lo")).alias("height_extent"),
    )


def _plane_grid(rng, z_min, z_max, sectors):
    """Array of all bins of all planes: range and sector of the bin centre."""
    bounds = [((-rng, rng), (-rng, rng)), ((-rng, rng), (z_min, z_max)), ((-rng, rng), (z_min, z_max))]
    out = []
    for p, ((a0, a1), (b0, b1)) in enumerate(bounds):
        for i in range(V.BINS):
            for j in range(V.BINS):
                c0 = a0 + (i + 0.5) / V.BINS * (a1 - a0)
                c1 = b0 + (j + 0.5) / V.BINS * (b1 - b0)
                s = int((math.atan2(c1, c0) + math.pi) / (2 * math.pi) * sectors)
                out.append((p, i, j, math.hypot(c0, c1), min(max(s, 0), sectors - 1)))
    return out


def plane_visibility(
    cells: DataFrame, margin=0.15, sectors=72, rng=RANGE, z_min=Z_MIN, z_max=Z_MAX
) -> DataFrame:
    """State of every bin (1 occupied, 0.5 free, 0 unknown) and its contrast to the neighbours.

    Needs cells of the parts ``plane`` and ``front``. A cloud has at most 588 bins, so its state
    arrays stay small however many points it has.
    """
    planes = cells.filter("part in ('plane', 'front')").groupBy(*CLOUD, F.col("c0").alias("plane")).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("part") == "front", F.struct("c1", "hi")))
        ).alias("front"),
        F.collect_set(
            F.when(F.col("part") == "plane", F.col("c1") * V.BINS + F.col("c2"))
        ).alias("occupied"),
    )
    grid = _plane_grid(rng, z_min, z_max, sectors)
    by_plane = [[(rc, s) for p, _, _, rc, s in grid if p == plane] for plane in range(V.PLANES)]
    centres = F.array(
        *(
            F.array(*(F.struct(F.lit(rc).alias("rc"), F.lit(s).alias("s")) for rc, s in cells_of))
            for cells_of in by_plane
        )
    )
    n = V.BINS * V.BINS
    state = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(F.array_contains("occupied", i), 1.0)
        .when(
            F.coalesce(F.try_element_at(F.col("front"), F.get(F.col("centre"), i)["s"]), F.lit(0.0))
            > F.greatest(F.lit(1e-6), F.get(F.col("centre"), i)["rc"] + margin),
            0.5,
        )
        .otherwise(0.0),
    )
    states = planes.withColumn("centre", F.get(centres, F.col("plane"))).withColumn("state", state)
    flat = states.select(*CLOUD, "plane", "state", F.posexplode("state").alias("cell", "visibility"))
    row, col = F.floor(F.col("cell") / V.BINS).cast("int"), F.col("cell") % V.BINS

    def step(ok, offset):
        return F.when(ok, F.abs(F.col("visibility") - F.get("state", F.col("cell") + offset)))

    sides = [
        step(row > 0, -V.BINS),
        step(row < V.BINS - 1, V.BINS),
        step(col > 0, -1),
        step(col < V.BINS - 1, 1),
    ]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sides), F.lit(0.0))
    count = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in sides), F.lit(0))
    return flat.select(
        *CLOUD, "plane", row.alias("i0"), col.alias("i1"), "visibility",
        clamp(total / count, 0.0, 1.0).alias("boundary"),
    )


def ring_height_stats(cells: DataFrame, rng=RANGE, azimuths=36) -> DataFrame:
    """Per ring and layer: density, azimuth variance, mean range, range spread."""
    layers = (
        cells.filter("part = 'ring'")
        .groupBy(*CLOUD, F.col("c0").alias("ring"), F.col("c1").alias("layer"))
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("n")).alias("nn"),
            F.sum("s1").alias("s1"),
            F.sum("s2").alias("s2"),
        )
    )
    total = F.sum("n").over(Window.partitionBy(*CLOUD))
    mean_count = F.col("n") / azimuths
    variance = (F.col("nn") - F.col("n") * F.col("n") / azimuths) / azimuths
    mean = F.col("s1") / F.col("n")
    spread = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    return layers.select(
        *CLOUD, "ring", "layer", "n",
        (F.col("n") / total).alias("density"),
        (F.least(variance / (mean_count * mean_count), F.lit(10.0)) / 10.0).alias("azimuth_var"),
        (mean / rng).alias("mean_range"),
        (F.sqrt(spread) / rng).alias("range_std"),
    )


def negative_space(cells: DataFrame, rng=RANGE) -> DataFrame:
    """All sectors of each cloud with nearest hit, span and open / unknown state."""
    s = V.SECTORS
    hits = cells.filter("part = 'sector'").groupBy(*CLOUD).agg(
        F.map_from_entries(F.collect_list(F.struct("c0", F.struct("lo", "hi")))).alias("hits")
    )
    flat = hits.select(*CLOUD, "hits", F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("sector"))

    def hit(i):
        return F.try_element_at(F.col("hits"), i)

    me = hit(F.col("sector"))
    near_side = hit((F.col("sector") + 1) % s).isNotNull() | hit((F.col("sector") + s - 1) % s).isNotNull()
    seen = me.isNotNull()
    state = (
        F.when(seen & (me["hi"] >= 0.75 * rng), 1.0).when(seen, 0.0).when(near_side, 0.75).otherwise(0.5)
    )
    return flat.select(
        *CLOUD, "sector",
        F.when(seen, clamp(me["lo"] / rng, 0.0, 1.0)).otherwise(1.0).alias("nearest"),
        F.when(seen, clamp((me["hi"] - me["lo"]) / rng, 0.0, 1.0)).otherwise(0.0).alias("span"),
        state.alias("state"),
    )


def vertical_tokens(cells: DataFrame, rings=V.TOKEN_RINGS) -> DataFrame:
    """Share of each occupied-layer pattern among the active sectors of a coarse ring.

    Coarse rings, sectors and layers are unions of the fine ring cells.
    """
    per = V.RINGS // rings
    layer4 = F.floor(F.col("c1") / (V.LAYERS // 4)).cast("int")
    masks = (
        cells.filter("part = 'ring'")
        .groupBy(*CLOUD, F.floor(F.col("c0") / per).cast("int").alias("ring"), F.col("c2").alias("sector"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), layer4)).alias("token"))
    )
    counts = masks.groupBy(*CLOUD, "ring", "token").agg(F.count(F.lit(1)).alias("n"))
    active = F.sum("n").over(Window.partitionBy(*CLOUD, "ring"))
    return counts.select(*CLOUD, "ring", "token", "n", (F.col("n") / active).alias("share"))


def descriptor_values(cells: DataFrame, pca: DataFrame, min_points=MIN_POINTS, v3=False) -> DataFrame:
    """Non-zero entries of the full vector: map_id, kf_id, idx, v."""

    def spread(df, base, *channels):
        pairs = F.array(
            *(F.struct((base + i).cast("int").alias("idx"), F.col(c).cast("double").alias("v"))
              for i, c in enumerate(channels))
        )
        return df.select(*CLOUD, F.explode(pairs).alias("e")).select(*CLOUD, "e.idx", "e.v")

    plane_base = F.col("plane") * V.PLANE_DIM + (F.col("i0") * V.BINS + F.col("i1")) * V.PLANE_CH
    planes = plane_histogram(cells)
    if v3:
        parts = [
            spread(planes, plane_base, "density", "mean_height"),
            spread(plane_visibility(cells), plane_base + 2, "visibility", "boundary"),
        ]
    else:
        parts = [spread(planes, plane_base, "density", "mean_height", "hit_ratio", "height_extent")]
    parts += [
        spread(
            ring_height_stats(cells),
            V.PART_A + (F.col("ring") * V.LAYERS + F.col("layer")) * V.RING_CH,
            "density", "azimuth_var", "mean_range", "range_std",
        ),
        spread(negative_space(cells), V.SECTOR_BASE + F.col("sector") * V.SECTOR_CH, "nearest", "span", "state"),
        spread(vertical_tokens(cells), V.TOKEN_BASE + F.col("ring") * V.TOKENS + F.col("token"), "share"),
        spread(pca, F.lit(V.CONF_INDEX), "confidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    enough = pca.filter(F.col("n") >= min_points).select(*CLOUD)
    return out.filter("v <> 0").join(enough, CLOUD, "left_semi")


def assemble_descriptor(values: DataFrame, clouds: DataFrame) -> DataFrame:
    """Dense vector per cloud; clouds without values (too few points) get zeros."""
    pairs = values.groupBy(*CLOUD).agg(F.collect_list(F.struct("idx", "v")).alias("e"))
    empty_i, empty_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    return (
        clouds.select(*CLOUD)
        .join(pairs, CLOUD, "left")
        .select(
            *CLOUD,
            V.dense_vector(V.RHPD_DIM)(
                F.coalesce(F.col("e.idx"), empty_i), F.coalesce(F.col("e.v"), empty_v)
            ).alias("rhpd"),
        )
    )


#: Points of whole clouds that one task bins.
POINTS_PER_TASK = 250_000


def _cells_by_cloud(points: DataFrame, pca: DataFrame, parts=("plane", "ring", "sector")) -> DataFrame:
    """``cloud_cells``; clouds that fit a task come together before they are binned.

    A point falls into several cells, and where the points of a cloud are spread over all tasks, hardly any two
    share a cell. Tasks grow in number with the points, so none holds more cells in a larger table. Larger
    clouds are binned where they lie. ``pca`` is read several times: pass a written table.
    """
    total, most = pca.agg(F.sum("n"), F.max("n")).first()
    width = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // POINTS_PER_TASK))
    if (most or 0) <= POINTS_IN_TASK:
        return cloud_cells(points.repartition(width, *CLOUD), pca, parts)
    large = pca.filter(F.col("n") > POINTS_IN_TASK).select(*CLOUD)
    near = cloud_cells(points.join(large, CLOUD, "left_anti").repartition(width, *CLOUD), pca, parts)
    return near.unionByName(cloud_cells(points.join(large, CLOUD, "left_semi"), pca, parts))


def rhpd_descriptors(points: DataFrame, min_points=MIN_POINTS, v3=False, confidence=True) -> DataFrame:
    """Full vector of every cloud in ``points``: map_id, kf_id, rhpd."""
    pca = materialize(pca_2d(points, min_points, confidence))
    parts = ("plane", "front", "ring", "sector") if v3 else ("plane", "ring", "sector")
    # Written once: each part would otherwise bin the points again behind its own filter.
    cells = materialize(_cells_by_cloud(points, pca, parts))
    # Every part works within clouds: the few cells are dealt by cloud once, and no part deals its rows again.
    cells = cells.repartition(*CLOUD)
    return assemble_descriptor(descriptor_values(cells, pca, min_points, v3), pca)


def submap_descriptors(keyframes, points, radius=3, leaf=0.15, min_points=MIN_POINTS) -> DataFrame:
    """Full vector of every keyframe from the thinned clouds of itself and earlier neighbours.

    Maps of at most POINTS_IN_TASK points are described in tasks, where their points are shuffled once.
    """
    (keyframes, points), large = split_large([keyframes, points], ["map_id"], POINTS_IN_TASK)
    near = submap_vectors(keyframes, points, radius, leaf, min_points)
    return near if large is None else near.unionByName(_submap_descriptors(*large, radius, leaf, min_points))


def _submap_descriptors(keyframes, points, radius, leaf, min_points):
    """The same over tables, for maps of any size."""
    from lidarlake.operators.clouds import causal_submap, voxel_downsample

    centers = keyframes.select("map_id", F.col("kf_id").alias("center_id"))
    cloud = causal_submap(centers, keyframes, points, radius).drop("kf_id", "root_id")
    cloud = cloud.withColumnRenamed("center_id", "kf_id")
    if leaf > 1e-4:
        cloud = voxel_downsample(cloud, leaf)
    return rhpd_descriptors(cloud, min_points)


def polar_cells(points: DataFrame, rings=20, sectors=60, rmax=80.0, log=True) -> DataFrame:
    """Occupied (ring, sector) bins with the seven channel values."""
    z = F.col("z")
    quarter = (Z_MAX - Z_MIN) / 4
    layer = F.when(
        (z >= Z_MIN) & (z < Z_MAX), F.least(F.floor((z - Z_MIN) / quarter).cast("int"), F.lit(3))
    )
    binned = (
        points.withColumn("_b", polar_bin("x", "y", rings, sectors, rmax, log=log))
        .filter("_b is not null")
        .select(*CLOUD, "_b.ring", "_b.sector", (z + LIDAR_HEIGHT).alias("h"), layer.alias("layer"))
        .groupBy(*CLOUD, "ring", "sector")
        .agg(
            F.max("h").alias("max_height"),
            F.stddev_pop("h").alias("height_std"),
            F.count(F.lit(1)).alias("n"),
            *(F.count_if(F.col("layer") == i).alias(f"n{i}") for i in range(4)),
        )
    )
    most = F.max("n").over(Window.partitionBy(*CLOUD))
    return binned.select(
        *CLOUD, "ring", "sector", "max_height", "height_std",
        (F.col("n") / most).alias("density"),
        *((F.col(f"n{i}") / F.col("n")).alias(f"layer{i}") for i in range(4)),
    )


POLAR_COLUMNS = ("max_height", "height_std", "density", "layer0", "layer1", "layer2", "layer3")


def polar_values(cells: DataFrame) -> DataFrame:
    """Long form of the polar matrix: map_id, kf_id, ch, ring, sector, v."""
    pairs = F.array(
        *(F.struct(F.lit(i).alias("ch"), F.col(c).alias("v")) for i, c in enumerate(POLAR_COLUMNS))
    )
    return cells.select(*CLOUD, "ring", "sector", F.explode(pairs).alias("e")).select(
        *CLOUD, "e.ch", "ring", "sector", "e.v"
    )


def polar_descriptors(points: DataFrame, rings=20, sectors=60, rmax=80.0, cells=None) -> DataFrame:
    """Dense seven-channel matrix of every cloud: map_id, kf_id, polar. ``cells``: its ``polar_cells``, where they are known."""
    values = polar_values(polar_cells(points, rings, sectors, rmax) if cells is None else cells)
    return _dense_polar(points, values, len(POLAR_COLUMNS), rings, sectors)


def _dense_polar(points, values, channels, rings, sectors):
    idx = ((F.col("ch") * rings + F.col("ring")) * sectors + F.col("sector")).cast("int")
    pairs = values.filter("v <> 0").groupBy(*CLOUD).agg(F.collect_list(F.struct(idx.alias("idx"), "v")).alias("e"))
    clouds = points.select(*CLOUD).distinct()
    empty_i, empty_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    return clouds.join(pairs, CLOUD, "left").select(
        *CLOUD,
        V.dense_vector(channels * rings * sectors)(
            F.coalesce(F.col("e.idx"), empty_i), F.coalesce(F.col("e.v"), empty_v)
        ).alias("polar"),
    )


def ring_key(values: DataFrame, sectors=60) -> DataFrame:
    """Mean of every matrix row (zeros included); rows without points are absent."""
    return values.groupBy(*CLOUD, "ch", "ring").agg((F.sum("v") / sectors).alias("mean"))


def sector_key(values: DataFrame, rows=140) -> DataFrame:
    """Mean of every matrix column over all channels."""
    return values.groupBy(*CLOUD, "sector").agg((F.sum("v") / rows).alias("mean"))


def ring_key_vectors(values: DataFrame, clouds: DataFrame, channels=7, rings=20, sectors=60) -> DataFrame:
    """Ring key as a dense array per cloud."""
    keys = ring_key(values, sectors)
    idx = (F.col("ch") * rings + F.col("ring")).cast("int")
    pairs = keys.groupBy(*CLOUD).agg(F.collect_list(F.struct(idx.alias("idx"), "mean")).alias("e"))
    empty_i, empty_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    return clouds.select(*CLOUD).join(pairs, CLOUD, "left").select(
        *CLOUD,
        V.dense_vector(channels * rings)(
            F.coalesce(F.col("e.idx"), empty_i), F.coalesce(F.col("e.mean"), empty_v)
        ).alias("ring_key"),
    )


def classic_polar_values(points: DataFrame, rings=20, sectors=60, rmax=80.0) -> DataFrame:
    """Single-channel form: greatest height per linear ring and sector, upper bin edges included."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    ring = clamp(F.ceil(r / rmax * rings).cast("int"), 1, rings) - 1
    sector = clamp(F.ceil(azimuth_deg("x", "y") / 360.0 * sectors).cast("int"), 1, sectors) - 1
    return (
        points.filter(r <= rmax)
        .groupBy(*CLOUD, ring.alias("ring"), sector.alias("sector"))
        .agg(F.max(F.col("z") + LIDAR_HEIGHT).alias("v"))
        .withColumn("ch", F.lit(0))
    )


def classic_polar_descriptors(points: DataFrame, rings=20, sectors=60, rmax=80.0) -> DataFrame:
    return _dense_polar(points, classic_polar_values(points, rings, sectors, rmax), 1, rings, sectors)
