"""Choosing, numbering and ordering rows per query, map or session."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions.pose import pose_between
from lidarlake.functions.predicates import reloc_passes
from lidarlake.functions.scores import edge_information
from lidarlake.operators.sequence import dense_position


def best_per_query(matches: DataFrame, keys=("map_id", "query_id")) -> DataFrame:
    """Lowest fitness per query; the lower match id wins a tie."""
    rest = [c for c in matches.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("fitness", "match_id"))
    return matches.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def _planar(a, b):
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def basins(candidates: DataFrame, radius=4.0, keys=("map_id", "query_id")) -> DataFrame:
    """Group ranked candidates of a query around at most three leaders in the ground plane.

    ``candidates``: keys, match_id, rank, x, y. The next leader is the first candidate farther
    than ``radius`` from all leaders before it; every other candidate joins the nearest leader
    that outranks it, or none. The candidates of a query are few (the kept top k).
    """
    w = Window.partitionBy(*keys)
    here = {"x": F.col("x"), "y": F.col("y")}
    out = candidates
    leaders = []
    for i in range(3):
        far = F.lit(True)
        for name in leaders:
            far = far & (_planar(here, F.col(name)) > radius)
        spot = F.when(far, F.struct("x", "y", "rank", "match_id"))
        if leaders:
            spot = F.when(F.col(leaders[-1]).isNotNull(), spot)
        out = out.withColumn(f"_l{i}", F.min_by(spot, F.when(spot.isNotNull(), F.col("rank"))).over(w))
        leaders.append(f"_l{i}")
    options = []
    for i, name in enumerate(leaders):
        d = _planar(here, F.col(name))
        usable = F.col(name).isNotNull() & (F.col(f"{name}.rank") <= F.col("rank"))
        options.append(
            F.when(usable, F.struct(d.alias("d"), F.lit(i).alias("basin"), F.col(f"{name}.match_id").alias("m")))
        )
    pick = F.least(*options)
    return (
        out.withColumn("_p", pick)
        .filter(F.col("_p.d") <= radius)
        .withColumn("basin", F.col("_p.basin"))
        .withColumn("basin_center", F.col("_p.m"))
        .drop("_p", *leaders)
    )


def best_per_basin(members: DataFrame, verify=3, keys=("map_id", "query_id"), **gate) -> DataFrame:
    """Best verified candidate of each basin by fitness plus descriptor score.

    Only the first ``verify`` members by rank count. ``members`` carry the registration columns.
    """
    w = Window.partitionBy(*keys, "basin").orderBy("rank")
    score = F.col("fitness") + F.coalesce("fused_score", F.lit(1.0))
    tried = (
        members.withColumn("_n", F.row_number().over(w))
        .filter((F.col("_n") <= verify) & reloc_passes(**gate))
        .withColumn("selection_score", score)
        .drop("_n")
    )
    rest = [c for c in tried.columns if c not in (*keys, "basin")]
    best = F.min_by(F.struct(*rest), F.struct("selection_score", "rank"))
    return tried.groupBy(*keys, "basin").agg(best.alias("_r")).select(*keys, "basin", "_r.*")


def ambiguous_basins(best: DataFrame, min_sep=3.0, gap=0.03, keys=("map_id", "query_id")) -> DataFrame:
    """Per query whether its two best basins lie apart but fit equally well."""
    w = Window.partitionBy(*keys).orderBy("selection_score", "basin")
    top = best.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    side = [F.max(F.when(F.col("_n") == i, F.struct("x", "y", "fitness"))).alias(f"b{i}") for i in (1, 2)]
    a, b = F.col("b1"), F.col("b2")
    clash = (_planar(a, b) >= min_sep) & (
        F.abs(a["fitness"] - b["fitness"]) <= gap
    )
    return top.groupBy(*keys).agg(*side).select(*keys, F.coalesce(clash, F.lit(False)).alias("ambiguous"))


def best_candidate(matches: DataFrame, eps=1e-4, keys=("map_id", "query_id"), **gate) -> DataFrame:
    """Lowest fitness per query; within ``eps`` of it the smaller descriptor distance wins."""
    good = matches.filter(reloc_passes(**gate))
    low = good.groupBy(*keys).agg(F.min("fitness").alias("_low"))
    tied = good.join(low, list(keys)).filter(F.col("fitness") <= F.col("_low") + eps).drop("_low")
    rest = [c for c in tied.columns if c not in keys]
    best = F.min_by(
        F.struct(*rest), F.struct(F.coalesce("rhpd_distance", "sc_distance"), "fitness", "match_id")
    )
    return tied.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def assign_ids(accepted: DataFrame, max_ids: DataFrame, order: str, key="map_id") -> DataFrame:
    """Continue the numbering of each map after its highest id."""
    placed = dense_position(accepted, [key], order).join(max_ids, [key], "left")
    return placed.withColumn("kf_id", F.coalesce("max_id", F.lit(-1)) + 1 + F.col("pos")).drop("pos", "max_id")


def odometry_edges(keyframes: DataFrame) -> DataFrame:
    """Constraint from the keyframe with the id before; none where that id is missing."""
    prev = keyframes.select("map_id", (F.col("kf_id") + 1).alias("kf_id"), F.col("odom").alias("_prev"))
    return keyframes.join(prev, ["map_id", "kf_id"]).select(
        "map_id",
        (F.col("kf_id") - 1).alias("from_id"),
        F.col("kf_id").alias("to_id"),
        pose_between("_prev", "odom").alias("meas"),
        edge_information(F.lit("ODOMETRY")).alias("info"),
        F.lit("ODOMETRY").alias("type"),
    )


def bridge_edge(new_keyframes: DataFrame, locks: DataFrame, loaded: DataFrame) -> DataFrame:
    """Constraint from the matched keyframe to the first new keyframe of each map.

    ``locks``: map_id, match_id, last_id (id of the last keyframe, NULL if unset). With a last id
    the edge is an odometry edge from it, else a loop edge from the match.
    """
    first = new_keyframes.groupBy("map_id").agg(
        F.min_by(F.struct(F.col("kf_id").alias("to_id"), F.col("odom").alias("_new")), "kf_id").alias("_f")
    )
    kind = F.when(F.col("last_id").isNotNull(), "ODOMETRY").otherwise("LOOP")
    start = locks.withColumn("from_id", F.coalesce("last_id", "match_id")).withColumn("type", kind)
    base = loaded.select("map_id", F.col("kf_id").alias("from_id"), F.col("opt").alias("_old"))
    return (
        first.select("map_id", "_f.*")
        .join(start, ["map_id"])
        .join(base, ["map_id", "from_id"])
        .select(
            "map_id", "from_id", "to_id", pose_between("_old", "_new").alias("meas"),
            edge_information("type").alias("info"), "type",
        )
    )


def anchor_row(keyframes: DataFrame) -> DataFrame:
    """First node of each graph with its pose."""
    return keyframes.groupBy("map_id").agg(F.min("kf_id").alias("kf_id"), F.min_by("opt", "kf_id").alias("opt"))


def sample_every(keyframes: DataFrame, max_queries: int, stride=0) -> DataFrame:
    """Every n-th keyframe of each map by id, at most ``max_queries`` of them."""
    limit = max(1, max_queries)
    size = keyframes.groupBy("map_id").agg(F.count(F.lit(1)).alias("_n"))
    step = F.lit(stride) if stride > 0 else F.greatest(F.lit(1), F.ceil(F.col("_n") / limit))
    placed = dense_position(keyframes, ["map_id"], "kf_id").join(size, ["map_id"])
    return placed.filter((F.col("pos") % step == 0) & (F.col("pos") / step < max_queries)).drop("_n")


def latest_keyframe(keyframes: DataFrame) -> DataFrame:
    rest = [c for c in keyframes.columns if c != "map_id"]
    return keyframes.groupBy("map_id").agg(F.max_by(F.struct(*rest), "kf_id").alias("_r")).select("map_id", "_r.*")


def path(keyframes: DataFrame) -> DataFrame:
    """Positions in id order with the origin of each keyframe."""
    origin = F.when(F.col("from_loaded"), "loaded").otherwise("new")
    return keyframes.select(
        "map_id", "kf_id", "opt.tx", "opt.ty", "opt.tz", origin.alias("origin")
    ).orderBy("map_id", "kf_id")


def loop_pair_history(accepted: DataFrame) -> DataFrame:
    """Distinct loop pairs ever accepted."""
    return accepted.select("map_id", "match_id", "query_id").dropDuplicates()


def by_id(df: DataFrame, ids: DataFrame, keys=("map_id", "kf_id")) -> DataFrame:
    """Look up rows by key; a missing key gives NULLs."""
    return ids.join(df, list(keys), "left")
