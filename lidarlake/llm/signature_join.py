"""Near-duplicate groups by an inverted join on the coordinates of MinHash signatures.

A set of word shingles has a signature of 64 coordinates, each the least of one hash over the set. Two
sets agree in a coordinate with the chance of their similarity, so pairs from 0.85 on agree in 54 of 64
on average and in fewer than MATCHES = 36 about once in 10^8. Sets are posted under their (coordinate,
value) pairs, counted over all sets first. Prefix: a pair with 36 agreements shares one of the
64 - 36 + 1 rarest coordinates of both, so only these are posted, and a set with fewer than 36
coordinates that any other set shares is never posted. Skip: long lists are not merged for
the rest of the count; the two signatures are compared instead, and pairs with 36 or more are confirmed
on their whole sets.

Equal sets are one class from the start, and no posting list is paired with itself as a whole. Members
meet the hub of their list first, the set whose coordinates are the commonest (in a group of edited copies
the one they come from), and are linked to it or not. Then lists that still hold different components are
paired, but only pairs that three exact bounds leave open: sizes, the shingles no other posted set holds,
and what both lack of a common hub; a pair is made in its first common list only. So pairs grow with the
copies that are like several others but not like the hub, not with the square of a group.

Defined results: a null, empty or wordless text has no shingle and is linked with nothing; fewer than
``width`` words are one shingle; rows of one doc_id are one document with all their links; rows with a null
doc_id are one document after all others (component null, kept); an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import as_bytes, fixed_binary, slices
from lidarlake.llm.components import components
from lidarlake.llm.jaccard_join import mixed, shingle_sets
from lidarlake.session import materialize

COORDINATES, MATCHES = 64, 36
#: Shingles hashed at once for all coordinates.
CHUNK = 1 << 13
_LAST = (1 << 63) - 1


def _numbers(n, seed):
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_FLIP, _TIMES = _numbers(COORDINATES, 1), _numbers(COORDINATES, 2) | np.uint64(1)
_PLACE = _numbers(COORDINATES, 3)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set (not empty), 32 bits each."""
    least = np.full(COORDINATES, np.uint64(_LAST) * np.uint64(2) + np.uint64(1))
    for i in range(0, len(hashes), CHUNK):
        values = (hashes[None, i : i + CHUNK] ^ _FLIP[:, None]) * _TIMES[:, None]
        least = np.minimum(least, values.min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def coordinate_pairs(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per (coordinate, value) of rows of signatures."""
    return mixed(signatures.astype(np.uint64) ^ _PLACE[None, :])


def set_rows(df: DataFrame, id_col="doc_id", text_col="text", width=5) -> DataFrame:
    """Written rows (doc, n, node, sig): set size, a 128-bit hash of the set, its signature; null without shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(as_bytes(part.column("text")), width)
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary())],
                    ["doc", "n", "node", "sig"],
                )

    return materialize(_texts(df, id_col, text_col).mapInArrow(run, "doc long, n long, node binary, sig binary"))


def _texts(df, id_col, text_col):
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc")
    return df.select(doc, F.col(text_col).cast("string").alias("text"))


def _keys(classes: DataFrame) -> DataFrame:
    """Rows (key, node) of all coordinates of all classes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                signs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                rows = np.repeat(np.arange(len(signs)), COORDINATES)
                keys = coordinate_pairs(signs).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("node").take(pa.array(rows))], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node binary")


def prefixes(classes: DataFrame, matches=MATCHES) -> DataFrame:
    """Written rows (node, rep, n, prefix, weight) of the classes with enough shared coordinates.

    prefix: the rarest shared coordinates, on which any pair with ``matches`` agreements meets; weight:
    how common the class's coordinates are.
    """
    keys = _keys(classes)
    counts = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    shared = keys.join(counts, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("shared"))
    shared = shared.where(F.size("shared") >= matches)
    weight = F.aggregate("shared", F.lit(0.0), lambda a, x: a + F.log2(x["c"]))
    # Coordinates of its own come before all these in the order of rarity.
    prefix = F.slice("shared", F.lit(1), F.size("shared") - matches + 1)["key"]
    rows = shared.select("node", prefix.alias("prefix"), weight.alias("weight")).join(classes.select("node", "rep", "n"), "node")
    return materialize(rows)


def prepared_sets(texts: DataFrame, chosen: DataFrame, width=5) -> DataFrame:
    """Written rows (node, hashes) with the sorted shingle hashes of the chosen classes (node, rep)."""
    rows = texts.join(chosen.select(F.col("rep").alias("doc"), F.col("node").alias("wanted")), "doc")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(as_bytes(part.column("text")), width)
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), part.column("wanted"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "wanted", "hashes"]
                )

    # A doc_id with several texts meets each of its classes; a class keeps the text that is its own.
    found = rows.mapInArrow(run, "node binary, wanted binary, hashes binary").where("node = wanted")
    return materialize(found.select("node", "hashes"))


def own_shingles(prepared: DataFrame) -> DataFrame:
    """Rows (node, own): the number of shingles that no other prepared set holds, at most."""

    def run(batches):
        for batch in batches:
            for node, raw in zip(batch.column("node"), batch.column("hashes")):
                hashes = np.frombuffer(raw.as_buffer(), np.int64)
                for i in range(0, len(hashes), CHUNK):
                    part = hashes[i : i + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(part), fixed_binary(node.as_py() * len(part), 16)], ["shingle", "node"])

    single = prepared.mapInArrow(run, "shingle long, node binary").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    return single.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def may_link(n, free, m, open_m, percent):
    """Whether sets of n and m shingles, of which free and open_m may be common, can reach the similarity."""
    return F.least(free, open_m) * (100 + percent) >= (n + m) * percent


def agreeing(pairs: DataFrame, classes: DataFrame, matches=MATCHES) -> DataFrame:
    """The pairs (x, y) whose signatures agree in at least ``matches`` coordinates."""
    rows = pairs.join(classes.select(F.col("node").alias("x"), F.col("sig").alias("a")), "x")
    rows = rows.join(classes.select(F.col("node").alias("y"), F.col("sig").alias("b")), "y")

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("a", "b"))
            yield batch.select(["x", "y"]).filter(pa.array((a == b).sum(1) >= matches))

    return rows.select("x", "y", "a", "b").mapInArrow(run, "x binary, y binary")


def intersections(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Rows (x, y, n, m, common) of pairs of classes, on their whole sets."""
    rows = pairs.join(prepared.select(F.col("node").alias("x"), F.col("hashes").alias("a")), "x")
    rows = rows.join(prepared.select(F.col("node").alias("y"), F.col("hashes").alias("b")), "y")

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                out.append((len(a), len(b), int(np.count_nonzero(both[1:] == both[:-1]))))
            sizes = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *sizes], ["x", "y", "n", "m", "common"])

    return rows.select("x", "y", "a", "b").mapInArrow(run, "x binary, y binary, n long, m long, common long")


def similar(percent):
    return 100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))


def class_links(texts: DataFrame, classes: DataFrame, width=5, percent=85, matches=MATCHES) -> DataFrame:
    """Written links (a, b) between classes (node, rep, n, sig); every linked pair is joined by a path of them."""
    chosen = prefixes(classes, matches)
    prepared = prepared_sets(texts, chosen, width)
    live = chosen.join(own_shingles(prepared), "node", "left")
    live = live.withColumn("free", F.col("n") - F.coalesce("own", F.lit(0)))
    least = F.ceil(F.col("n") * percent / 100)
    live = materialize(live.where(may_link(F.col("n"), F.col("free"), least, F.col("free"), percent)).select("node", "n", "free", "prefix", "weight"))
    posts = live.select(F.explode("prefix").alias("key"), "node", "weight")
    heads = posts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("weight", "node")).alias("hub")).where("c > 1")
    met = posts.join(heads.select("key", "hub"), "key").where("node <> hub.node").select(F.col("node").alias("x"), F.col("hub.node").alias("y"), F.col("hub.weight").alias("weight")).distinct()
    met = materialize(met)
    kept = classes.join(live.select("node"), "node", "left_semi")
    first = materialize(intersections(agreeing(met.select("x", "y"), kept, matches), prepared))
    links = materialize(first.where(similar(percent)).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Each class's pivot: its commonest hub, and how much of that it lacks.
    pivots = first.join(met, ["x", "y"]).select("x", F.struct("weight", "y").alias("hub"), (F.col("m") - F.col("common")).alias("lacks"))
    selves = met.select(F.col("y").alias("x"), F.struct("weight", "y").alias("hub"), F.lit(0).cast("long").alias("lacks")).distinct()
    pivots = pivots.union(selves).groupBy("x").agg(F.max(F.struct("hub", "lacks")).alias("p"))
    pivots = pivots.select(F.col("x").alias("node"), F.col("p.hub.y").alias("pivot"), F.col("p.lacks").alias("lacks"))
    return materialize(links.union(_rest(live, links, pivots, kept, prepared, percent, matches)))


def _rest(live, links, pivots, kept, prepared, percent, matches):
    """Links between classes that share a list and are in different components after the hubs."""
    parts = components(links)
    state = live.join(pivots, "node", "left").join(parts.select("node", F.col("component").alias("part")), "node", "left")
    state = state.select("node", "n", "free", "prefix", "pivot", "lacks", F.coalesce("part", "node").alias("part"))
    rows = materialize(state.select(F.explode("prefix").alias("key"), "*"))
    mixed_lists = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    rows = materialize(rows.join(mixed_lists.select("key"), "key", "left_semi"))
    x, y = (rows.select("key", *[F.col(c).alias(c + side) for c in rows.columns if c != "key"]) for side in ("_x", "_y"))
    common = F.coalesce(F.col("pivot_x") == F.col("pivot_y"), F.lit(False))
    # What one lacks of the common hub beyond what the other lacks is only in the other.
    more = F.when(common, F.col("lacks_y") - F.col("lacks_x")).otherwise(F.lit(0))
    free_x = F.col("free_x") - F.greatest(more, F.lit(0))
    free_y = F.col("free_y") - F.greatest(-more, F.lit(0))
    once = F.array_min(F.array_intersect("prefix_x", "prefix_y")) == F.col("key_y")
    y = y.withColumnRenamed("key", "key_y")
    on = (F.col("key") == F.col("key_y")) & (F.col("node_x") < F.col("node_y")) & (F.col("part_x") != F.col("part_y"))
    left = x.join(y, on & may_link(F.col("n_x"), free_x, F.col("n_y"), free_y, percent) & once)
    left = left.select(F.col("node_x").alias("x"), F.col("node_y").alias("y"))
    found = intersections(agreeing(left, kept, matches), prepared)
    return found.where(similar(percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", width=5, percent=85, matches=MATCHES) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (least id reachable by links) and kept."""
    sets = set_rows(df, id_col, text_col, width)
    full = sets.where("n > 0")
    classes = materialize(full.groupBy("node").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    links = class_links(_texts(df, id_col, text_col), classes, width, percent, matches)
    # The texts of one doc_id belong together.
    homes = full.groupBy("doc").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc", "low")
    links = links.union(full.join(homes, "doc").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    parts = components(links)
    placed = classes.select("node", "rep").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    names = placed.groupBy("part").agg(F.min("rep").alias("found"))
    named = placed.select("node", "part").join(names, "part").select("node", "found")
    docs = full.select("doc", "node").join(named, "node").groupBy("doc").agg(F.min("found").alias("found"))
    out = sets.select("doc", "n").join(docs, "doc", "left").withColumn("found", F.coalesce("found", "doc"))
    ids = [F.when(F.col(c) < _LAST, F.col(c)) for c in ("doc", "found")]
    return out.select(ids[0].alias(id_col), F.col("n").alias("n_shingles"), ids[1].alias("component_id"), (F.col("doc") == F.col("found")).alias("kept"))
