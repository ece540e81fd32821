"""Exact Jaccard join of word shingle sets by parity sketches.

A document's sketch is a row of 64-bit words: each distinct shingle falls into one word by its hash and
is XORed into it. Every shingle that only one of two documents has changes one word, so the number of
words in which two sketches differ is at most the size of the symmetric difference. Two sets of sizes a
and b that reach the similarity differ in at most D = (a + b)(1 - t) / (1 + t) shingles; of any D + 1
non-empty words of one document at least one is a word of the other. Documents meet per size band (a
power of two and its lower neighbours) on D + 1 of their words, chosen in one global order: first words
that hold a shingle not known to be common, then words of many shingles, since they say most. Common
shingles are counted over all documents, block by block, and summed; the list only shapes the order,
so its bounded length costs speed at most, never a link. Should a set fill no more than D words, all
documents of its band also meet on the smallest shingle hashes of their prefix.

Equal sets are one class from the start. The shingles that no other class holds are counted for each
class, so what two sets can have in common is bounded by what either may share; a class that has not enough
left for the similarity with any set takes no part. Members of a word meet one of them, the hub, a set meets a
few hubs; candidates that dense parity sketches of a few bits per shingle do not rule out are compared on whole texts,
linked ones are joined to components. What sets lack of a common hub bounds what they share. Members of different components that still share a word meet new
hubs while that joins components, then each other. So a group of copies, of any size, needs
about one comparison per member, and no link between components is lost.

Defined results: a null text or one without words has no shingle and is linked with nothing; fewer than
``width`` words are one shingle; rows with one doc_id are one document with all their links; rows with
a null doc_id are one document after all others (component null); an empty table gives no rows.
Shingles are compared by 64-bit hashes, sets by 128-bit hashes.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import as_bytes, fixed_binary, slices
from lidarlake.llm.components import components
from lidarlake.session import materialize

#: Mean number of shingles per sketch word for the largest sets of a band.
FILL = 2.2
#: Bands of sets up to this size get sparse sketches.
SMALL = 32
#: Hubs that a set meets at most in one turn, and more turns before all pairs left are compared.
HUBS, MOST_TURNS = 4, 3
#: Words of a set up to which a pair is made on its least common word only; pairs of larger sets are made distinct.
LISTED = 64
#: Members compared with one other document in one group.
GROUP = 500
#: A shingle counts as common in a block of documents from so many sets on; so many of them are kept.
COMMON, MOST_COMMON = 2, 400_000
#: Bytes of text of such a block.
COMMON_BLOCK = 2 << 20
#: Shingles of one bucket when their holders are counted.
BUCKET = 1_000_000
#: Rows (of 40 bytes) of a table of pairs that is broadcast at most.
MOST_SENT = 100_000
_LAST = (1 << 63) - 1
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _M1)]))


# One random number per byte value; a word's hash is their sum times powers of an odd number.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _M3)
_LOW, _PAGE = _powers(1 << 16), 16


def _word_hashes(data: np.ndarray):
    """(hash, first byte) of each word of a buffer of lower-case text."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first = np.flatnonzero(first)
    if not len(first):
        return np.zeros(0, np.uint64), first
    start = first[0]
    span = np.diff(np.append(first, len(data)))
    place = np.arange(start, len(data)) - np.repeat(first, span)
    value = _BYTES[data[start:]] * word[start:]
    value *= _LOW[place & ((1 << _PAGE) - 1)]
    if span.max() > 1 << _PAGE:
        value *= _powers_of(int(span.max() >> _PAGE) + 1)[place >> _PAGE]
    return mixed(np.add.reduceat(value, first - start)), first


def _powers_of(n):
    """Powers of the multiplier of a whole page."""
    step = _LOW[-1] * _M1
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, step)]))


def shingle_sets(texts: list, width=5) -> list:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    h, first = _word_hashes(np.frombuffer(b"\n".join(texts).lower(), np.uint8))
    at = np.searchsorted(first, np.append(begin, size.sum()))
    whole = max(0, len(h) - width + 1)
    runs = np.full(whole, width, np.uint64)
    for j in range(width):
        runs = runs * _M1 + h[j : j + whole]
    runs = mixed(runs)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i >= width:
            s = np.sort(runs[i : j - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif j > i:
            one = np.uint64([j - i])
            for k in range(i, j):
                one = one * _M1 + h[k]
            out.append(mixed(one))
        else:
            out.append(h[:0])
    return out


def shingle_set(text: bytes, width=5) -> np.ndarray:
    return shingle_sets([text], width)[0]


def band(n: int) -> int:
    return int(n).bit_length() - 1


def bands(n: int, percent: int):
    """Size bands a set of n shingles meets others in, with the largest partner size in each."""
    most = n * 100 // percent
    k = band(n)
    while True:
        yield k, min(most, (2 << k) - 1)
        k += 1
        if (1 << k) > most:
            return


def sketch(hashes: np.ndarray, k: int, fill: float):
    """(words, shingle counts, positions, first shingles) of the non-empty sketch words in band k."""
    top = 2 << k
    size = top * 64 if top <= SMALL else int(top / fill) + 1
    at = ((hashes >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    # Hashes are sorted, so their positions are too.
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    words = np.bitwise_xor.reduceat(hashes, first)
    return words, np.diff(np.append(first, len(hashes))), at[first], first


def commonness(hashes: np.ndarray, common: tuple) -> np.ndarray:
    """0 for a shingle that is not in the list (sorted hashes, levels), else its level."""
    known, level = common
    if not len(known):
        return np.zeros(len(hashes), np.uint8)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, level[at], 0).astype(np.uint8)


NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def signatures(hashes: np.ndarray, percent: int, fill=FILL, lost_bands=(), common=NOTHING) -> np.ndarray:
    """Keys on which a set meets all sets that may be similar."""
    n, out = len(hashes), []
    level = commonness(hashes, common)
    for k, most in bands(n, percent):
        differ = (n + most) * (100 - percent) // (100 + percent)
        words, counts, at, first = sketch(hashes, k, fill)
        keys = mixed(words ^ mixed(at * _M1 + np.uint64(k)))
        if len(keys) > differ + 1:
            # The least common shingle of a word, then the number of its shingles, then the key.
            order = np.minimum.reduceat(level, first).astype(np.uint64) << np.uint64(58)
            order |= (255 - np.minimum(counts, 255)).astype(np.uint64) << np.uint64(50) | keys >> np.uint64(14)
            keys = keys[np.argpartition(order, differ)[: differ + 1]]
        out.append(keys)
        if k in lost_bands:
            need = -(-n * percent // 100)
            out.append(mixed(hashes[: n - need + 1] ^ mixed(np.uint64([k + 1000]))))
    return np.concatenate(out)


def short_bands(hashes: np.ndarray, percent: int, fill=FILL) -> list:
    """Bands in which a set fills too few sketch words for its D."""
    n, out = len(hashes), []
    for k, most in bands(n, percent):
        differ = (n + most) * (100 - percent) // (100 + percent)
        if len(sketch(hashes, k, fill)[0]) <= differ:
            out.append(k)
    return out


def parity_bits(hashes: np.ndarray) -> bytes:
    """Dense parity sketch: each shingle toggles one of about two to four bits per shingle."""
    size = max(64, 4 << band(max(1, len(hashes))))
    flips = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits in which two dense sketches differ, at most the size of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    # Sizes are powers of two and positions the low bits of a hash: a longer sketch folds onto a shorter.
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def shingle_classes(df: DataFrame, id_col="doc_id", text_col="text", width=5, percent=75, fill=FILL) -> DataFrame:
    """Written narrow table, a row per document.

    doc, n (set size), cls (hash of the set), short (bands it fills too few words in), bits (dense
    sketch), and on one row of each block of documents shared and times: the shingles that several
    sets of the block hold, and how many.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", COMMON_BLOCK):
                sets = shingle_sets(as_bytes(part.column("text")), width)
                short = [short_bands(s, percent, fill) if len(s) else [] for s in sets]
                shared, times = np.unique(np.concatenate(list({s.tobytes(): s for s in sets}.values())), return_counts=True)
                often = times >= COMMON
                rest = [[]] * (len(sets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                        fixed_binary(b"".join(map(_class_of, sets)), 16), pa.array(short, pa.list_(pa.int32())),
                        pa.array(map(parity_bits, sets), pa.binary()),
                        pa.array([shared[often].view(np.int64), *rest], pa.list_(pa.int64())),
                        pa.array([times[often], *rest], pa.list_(pa.int64())),
                    ],
                    ["doc", "n", "cls", "short", "bits", "shared", "times"],
                )

    ddl = "doc long, n long, cls binary, short array<int>, bits binary, shared array<long>, times array<long>"
    return materialize(_rows(df, id_col, text_col).mapInArrow(run, ddl))


def _class_of(s):
    return xxhash.xxh3_128_digest(s.tobytes())


def _rows(df, id_col, text_col):
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc")
    return df.select(doc, F.col(text_col).cast("string").alias("text"))


def common_shingles(sets: DataFrame, most=MOST_COMMON) -> tuple:
    """(sorted hashes, levels 1 to 62 by the logarithm of their count) of the ``most`` common shingles."""
    pairs = sets.where(F.size("shared") > 0).select(F.explode(F.arrays_zip("shared", "times")).alias("p"))
    counts = pairs.groupBy(F.col("p.shared").alias("h")).agg(F.sum("p.times").alias("c"))
    found = counts.orderBy(F.col("c").desc(), "h").limit(most).toPandas()
    h, level = found["h"].to_numpy(np.int64).view(np.uint64), np.log2(found["c"].to_numpy(float).clip(1))
    order = np.argsort(h)
    return h[order], np.clip(level[order].astype(np.uint8), 1, 62)


def own_shingles(rows: DataFrame, classes: DataFrame, width=5, common=NOTHING) -> DataFrame:
    """Rows (node, own): the number of shingles of a set that no other set holds, at most.

    Shingles go in packs, five bytes each, to buckets of a part of the hash range. Common shingles are held
    by several sets as they are listed, so they stay where they are.
    """
    buckets = 1 + (classes.agg(F.sum("n")).first()[0] or 0) // BUCKET

    def packs(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text", COMMON_BLOCK):
                sets = _new_sets(part, width, seen)
                if not sets:
                    continue
                h, who = np.concatenate([t[1] for t in sets]), np.repeat(np.arange(len(sets)), [len(t[1]) for t in sets])
                rare = commonness(h, common) == 0
                h, who = h[rare], who[rare]
                bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, who, bucket = h[order], who[order], bucket[order]
                # Runs of one set in one bucket, packs of one bucket.
                run = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])])[: len(h)])
                pack = np.flatnonzero(np.concatenate([[True], bucket[run][1:] != bucket[run][:-1]])[: len(run)])
                nodes = np.array([t[0] for t in sets], np.int64)[who[run]]
                sizes = np.diff(np.append(run, len(h))).astype(np.uint32)
                rest = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5])
                ends, marks = np.append(pack, len(run)), np.append(run[pack], len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[run[pack]]), _cut(nodes, ends * 8), _cut(sizes, ends * 4), _cut(rest, marks * 5)],
                    ["bucket", "nodes", "sizes", "rest"],
                )

    def count(batches):
        now, hashes, nodes, many = None, [], [], 0
        for batch in batches:
            for bucket, who, sizes, rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "nodes", "sizes", "rest"))):
                if bucket != now and hashes:
                    yield _owners(*_two_holders(hashes, nodes))
                    hashes, nodes, many = [], [], 0
                now, wide = bucket, np.zeros((len(rest) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(rest, np.uint8).reshape(-1, 5)
                hashes.append(wide.view(np.uint64).ravel())
                nodes.append(np.repeat(np.frombuffer(who, np.int64), np.frombuffer(sizes, np.uint32)))
                many += len(wide)
                if many > 4 * BUCKET:
                    h, w = _two_holders(hashes, nodes)
                    hashes, nodes, many = [h], [w], 0
        if hashes:
            yield _owners(*_two_holders(hashes, nodes))

    packed = rows.mapInArrow(packs, "bucket long, nodes binary, sizes binary, rest binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "node long, own long").groupBy("node").agg(F.sum("own").alias("own"))


def _new_sets(part, width, seen):
    """(node, set) of each set of a batch that this task did not have before."""
    out = []
    for s in shingle_sets(as_bytes(part.column("text")), width):
        node = int.from_bytes(_class_of(s)[:8], "little", signed=True)
        if not len(s) or node in seen:
            continue
        if len(seen) > 1_000_000:
            seen.clear()
        seen.add(node)
        out.append((node, s))
    return out


def _cut(values, ends):
    """A binary array of the bytes of ``values`` between the given ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _two_holders(hashes, nodes):
    """Each hash with its least and its greatest holder, or its only one."""
    h, w = np.concatenate(hashes), np.concatenate(nodes)
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    apart = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    h, w = h[apart], w[apart]
    change = h[1:] != h[:-1]
    keep = np.concatenate([[True], change]) | np.concatenate([change, [True]])
    return h[keep], w[keep]


def _owners(h, w):
    """Rows (node, own) of the hashes that have one holder."""
    change = h[1:] != h[:-1]
    single = np.concatenate([[True], change]) & np.concatenate([change, [True]])
    nodes, own = np.unique(w[single], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(own, pa.int64())], ["node", "own"])


def live_classes(classes: DataFrame, own: DataFrame, percent=75) -> DataFrame:
    """Written rows (doc, wanted, free) of the classes that can be linked at all.

    free: how many shingles some other set may hold. A class links only if these are enough for the
    similarity with a set that has no others.
    """
    nodes = classes.groupBy("node").agg(F.collect_set("rep").alias("reps"), F.max("n").alias("n"))
    # Of different sets with one node nothing is known.
    alone = F.when(F.size("reps") == 1, F.col("own"))
    live = nodes.join(own, "node", "left").withColumn("free", F.col("n") - F.coalesce(alone, F.lit(0)))
    live = live.where(F.col("free") * 100 >= F.col("n") * percent)
    return materialize(live.select(F.explode("reps").alias("doc"), F.col("node").alias("wanted"), "free"))


def _live_words(rows, sets, classes, lost, width, percent, fill):
    """Written candidate words of the classes that can be linked."""
    common = common_shingles(sets)
    live = live_classes(classes, own_shingles(rows, classes, width, common), percent)
    # A few classes go to the texts; beyond the limit both are shuffled.
    small = live.count() <= MOST_SENT
    chosen = rows.join(F.broadcast(live) if small else live, "doc")
    return materialize(candidate_words(chosen, width, percent, fill, lost, common))


def candidate_words(rows: DataFrame, width=5, percent=75, fill=FILL, lost_bands=(), common=NOTHING) -> DataFrame:
    """Distinct rows (word, node, n, free) of the sketch words that sets meet on.

    ``rows``: (doc, text, wanted, free), a text of each class; a text that is not of the wanted node is left out.
    A node is the first half of a set's hash.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, size, nodes, free = [np.zeros(0, np.uint64)], [0], [0], [0]
                asked = zip(part.column("wanted").to_pylist(), part.column("free").to_pylist())
                for s, (wanted, shared) in zip(shingle_sets(as_bytes(part.column("text")), width), asked):
                    node = int.from_bytes(_class_of(s)[:8], "little", signed=True)
                    if not len(s) or node != wanted:
                        continue
                    keys.append(signatures(s, percent, fill, lost_bands, common))
                    size.append(len(s))
                    nodes.append(node)
                    free.append(shared)
                many = [len(k) for k in keys]
                arrays = [np.concatenate(keys).view(np.int64), *(np.repeat(np.array(v, np.int64), many) for v in (nodes, size, free))]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["word", "node", "n", "free"])

    return rows.mapInArrow(run, "word long, node long, n long, free long").distinct()


def _node(cls):
    """The node of a set hash, as candidate_words has it."""
    little = F.concat(*[F.substring(F.hex(cls), 2 * i + 1, 2) for i in range(7, -1, -1)])
    high, low = F.conv(F.substring(little, 1, 8), 16, 10).cast("long"), F.conv(F.substring(little, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def close_pairs(pairs: DataFrame, classes: DataFrame, percent=75) -> DataFrame:
    """Pairs of nodes (x, y) as pairs of documents (a, b) whose dense sketches do not rule them out."""
    side = classes.select("node", "rep", "n", "bits")
    rows = pairs.join(side.toDF("x", "a", "na", "bits_a"), "x").join(side.toDF("y", "b", "nb", "bits_b"), "y")
    rows = rows.where("a <> b")

    def run(batches):
        for batch in batches:
            n = [batch.column(c).to_pylist() for c in ("na", "nb")]
            bits = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b")]
            keep = [
                parity_distance(x, y) * (100 + percent) <= (a + b) * (100 - percent)
                for a, b, x, y in zip(*n, *bits)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = rows.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fits(n, free, m, free_m, percent):
    """Whether sets of n and m shingles can be similar, of which no more than free and free_m are in other sets."""
    return F.least(free, free_m) * (100 + percent) >= (n + m) * percent


def linked_pairs(rows: DataFrame, pairs: DataFrame, width=5, percent=75) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity."""
    found = compared_pairs(rows, pairs, width)
    similar = F.col("common") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("common")) * percent
    return found.where(similar).select("a", "b").distinct()


def compared_pairs(rows: DataFrame, pairs: DataFrame, width=5) -> DataFrame:
    """Rows (a, b, size_a, size_b, common) of pairs of documents; each text travels once per group of its pairs."""
    groups = pairs.groupBy("a").count().select("a", (F.col("count") / GROUP).cast("int").alias("chunks"))
    members = pairs.join(groups, "a").withColumn("chunk", F.abs(F.hash("b")) % (F.col("chunks") + 1))
    members = members.select(F.col("b").alias("doc"), F.col("a").alias("hub"), "chunk", F.lit(1).alias("role"))
    heads = groups.select(F.col("a").alias("doc"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), "chunks")).alias("chunk"))
    wanted = materialize(members.union(heads.withColumn("role", F.lit(0))))
    # Few pairs go to the texts; beyond the limit texts and pairs are shuffled.
    small = wanted.count() <= MOST_SENT
    texts = rows.join(F.broadcast(wanted) if small else wanted, "doc").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")

    names = ["a", "b", "size_a", "size_b", "common"]

    def run(batches):
        hub, heads = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                ids = zip(*(part.column(c).to_pylist() for c in ("hub", "chunk", "role", "doc")))
                for (h, c, role, doc), s in zip(ids, shingle_sets(as_bytes(part.column("text")), width)):
                    if (h, c) != hub:
                        hub, heads = (h, c), []
                    if role == 0:
                        heads.append(s)
                    else:
                        found += [(h, doc, len(t), len(s), _common(s, t)) for t in heads if len(s) and len(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], names)

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _common(s, t):
    both = np.concatenate([s, t])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _with_hub(words, turn):
    """Each word's hub; words of one member are left out.

    First the member with the least share of shingles of its own, in a group of edited copies the one
    they come from or the nearest to it; in later turns the one of least hash, another in each.
    """
    order = (1 - F.col("free") / F.col("n") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")).alias("order")
    hubs = words.groupBy("word").agg(F.min(F.struct(order, "node", "n", "free", "part")).alias("hub"), F.count(F.lit(1)).alias("members"))
    return words.join(hubs.where("members > 1").select("word", "hub"), "word")


def _to_hub(words, percent):
    """Distinct pairs (x, y), x < y, of each node and its first few hubs not known to belong to it."""
    far = (F.col("part") != F.col("hub.part")) & _fits(F.col("n"), F.col("free"), F.col("hub.n"), F.col("hub.free"), percent)
    hubs = words.where(far).groupBy("node").agg(F.collect_set(F.struct("hub.order", "hub.node")).alias("hubs"))
    met = hubs.select("node", F.explode(F.slice(F.array_sort("hubs"), 1, HUBS)).alias("hub"))
    return met.select(F.least("node", "hub.node").alias("x"), F.greatest("node", "hub.node").alias("y")).distinct()


def _pivots(compared, words, classes, owners):
    """Rows (node, pivot, lacks): the hub with the least share of own shingles that a set was compared with, or
    the set itself, and how many shingles of it the set has not. Sets that a document id or a node does not
    name alone are left out."""
    twins = _twins(classes).select(F.col("x").alias("node"))
    known = words.select("node", (1 - F.col("free") / F.col("n")).alias("order")).distinct().join(twins, "node", "left_anti")
    sides = classes.select("rep", "node").join(owners.select(F.col("doc").alias("rep")), "rep", "left_anti")
    met = compared.join(sides.toDF("a", "x"), "a").join(sides.toDF("b", "y"), "b")
    rows = met.select(F.col("x").alias("node"), F.col("y").alias("pivot"), (F.col("size_b") - F.col("common")).alias("lacks"))
    rows = rows.union(met.select("y", "x", F.col("size_a") - F.col("common")))
    rows = rows.union(known.select("node", F.col("node").alias("pivot"), F.lit(0).cast("long")))
    rows = rows.join(known.withColumnRenamed("node", "pivot"), "pivot").join(twins, "node", "left_anti")
    best = rows.groupBy("node").agg(F.min(F.struct("order", "pivot", "lacks")).alias("p"))
    return best.select("node", "p.pivot", "p.lacks")


def similarity_links(df: DataFrame, id_col="doc_id", text_col="text", width=5, percent=75, fill=FILL) -> tuple[DataFrame, DataFrame]:
    """(links, members): all pairs (a, b) of different sets that reach the similarity, and a row (doc, rep) per document with a set.

    Equal sets are one class, named by its least document; each pair of classes is found once, whatever
    their component. Ids must be unique and not null.
    """
    sets, lost, classes = _classes(df, id_col, text_col, width, percent, fill)
    rows = _rows(df, id_col, text_col)
    words = _live_words(rows, sets, classes, lost, width, percent, fill)
    other = words.select("word", F.col("node").alias("y"), F.col("n").alias("m"), F.col("free").alias("free_m"))
    met = words.withColumnRenamed("node", "x").join(other, "word").where(F.col("x") < F.col("y"))
    met = met.where(_fits(F.col("n"), F.col("free"), F.col("m"), F.col("free_m"), percent)).select("x", "y").distinct()
    pairs = materialize(close_pairs(met.union(_twins(classes)), classes, percent))
    links = linked_pairs(rows, pairs, width, percent)
    return materialize(links), sets.where("n > 0").join(classes.select("cls", "rep"), "cls").select("doc", "rep")


def link_counts(df: DataFrame, id_col="doc_id", text_col="text", width=5, percent=75, fill=FILL) -> DataFrame:
    """One row per input row: the id and n_links, the number of other rows whose text reaches the similarity."""
    ids = df.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("given"), F.countDistinct(id_col).alias("apart")).first()
    own = df.select(F.col(id_col), F.col(text_col)).withColumn("_row", F.col(id_col).cast("long"))
    if not ids.n == ids.given == ids.apart:
        # Rows are told apart by a number of their own.
        own = materialize(own.withColumn("_row", F.monotonically_increasing_id()))
    links, members = similarity_links(own, "_row", text_col, width, percent, fill)
    members = materialize(members)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("members"))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    far = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("members").alias("far"))
    per = sizes.join(far.withColumnRenamed("a", "rep"), "rep", "left")
    per = per.select("rep", (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    counts = members.join(per, "rep").select(F.col("doc").alias("_row"), "n_links")
    out = own.select(id_col, "_row").join(counts, "_row", "left")
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(df, id_col, text_col, width, percent, fill):
    """(sets, bands with too few words, classes of equal sets)."""
    sets = shingle_classes(df, id_col, text_col, width, percent, fill)
    lost = [r[0] for r in sets.select(F.explode("short")).distinct().collect()]  # at most 64 values
    classes = sets.where("n > 0").groupBy("cls").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    return sets, lost, materialize(classes.withColumn("node", _node(F.col("cls"))))


def _twins(classes):
    """Different sets with one node, should there be any, are compared as well."""
    twins = classes.groupBy("node").agg(F.min("rep").alias("r"), F.max("rep").alias("s")).where("r < s").select("node")
    return twins.select(F.col("node").alias("x"), F.col("node").alias("y"))


def similarity_components(df: DataFrame, id_col="doc_id", text_col="text", width=5, percent=75, fill=FILL) -> DataFrame:
    """One row per input row: the id, n_shingles and component_id (least id reachable by links)."""
    sets, lost, classes = _classes(df, id_col, text_col, width, percent, fill)
    full = sets.where("n > 0")
    rows = _rows(df, id_col, text_col)
    words = _live_words(rows, sets, classes, lost, width, percent, fill)
    first = materialize(_to_hub(_with_hub(words.withColumn("part", F.col("node")), 0), percent))
    twins = _twins(classes)
    # Rows of one doc_id with different texts belong together.
    placed = full.join(classes.select("cls", "rep"), "cls")
    owners = placed.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc", "a")
    links = placed.join(owners, "doc").select("a", F.col("rep").alias("b")).where("a <> b")
    named = classes.select("node", "rep")
    sent = first.union(twins).join(named.toDF("x", "a"), "x").join(named.toDF("y", "b"), "y").where("a <> b")
    sent = sent.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    compared = materialize(compared_pairs(rows, materialize(sent), width))
    pivots = materialize(_pivots(compared, words, classes, owners))
    similar = F.col("common") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("common")) * percent
    new = compared.where(similar).select("a", "b")
    seen, before, turn = first, None, 0
    while True:
        links = materialize(links.union(new).distinct())
        parts = components(links)
        # What still shares a word across components has to be compared as well.
        homes = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        homes = homes.select("node", F.coalesce("component", "rep").alias("part"))
        words = materialize(words.join(homes, "node"))
        apart = words.groupBy("word").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
        words = materialize(words.join(apart.select("word"), "word", "left_semi"))
        count, turn = words.count(), turn + 1
        if before is not None and count > 0.8 * before or turn > MOST_TURNS:
            break
        # A new hub for each word, as long as that joins components.
        pairs = _to_hub(_with_hub(words, turn), percent).join(seen, ["x", "y"], "left_anti")
        pairs, before = materialize(pairs), count
        if pairs.isEmpty():
            break
        new = linked_pairs(rows, close_pairs(pairs, classes, percent), width, percent)
        seen, words = seen.union(pairs), words.drop("part")
    # Now every pair that is left, whatever its number. What one set lacks of a common pivot beyond what the other
    # lacks is only in the other; pairs with the pivot itself were compared before.
    few = words.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= LISTED).select("node")
    lists = words.join(few, "node", "left_semi").groupBy("node").agg(F.collect_set("word").alias("list"))
    words = materialize(words.join(pivots, "node", "left").join(lists, "node", "left"))
    names = {"list": "list_y", "node": "y", "n": "m", "free": "free_m", "part": "part_y", "pivot": "pivot_y", "lacks": "lacks_y"}
    left = words.withColumnRenamed("node", "x").join(words.withColumnsRenamed(names), "word").where("part <> part_y and x < y")
    more = F.when(F.col("pivot") == F.col("pivot_y"), F.col("lacks_y") - F.col("lacks")).otherwise(0)
    free_x, free_y = F.col("free") - F.greatest(more, F.lit(0)), F.col("free_m") - F.greatest(-more, F.lit(0))
    once = F.coalesce(F.array_min(F.array_intersect("list", "list_y")) == F.col("word"), F.lit(True))
    left = left.where(_fits(F.col("n"), free_x, F.col("m"), free_y, percent)).where(once).select("x", "y").distinct()
    left = materialize(close_pairs(left.join(seen, ["x", "y"], "left_anti"), classes, percent))
    if not left.isEmpty():
        links = materialize(links.union(linked_pairs(rows, left, width, percent)))
        parts = components(links)
    known = materialize(parts.distinct())
    out = sets.join(classes.select("cls", "rep"), "cls", "left")
    out = out.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc")))
    out = out.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.withColumn("found", F.coalesce("component", "rep"))
    ids = [F.when(F.col(c) < _LAST, F.col(c)) for c in ("doc", "found")]
    return out.select(ids[0].alias(id_col), F.col("n").alias("n_shingles"), ids[1].alias("component_id"))
