"""Importance resampling towards a target text collection by hashed word features.

An untrained pre-tokeniser, a regular-expression split over the lower-cased text, gives the words with
their offsets. Each window of one or two consecutive words is a feature, told by a pair of offsets; its
bytes' checksum picks a bucket. Histograms of the buckets over the whole corpus and over the whole target
give each bucket a gain, a text's weight is the mean gain of its features, and texts are drawn by weight
plus noise from a hash of the id: a global range sort, places counted per range.

Words are split once: the buckets of a text, two bytes each, are written and met again for the weights.
The only thing sent around is the histogram, one number per bucket.

Defined results: a null, empty or wordless text has no feature, weight 0 and a score of its noise; it is
never drawn; a null id draws its noise from ``seed:``; rows of one id are drawn each, in the order of
their number of features and weight; an empty corpus gives no rows; an empty target has all counts 0.
"""

import gc
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from lidarlake.llm.common import as_bytes, blocks, slices
from lidarlake.session import materialize

#: Words: ASCII digits and small letters and all characters beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, MOST_WORDS, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text whose windows are hashed at once.
SLICE = 1 << 18
#: Windows of more bytes leave the column-wise checksum and are summed one by one.
LONG = 48


def _checksum_table():
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _checksum_table()


def splitter(pattern=WORDS):
    """The pre-tokeniser: runs that match are words, all else is removed."""
    return pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


def word_offsets(split, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one byte offsets of the words of a lower-cased text (``data``: its bytes)."""
    found = split.pre_tokenize_str(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.array([o for _, o in found], np.int64)
    if len(text) != len(data):
        raw = np.frombuffer(data, np.uint8)
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))
        at = place[at]
    return at[:, 0], at[:, 1]


def extend(state: np.ndarray, data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Checksum states after the bytes from start to stop of each window."""
    raw, state, span = np.frombuffer(data, np.uint8), state.copy(), stop - start
    order = np.argsort(span, kind="stable")
    span = span[order]
    long = int(np.searchsorted(span, LONG, "right"))
    live, at = order[:long], start[order[:long]]
    for j in range(int(span[long - 1]) if long else 0):
        done = int(np.searchsorted(span[:long], j, "right"))
        rows = live[done:]
        state[rows] = _TABLE[(state[rows] ^ raw[at[done:] + j]) & 0xFF] ^ (state[rows] >> 8)
    for i in order[long:].tolist():
        state[i] = zlib.crc32(data[start[i] : stop[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def window_buckets(texts: list, split, n_buckets=BUCKETS, most=MOST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, text number of each feature, its bucket); ``texts``: bytes, lower-cased here."""
    lower = [t.lower() for t in texts]
    parts = [word_offsets(split, t.decode(), t) for t in lower]
    many = np.array([len(s) for s, _ in parts], np.int64)
    base = np.cumsum([0, *map(len, lower)])[:-1]
    data = b"".join(lower)
    start = np.concatenate([s + b for (s, _), b in zip(parts, base)] or [np.zeros(0, np.int64)])
    stop = np.concatenate([e + b for (_, e), b in zip(parts, base)] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(texts)), many)
    ends, owners, out = np.arange(len(owner)), [], []
    state = extend(np.full(len(owner), 0xFFFFFFFF, np.uint32), data, start, stop)
    for k in range(most):
        if k:
            # Windows grow by a space and the next word of the same text.
            inside = ends + 1 < len(owner)
            inside[inside] = owner[ends[inside] + 1] == owner[ends[inside]]
            state, ends = state[inside], ends[inside] + 1
            state = _TABLE[(state ^ 0x20) & 0xFF] ^ (state >> 8)
            state = extend(state, data, start[ends], stop[ends])
        owners.append(owner[ends])
        out.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(n_buckets))
    return many, np.concatenate(owners), np.concatenate(out).astype(np.uint16)


def _long_text(text: bytes, split, n_buckets, most):
    """Words and buckets of one text, block by block; windows over a seam are built from the words before it."""
    words, out, tail = 0, [], b""
    for block in blocks(text.decode()):
        # The last words of the block before come first again, and what they alone give is left out.
        n, _, b = window_buckets([tail + b" " + block.encode()], split, n_buckets, most)
        known, _, again = window_buckets([tail], split, n_buckets, most)
        if len(again):
            counts = np.bincount(b, minlength=n_buckets) - np.bincount(again, minlength=n_buckets)
            b = np.repeat(np.arange(n_buckets, dtype=np.uint16), counts)
        words += int(n[0] - known[0])
        out.append(b)
        start, _ = word_offsets(split, (lower := (tail + b" " + block.encode()).lower()).decode(), lower)
        keep = most - 1
        tail = lower[start[-keep] :] if keep and len(start) >= keep else lower if keep else b""
    return words, np.concatenate(out)


def feature_buckets(rows: DataFrame, n_buckets=BUCKETS, most=MOST_WORDS, pattern=WORDS) -> DataFrame:
    """Written rows (id, n_words, n_features, buckets) of a table (id, text); two bytes per feature, in any order."""
    if n_buckets > 1 << 16:
        raise ValueError("a bucket takes two bytes: at most 65,536 buckets")

    def run(batches):
        split = splitter(pattern)
        gc.disable()  # the split makes a tuple per word, which collections would walk again and again
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = as_bytes(part.column("text"))
                if len(texts) == 1 and len(texts[0]) > SLICE:
                    n, b = _long_text(texts[0], split, n_buckets, most)
                    many, found = [n], [b.tobytes()]
                else:
                    many, owner, b = window_buckets(texts, split, n_buckets, most)
                    order = np.argsort(owner, kind="stable")
                    cut = np.searchsorted(owner[order], np.arange(len(texts) + 1)) * 2
                    data = b[order].tobytes()
                    found = [data[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(many, pa.int64()), pa.array([len(f) // 2 for f in found], pa.int64()), pa.array(found, pa.binary())],
                    ["id", "n_words", "n_features", "buckets"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, buckets binary"))


def histogram(features: DataFrame, n_buckets=BUCKETS) -> np.ndarray:
    """Number of features in each bucket: one partial histogram per task, added up."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint16), minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    found = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in found.collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of target to corpus frequency of each bucket, smoothed by one, in thousandths."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratios = ((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)) for a, b in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight: the floored mean of the gains of a row's features."""

    def run(batches):
        for batch in batches:
            mean = []
            for b in batch.column("buckets"):
                b = np.frombuffer(b.as_buffer(), np.uint16)
                mean.append(int(gains[b].sum()) // len(b) if len(b) else 0)
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("id", "n_words", "n_features")), pa.array(mean, pa.int64())], ["id", "n_words", "n_features", "weight"])

    kind = features.schema["id"].dataType.simpleString()
    return features.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col, seed=SEED):
    """Gumbel noise in thousandths from a hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def draw(scored: DataFrame, least=LEAST_WORDS, percent=PERCENT) -> DataFrame:
    """Add rank to (id, n_words, n_features, weight, score): the best ``percent`` of the rows with enough words."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "weight", "row_id"]
    scored = materialize(scored.withColumn("row_id", F.monotonically_increasing_id()))
    open_rows = scored.where(F.col("n_words") >= least)
    wanted = open_rows.count() * percent // 100
    spread = materialize(open_rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    sums = sums.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead")).where(F.col("ahead") < wanted)
    inside = Window.partitionBy("part").orderBy(*order)
    placed = spread.join(sums, "part").withColumn("rank", (F.row_number().over(inside) + F.col("ahead")).cast("long"))
    drawn = placed.where(F.col("rank") <= wanted).select("row_id", "rank")
    return scored.join(drawn, "row_id", "left").drop("row_id")


def resample(df: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_col="text", n_buckets=BUCKETS,
             most=MOST_WORDS, seed=SEED, least=LEAST_WORDS, percent=PERCENT) -> DataFrame:
    """Per row of ``df``: the id, n_features, weight, score and rank (null where not drawn)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.lit(0).alias("id"), F.col(target_col).cast("string").alias("text"))
    features = feature_buckets(rows, n_buckets, most)
    aim = feature_buckets(wanted, n_buckets, most)
    gains = bucket_gains(histogram(features, n_buckets), histogram(aim, n_buckets))
    scored = weights(features, gains).withColumn("score", F.col("weight") + noise("id", seed))
    drawn = draw(scored, least, percent)
    return drawn.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
