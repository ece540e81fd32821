"""Language identification by cross-parsing entropy.

Labelled text of each language is compiled to a suffix automaton. A text is parsed greedily against
each: a phrase is the longest match that starts where the phrase before it ended. Phrases times the
logarithm of the labelled length, per byte, estimates the cross entropy; the language with the least
wins. All blocks of all texts advance together, one byte per step, through one table of transitions.

The labelled sample is bounded: at most ``max_docs`` rows per language, ``max_chars`` characters of
each and ``max_total`` bytes in all. Predictions read whole texts, in blocks of BLOCK bytes in which
parsing starts anew.

Defined results: a null text or one without any letter is ``und`` with score 0; without labelled text
every row is ``und``; equal entropies go to the smaller language code; the score is one less the ratio
of the least to the second least entropy (1 for a single language); an empty table gives no rows;
columns of the input that bear the name of a result column are replaced.
"""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lidarlake.llm.common import slices

BLOCK = 512
MAX_LANGUAGES = 1000
UNKNOWN = "und"


def hold_out(id_col="doc_id"):
    """Whether a row belongs to the third that is kept out of learning."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_docs=40, max_chars=800, max_total=1 << 19) -> dict:
    """Language -> labelled text; rows are picked by a hash of the id among those not held out."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~hold_out(id_col))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_docs)
    picked = picked.limit(MAX_LANGUAGES * max_docs).collect()
    if len({r.lang for r in picked}) > MAX_LANGUAGES or len(picked) == MAX_LANGUAGES * max_docs:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = defaultdict(set)
    if picked:
        ids = [r.id for r in picked if r.id is not None]
        chosen = rows.where(F.col("id").isin(ids)) if ids else rows.limit(0)
        for r in chosen.select("lang", F.substring("text", 1, max_chars).alias("text")).distinct().limit(len(picked)).collect():
            found[r.lang].add(r.text)
    share = max_total // max(1, len(found))
    return {lang: "\n".join(sorted(found[lang]))[: share // 2] for lang in sorted(found)}


def normalise(text: str) -> bytes:
    """Lower case UTF-8 where every ASCII character other than a letter is a blank."""
    return text.lower().encode().translate(_LETTERS)


_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def suffix_automaton(data: bytes) -> list:
    """Transitions (byte -> state) of the states of the automaton of all substrings; state 0 is the start."""
    to, link, length, last = [{}], [-1], [0], 0
    for b in data:
        new = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and b not in to[p]:
            to[p][b] = new
            p = link[p]
        if p >= 0:
            q = to[p][b]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(b) == q:
                    to[p][b] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class CrossParser:
    """Automata of all languages in one table: entry = 2 * next place + whether a new phrase starts."""

    def __init__(self, sample: dict):
        texts = {lang: _squeeze(normalise(t)) for lang, t in sample.items()}
        texts = {lang: t for lang, t in texts.items() if t.strip()}
        self.langs = sorted(texts)
        used = sorted({b for t in texts.values() for b in t})
        width = len(used) + 1
        self.code = np.full(256, len(used), np.uint8 if width <= 256 else np.int16)
        self.code[used] = np.arange(len(used))
        tables, base, self.roots = [], 0, []
        for lang in self.langs:
            to = suffix_automaton(texts[lang])
            self.roots.append(base)
            start = np.full(width, 2 * base + 1, np.int32)
            for b, s in to[0].items():
                start[self.code[b]] = 2 * (base + s * width) + 1
            t = np.tile(start, (len(to), 1))
            for k, moves in enumerate(to):
                if k and moves:
                    t[k, self.code[list(moves)]] = 2 * (base + np.fromiter(moves.values(), np.int64, len(moves)) * width)
            tables.append(t.ravel())
            base += t.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.weight = np.array([math.log2(1 + len(texts[lang])) for lang in self.langs])

    def phrases(self, data: list) -> np.ndarray:
        """Number of phrases of each text (rows) for each language (columns)."""
        owner, parts = [], []
        for i, d in enumerate(data):
            for k in range(0, len(d), BLOCK):
                parts.append(d[k : k + BLOCK])
                owner.append(i)
        out = np.zeros((len(data), len(self.langs)), np.int64)
        if not parts:
            return out
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        lanes = np.zeros((len(parts), BLOCK), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = self.code[np.frombuffer(b"".join(parts), np.uint8)]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        lanes[np.repeat(rank, size), np.arange(at[-1]) - np.repeat(at[:-1], size)] = flat
        lanes = np.ascontiguousarray(lanes.T)
        active = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(parts), axis=1)
        count = np.zeros(state.shape, np.int32)
        for k in range(BLOCK):
            n = active[k]
            if not n:
                break
            entry = self.table.take(state[:, :n] + lanes[k, :n])
            count[:, :n] += entry & 1
            state[:, :n] = entry >> 1
        np.add.at(out, np.array(owner)[order], count.T)
        return out

    def predict(self, texts: list) -> tuple[list, list]:
        data, letters = [], []
        for t in texts:
            letters.append(any(map(str.isalpha, t)) if t else False)
            data.append(_squeeze(normalise(t)) if letters[-1] else b"")
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = self.phrases(data) * self.weight
        best = cost.argmin(axis=1)
        lang = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        if len(self.langs) == 1:
            return lang, [1.0 if ok else 0.0 for ok in letters]
        two = np.partition(cost, 1, axis=1)
        score = np.where(letters, 1 - two[:, 0] / np.maximum(two[:, 1], 1), 0.0)
        return lang, score.tolist()


def _squeeze(data: bytes) -> bytes:
    """Runs of blanks as one blank, without those at the ends."""
    x = np.frombuffer(data, np.uint8)
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    return x[keep].tobytes().strip(b" ")


_parsers = {}


def parser(sample: dict) -> CrossParser:
    """The compiled automata of this worker process."""
    key = tuple(sorted(sample.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(sample)
    return _parsers[key]


def predict_language(df: DataFrame, sample: dict, text_col="text", names=("lang_pred", "score")) -> DataFrame:
    """``df`` with the predicted language and its score; ``sample`` as labelled_sample gives it.

    The text comes back as a string.
    """
    names = list(names)
    kept = [c for c in df.columns if c not in names]
    rest = F.struct(F.lit(True).alias("_"), *[c for c in kept if c != text_col])
    rows = df.select(rest.alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = parser(sample).predict(part.column("text").to_pylist())
                arrays = [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "_lang", "_score"])

    fields = [*rows.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType())]
    done = rows.mapInArrow(run, StructType(fields))
    columns = [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept]
    return done.select(*columns, F.col("_lang").alias(names[0]), F.col("_score").alias(names[1]))
