"""Lines that many documents share: keep each in its first document only.

Normalised lines are exploded to (document, 128-bit key), distinct documents are counted per key with
a partial aggregation before the shuffle, and only the keys a document must lose travel back to it.
Texts move once, when they meet those keys. The lines of a document keep their order.

Defined results: a null or empty text is one empty line; a key shorter than ``min_chars`` never counts;
rows with one doc_id are one document, a null doc_id is a document after all others; columns of the
input that bear the name of a result column are replaced; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lidarlake.llm.common import as_bytes, fixed_binary, slices
from lidarlake.session import materialize

_LAST = (1 << 63) - 1
_WHITE = b" \t\n\v\f\r"


def line_keys(text: bytes, min_chars: int) -> list:
    """Key of each line of a text, None where the normalised line is too short to count."""
    out = []
    for line in text.split(b"\n"):
        k = line.strip(_WHITE).lower()
        counts = len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)
        out.append(hashlib.md5(k, usedforsecurity=False).digest() if counts else None)
    return out


def explode_keys(df: DataFrame, id_col="doc_id", text_col="text", min_chars=10) -> DataFrame:
    """Rows (doc, key) for the distinct long enough lines of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [list({k for k in line_keys(t, min_chars) if k}) for t in as_bytes(part.column("text"))]
                docs = np.repeat(part.column("doc").to_numpy(zero_copy_only=False), [len(k) for k in keys])
                data = b"".join(k for ks in keys for k in ks)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), fixed_binary(data, 16)], ["doc", "key"])

    rows = df.select(_doc(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, key binary")


def _doc(id_col):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def drop_repeated_lines(df: DataFrame, id_col="doc_id", text_col="text", min_chars=10, min_docs=2) -> DataFrame:
    """``df`` with the shortened text and the columns n_lines (before) and n_dropped.

    A key found in at least ``min_docs`` documents stays in the smallest of them alone.
    """
    lines = materialize(explode_keys(df, id_col, text_col, min_chars))
    per_key = lines.groupBy("key")
    if min_docs <= 2:
        shared = per_key.agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    else:
        docs = lines.groupBy("key", "doc").count().groupBy("key")
        shared = docs.agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # A key that very many documents hold makes one large partition of `lines`: the sort-merge join
    # is one that adaptive execution splits.
    lost = lines.join(shared.select("key", "first"), "key").where("doc <> first")
    lost = lost.groupBy("doc").agg(F.collect_list("key").alias("lost"))
    rest = F.struct(F.lit(True).alias("_"), *[c for c in df.columns if c != text_col])
    rows = df.select(rest.alias("row"), F.col(text_col).cast("string").alias("text"), _doc(id_col).alias("doc"))
    rows = rows.join(lost, "doc", "left").select("row", "text", "lost")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                kept, n_lines, n_dropped = [], [], []
                for text, lost in zip(as_bytes(part.column("text")), part.column("lost").to_pylist()):
                    lines = text.split(b"\n")
                    stay = lines
                    if lost:
                        lost = set(lost)
                        stay = [line for line, k in zip(lines, line_keys(text, min_chars)) if k not in lost]
                    kept.append(b"\n".join(stay).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                arrays = [part.column("row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(n_dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"]
                )

    fields = [StructField("row", rows.schema["row"].dataType), StructField("kept", StringType())]
    fields += [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    done = rows.mapInArrow(run, StructType(fields))
    columns = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    columns = [F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]
    return done.select(*columns, "n_lines", "n_dropped")
