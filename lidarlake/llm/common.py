"""Helpers shared by the text operators."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; longer single texts are handled alone.
SLICE_BYTES = 1 << 20
#: A longer text is cut into blocks of about this size where that changes nothing.
BLOCK_CHARS = 2 << 20
#: The six ASCII white space characters that separate words everywhere here.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most=None):
    """Cut a record batch into runs of rows with at most SLICE_BYTES of text each, or one row."""
    most = most or SLICE_BYTES
    values = batch.column(column)
    width = np.diff(text_offsets(values))
    start = total = 0
    for i, n in enumerate(width):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def text_offsets(values: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array inside its data buffer; a null has no bytes."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    kind = np.int64 if wide else np.int32
    if len(values) == 0:
        return np.zeros(1, kind)
    offsets = np.frombuffer(values.buffers()[1], kind)
    return offsets[values.offset : values.offset + len(values) + 1]


def as_bytes(values: pa.Array) -> list:
    """UTF-8 bytes of each text, empty for null."""
    wide = pa.types.is_large_string(values.type)
    return [b or b"" for b in values.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def fixed_binary(data: bytes, width: int) -> pa.Array:
    """A binary array of equally wide values that lie one after the other in ``data``."""
    n = len(data) // width
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_CUT = re.compile(r"(?<=\S) (?=\S)")


def blocks(text: str):
    """Cut a text before single blanks between words, where a word always starts."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        m = _CUT.search(text, at + BLOCK_CHARS)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]
