"""Byte-pair encoding with forced boundaries, and decoding.

Two bytes that stand next to each other in no token of the vocabulary can never be merged into one
token, so a word is certainly cut between them. Its fragments are encoded independently, each once per
worker process, and their ids are concatenated. Decoding looks up every id.

Ids are binary, little-endian unsigned 32-bit. Defined results: a null or empty text has no ids and
decodes to an empty text; special strings in a text become their ids (the tokenizer library's default);
an empty table gives no rows; long texts are taken in blocks cut at word boundaries.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lidarlake.llm.common import blocks, slices
from lidarlake.llm.token_counts import byte_alphabet, merge
from lidarlake.llm.unicode_tables import STAND_IN, composed_lower, library_composed_lower, library_tables

#: Words, and fragments, a worker process remembers: so many new ones, and those of the generation before.
MAX_REMEMBERED = 150_000


class _Words(dict):
    """Encoded ids of the words met lately; those met again move on to the next generation."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word):
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= MAX_REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordBpe:
    """A lower-casing word-level BPE read from its file: normalise, split into words, merge bytes."""

    def __init__(self, path: str, tables=None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or model["unk_token"] or spec["decoder"]:
            raise ValueError("not a tokenizer of the supported kind")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"])
        tables = tables or library_tables()
        self.stand_in = {c: STAND_IN[kind] for a, b, kind in tables.moved for c in range(a, b + 1)}
        self.moved = regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b, _ in tables.moved) + "]").search if tables.moved else None
        self.unlike = regex.compile("[" + "".join(map(regex.escape, tables.unlike)) + "]").search if tables.unlike else None
        self.library_form = library_composed_lower()
        self.letters = byte_alphabet()
        number = {c: b for b, c in self.letters.items()}
        self.joined = set()
        for token in self.vocab:
            b = [number[c] for c in token.removesuffix(self.end)]
            self.joined.update(zip(b, b[1:]))
        self.raw = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.words, self.fragments = _Words(self._word), _Words(self._fragment)

    def _fragment(self, key):
        symbols, last = key
        symbols = list(symbols)
        if last:
            symbols[-1] += self.end
        return b"".join(map(self.raw.__getitem__, merge(symbols, self.ranks)))

    def _word(self, word):
        data = word.encode()
        plain = word.isascii() and word.isalpha()
        letters = word if plain else "".join(map(self.letters.__getitem__, data))
        inner = [i for i, pair in enumerate(zip(data, data[1:]), 1) if pair not in self.joined]
        if not inner:
            return self._fragment((letters, True))
        cuts = [0, *inner, len(data)]
        parts = [(letters[i:j], j == len(data)) for i, j in zip(cuts, cuts[1:])]
        return b"".join(map(self.fragments.__getitem__, parts))

    def normalise(self, text):
        """Composed form in lower case, by the library where its tables differ from Python's."""
        if self.unlike and not text.isascii() and self.unlike(text):
            return self.library_form(text)
        return composed_lower(text)

    def split(self, text):
        """Words of a normalised text; characters of another class in the library are read as one of that class."""
        if self.moved and not text.isascii() and self.moved(text):
            return [text[m.start() : m.end()] for m in self.find.finditer(text.translate(self.stand_in))]
        return self.find.findall(text)

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.special_re.split(text)):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for block in blocks(part) if part else ():
                out += map(self.words.__getitem__, self.split(self.normalise(block)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids with blanks between them, word end marks and byte letters included."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded = {}


def word_bpe(path: str, tables=None) -> WordBpe:
    """The tokenizer of this worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path, tables)
    return _loaded[path]


def _with(df, column, kind, fields, types, run):
    """``df`` with result columns computed from one column, which comes back as ``kind``.

    Columns of the same name give way.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    rest = F.struct(F.lit(True).alias("_"), *[c for c in kept if c != column])
    rows = df.select(rest.alias("row"), F.col(column).cast(kind).alias("value"))

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "value"):
                values = list(zip(*map(run, part.column("value").to_pylist())))
                arrays = [pa.array(v, t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], ["row", "value", *names])

    done = rows.mapInArrow(apply, StructType([*rows.schema.fields, *fields]))
    columns = [(F.col("value") if c == column else F.col("row").getField(c)).alias(c) for c in kept]
    return done.select(*columns, *names)


def encode(df: DataFrame, tokenizer: str, text_col="text") -> DataFrame:
    """``df`` with n_tokens and ids."""
    tables = library_tables()

    def run(text):
        ids = word_bpe(tokenizer, tables).encode(text or "")
        return len(ids) // 4, ids

    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    return _with(df, text_col, "string", fields, [pa.int64(), pa.binary()], run)


def decode(df: DataFrame, tokenizer: str, ids_col="ids") -> DataFrame:
    """``df`` with the decoded text of its ids."""
    tables = library_tables()

    def run(ids):
        return (word_bpe(tokenizer, tables).decode(ids or b""),)

    return _with(df, ids_col, "binary", [StructField("decoded", StringType())], [pa.string()], run)


def round_trip(df: DataFrame, tokenizer: str, text_col="text", with_ids=True) -> DataFrame:
    """``df`` with n_tokens, ids (if wanted) and the SHA-256 of the ids and of the decoded text.

    Both directions in one pass, so decoded texts stay in the worker.
    """
    tables = library_tables()

    def run(text):
        own = word_bpe(tokenizer, tables)
        ids = own.encode(text or "")
        digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()
        return (len(ids) // 4, *digests, ids) if with_ids else (len(ids) // 4, *digests)

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    types = [pa.int64(), pa.string(), pa.string()]
    if with_ids:
        fields, types = [*fields, StructField("ids", BinaryType())], [*types, pa.binary()]
    return _with(df, text_col, "string", fields, types, run)


def encoded_digests(df: DataFrame, tokenizer: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: the id, n_tokens and the SHA-256 of ids and of the decoded text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = round_trip(rows, tokenizer, with_ids=False)
    return rows.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
