"""Token counts by a tokenizer compiled to a deterministic transducer.

Reading one byte moves the transducer to a next state and emits by how much the token count of the
word so far changes. A state is what the rest of a word can depend on: for each start of a token that
may still be open, its place in the vocabulary's trie, the token before it and its count relative to
the present one. States and transitions are compiled when first met and kept in a dense table, so a
block of text is counted by array look-ups: all chunks advance together, one byte per step.

A chunk's map from state to (state, count) is constant from its first word start on. The maps are
composed by a scan over chunks: heads (what lies before a chunk's first word start) are run from the
end states of the chunks before them, all those with a known state at once.

Defined results: a null or empty text has no tokens; special strings in a text count as one token each
(the tokenizer library's default); an empty table gives no rows; texts of any length are cut at word
starts into blocks of bounded size.
"""

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import BLOCK_CHARS, blocks, slices
from lidarlake.llm.unicode_tables import SPACE, library_tables

CHUNK = 256
#: Compiled states kept at once; beyond it compilation starts anew with the same results.
MAX_STATES = 200_000
_BIAS = 1 << 9
_NEVER = 1 << 60
_GROW = 1 << 15

# Fixed values of the pre-tokenizer: the endings split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_alphabet() -> dict:
    """Character that stands for each byte in byte-level vocabularies.

    Printable characters of Latin-1 stand for themselves, the others follow from 256 on in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def load_bpe(path: str):
    """(token -> id, pair of tokens -> rank, special strings) of a byte-level BPE file; tokens are bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_alphabet().items()}
    raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ranks = {(raw[a], raw[b]): i for i, (a, b) in enumerate(merges)}
    return {raw[t]: i for t, i in spec["model"]["vocab"].items()}, ranks, [t["content"] for t in spec["added_tokens"]]


def merge(parts: list, ranks: dict) -> list:
    """Byte-pair encoding of a list of symbols: the lowest ranked pair is joined first, leftmost first."""
    if len(parts) > 128:
        return _merge_long(parts, ranks)
    parts, get = list(parts), ranks.get
    found = [get(p, _NEVER) for p in zip(parts, parts[1:])]
    while found:
        best = min(found)
        if best == _NEVER:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = get((parts[i - 1], parts[i]), _NEVER)
        if i < len(found):
            found[i] = get((parts[i], parts[i + 1]), _NEVER)
    return parts


def _merge_long(parts, ranks):
    """The same with a heap of pairs over a linked list, for long words."""
    parts, n = list(parts), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                rank = ranks.get((parts[k], parts[after[k]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, k))
    return [p for p in parts if p is not None]


class Transducer:
    """Transitions of the count transducer, compiled on demand. State 0 waits for a word start, 1 is a word start."""

    def __init__(self, path: str, max_states=MAX_STATES):
        self.max_states = max_states
        self.vocab, self.ranks, self.special = load_bpe(path)
        self.token = list(self.vocab)
        self.child, self.ends, self.inner = {}, [-1], [True]
        for number, token in enumerate(self.token):
            node = 0
            for b in token:
                self.inner[node] = True
                key = node << 8 | b
                node = self.child.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = number
        self.fits = {}
        self.reset()

    def reset(self):
        start = ((0, -1, 0),)
        self.states, self.number = [None, start], {start: 1}
        # Columns of the table are dealt to byte values as they are met.
        self.column, self.bytes = np.full(256, -1, np.int16), []
        self.table = np.full((_GROW, 128), -1, np.int32)
        self.table[0] = _BIAS

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Table column of each byte."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.bytes)
                self.bytes.append(b)
        if len(self.bytes) > self.table.shape[1]:
            wide = np.full((len(self.table), 256), -1, np.int32)
            wide[:, :128] = self.table
            wide[0] = _BIAS
            self.table = wide
        return self.column[data].astype(np.uint8)

    def adjacent(self, a: int, b: int) -> bool:
        """Whether two tokens in a row stay as they are when encoded together."""
        key = a << 20 | b
        if key not in self.fits:
            left, right = self.token[a], self.token[b]
            text = left + right
            self.fits[key] = merge([text[i : i + 1] for i in range(len(text))], self.ranks) == [left, right]
        return self.fits[key]

    def compile(self, state: int, column: int) -> None:
        """Fill in one transition."""
        opened, best, byte = [], None, self.bytes[column]
        for node, before, count in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.ends[node]
            if token >= 0 and best is None and (before < 0 or self.adjacent(before, token)):
                best = (token, count + 1)
            if self.inner[node]:
                opened.append((node, before, count))
        token, emitted = best
        key = (*((n, b, c - emitted) for n, b, c in opened), (0, token, 0))
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
            if number == len(self.table):
                self.table = np.concatenate([self.table, np.full((_GROW, self.table.shape[1]), -1, np.int32)])
        self.table[state, column] = number * (2 * _BIAS) + emitted + _BIAS

    def step(self, state: np.ndarray, column: np.ndarray):
        """(next states, emitted counts) of many lanes."""
        width = self.table.shape[1]
        at = state.astype(np.int64) * width + column
        entry = self.table.ravel().take(at)
        if (entry < 0).any():
            for key in np.unique(at[entry < 0]).tolist():
                self.compile(*divmod(key, width))
            entry = self.table.ravel().take(at)
        return entry >> 10, (entry & (2 * _BIAS - 1)) - _BIAS

    def emissions(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Count change at each byte; ``starts`` marks the bytes where a word starts."""
        if len(self.states) > self.max_states:
            self.reset()
        n = len(data)
        rows = -(-n // CHUNK)
        cells = np.zeros(rows * CHUNK, np.uint8)
        cells[:n] = self.columns(data)
        first = np.zeros(rows * CHUNK, bool)
        first[:n] = starts
        first[n:] = True
        cells, first = np.ascontiguousarray(cells.reshape(rows, CHUNK).T), np.ascontiguousarray(first.reshape(rows, CHUNK).T)
        out = np.zeros((CHUNK, rows), np.int16)
        state = np.zeros(rows, np.int32)
        for k in range(CHUNK):
            state[first[k]] = 1
            state, out[k] = self.step(state, cells[k])
        # Scan over the chunk maps: state 0 at the end marks a map that is not constant yet.
        head = np.where(first.any(axis=0), first.argmax(axis=0), CHUNK)
        todo = np.flatnonzero(head > 0)
        while len(todo):
            ready = todo[state[todo - 1] > 0]
            lanes, at, k = ready, state[ready - 1], 0
            while len(lanes):
                at, out[k, lanes] = self.step(at, cells[k, lanes])
                k += 1
                whole = lanes[head[lanes] == k] if k == CHUNK else lanes[:0]
                state[whole] = at[head[lanes] == k] if k == CHUNK else at[:0]
                go = head[lanes] > k
                lanes, at = lanes[go], at[go]
            todo = np.setdiff1d(todo, ready, assume_unique=True)
        return out.T.reshape(-1)[:n]


def word_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer starts a word; ``first`` marks the starts of independent texts.

    Words are runs of letters, numbers or other characters, each with one blank before it if there is
    one; a run of white space before a word gives its last character away; endings after an
    apostrophe that starts a word stand alone.
    """
    n = len(points)
    kind = classes[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    # Last white space before a word of the same text.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start |= last
    blank = last & (points == 32)
    start[1:][blank[:-1]] = False
    marks = np.flatnonzero((points == 39) & start)
    if len(marks):
        room = np.concatenate([points, np.zeros(3, points.dtype)])
        text_end = np.concatenate([first, np.ones(3, bool)])
        for ending in ENDINGS:
            hit = np.ones(len(marks), bool)
            for j, c in enumerate(ending, 1):
                hit &= (room[marks + j] == ord(c)) & ~text_end[marks + j]
            at = marks[hit]
            for j in range(1, len(ending) + 1):
                start[at + j] = False
            after = at + len(ending) + 1
            start[after[after < n]] = True
            blanks = after[after < n]
            blanks = blanks[blank[blanks]]
            start[blanks + 1] = False
    return start


class Counter:
    def __init__(self, path: str, tables=None):
        self.transducer = Transducer(path)
        self.classes = (tables or library_tables()).classes()
        self.special = re.compile("|".join(map(re.escape, self.transducer.special))) if self.transducer.special else None

    def count(self, texts: list) -> np.ndarray:
        """Number of tokens of each text."""
        counts = np.zeros(len(texts), np.int64)
        pieces, owner, size = [], [], 0
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            counts[i] += len(parts) - 1
            for part in parts:
                for block in blocks(part) if part else ():
                    if size + len(block) > BLOCK_CHARS and pieces:
                        self._add(counts, pieces, owner)
                        pieces, owner, size = [], [], 0
                    pieces.append(block)
                    owner.append(i)
                    size += len(block)
        if pieces:
            self._add(counts, pieces, owner)
        return counts

    def _add(self, counts, pieces, owner):
        text = "".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
        first = np.zeros(len(points), bool)
        first[begin] = True
        start = word_starts(points, first, self.classes)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.zeros(len(data), bool)
        starts[place[start]] = True
        emitted = self.transducer.emissions(data, starts)
        np.add.at(counts, owner, np.add.reduceat(emitted, place[begin], dtype=np.int64))


_counters = {}


def counter(path: str, tables=None) -> Counter:
    """The compiled tokenizer of this worker process."""
    if path not in _counters:
        _counters[path] = Counter(path, tables)
    return _counters[path]


def count_tokens(df: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", limit=512) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit. ``tokenizer`` is the path of a byte-level BPE file."""
    tables = library_tables()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = counter(tokenizer, tables).count(texts)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
