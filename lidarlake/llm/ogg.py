"""Media columns: 8-bit samples in Ogg pages, written and read back.

A stored item has two logical streams. The sample stream holds the payload in packets of PACKET
samples, with the sample count as granule position; the index stream holds one CRC-32 per sample
packet. Pages of both are interleaved. Reading checks each page's checksum and order, puts packets
together from the lacing values, takes the streams apart and derives times from granule positions.

Defined results: a null text is empty; an empty payload is one block of zeros; damaged media give an
``error`` and null results instead of stopping the job; columns of the input stay, those that bear the
name of a result column are replaced.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from lidarlake.llm.common import as_bytes, slices

RATE = 8000
PACKET = 4080
BLOCK = 64
_SAMPLES, _INDEX = 1, 2
_FIRST, _LAST, _CONTINUED = 2, 4, 1
_NO_GRANULE = (1 << 64) - 1
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Page checksum (polynomial 0x04C11DB7, most significant bit first, no inversions).

    It is the mirror image of the usual CRC-32 over mirrored bytes.
    """
    c = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(serial, number, flags, granule, lacing, body):
    head = struct.pack("<4sBBQIII", b"OggS", 0, flags, granule & _NO_GRANULE, serial, number, 0)
    head += bytes((len(lacing),)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(serial, packets):
    """Pages of one logical stream from (bytes, granule position at its end) packets."""
    out, number = [], 0
    first, rest = packets[0], packets[1:]
    head = bytes((len(first[0]),))
    out.append(_page(serial, number, _FIRST | (0 if rest else _LAST), first[1], head, first[0]))
    lacing, body, granule, continued = bytearray(), [], _NO_GRANULE, False
    for k, (data, at) in enumerate(rest):
        values = b"\xff" * (len(data) // 255) + bytes((len(data) % 255,))
        done = 0
        while values:
            room = 255 - len(lacing)
            lacing += values[:room]
            used = sum(values[:room])
            body.append(data[done : done + used])
            done, values = done + used, values[room:]
            if not values:
                granule = at
            if len(lacing) == 255 or (k == len(rest) - 1 and not values):
                last = k == len(rest) - 1 and not values
                number += 1
                flags = (_CONTINUED if continued else 0) | (_LAST if last else 0)
                out.append(_page(serial, number, flags, granule, bytes(lacing), b"".join(body)))
                lacing, body, granule, continued = bytearray(), [], _NO_GRANULE, bool(values)
    return out


def write_ogg(payload: bytes, rate=RATE) -> bytes:
    """Media bytes of a payload."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.minimum(np.arange(1, len(parts) + 1) * PACKET, len(payload)).tolist()
    samples = [(struct.pack("<4sIQ", b"pcm8", rate, len(payload)), 0), *zip(parts, ends)]
    index = [(struct.pack("<4sI", b"crcs", len(parts)), 0)]
    index += [(struct.pack("<I", zlib.crc32(p)), e) for p, e in zip(parts, ends)]
    a, b = _pages(_SAMPLES, samples), _pages(_INDEX, index)
    out = []
    for i in range(max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


def read_pages(media: bytes):
    """Yield (serial, number, flags, granule, lacing, body) of each page; ValueError if damaged."""
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError(f"page at {at} is cut")
        mark, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBQIIIB", media, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError(f"page at {at} is cut")
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at {at}")
        yield serial, number, flags, granule, lacing, media[at + 27 + n : end]
        at = end


def demultiplex(media: bytes) -> dict:
    """Packets of each logical stream: serial -> [(bytes, granule position or None)]."""
    streams = {}
    for serial, number, flags, granule, lacing, body in read_pages(media):
        s = streams.setdefault(serial, {"next": 0, "open": None, "packets": [], "ended": False})
        if number != s["next"] or s["ended"] or bool(flags & _FIRST) != (number == 0):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        if bool(flags & _CONTINUED) != (s["open"] is not None):
            raise ValueError(f"page {number} of stream {serial} does not continue")
        s["next"] += 1
        done, start, parts, last = 0, 0, s["open"] or [], None
        for v in lacing:
            done += v
            if v < 255:
                parts.append(body[start:done])
                s["packets"].append((b"".join(parts), None))
                last, parts, start = len(s["packets"]) - 1, [], done
        pending = bool(lacing) and lacing[-1] == 255
        s["open"] = [*parts, body[start:done]] if pending else None
        if last is not None:
            s["packets"][last] = (s["packets"][last][0], granule)
        s["ended"] = bool(flags & _LAST)
    for serial, s in streams.items():
        if not s["ended"] or s["open"] is not None:
            raise ValueError(f"stream {serial} has no end")
    return {serial: s["packets"] for serial, s in streams.items()}


def read_ogg(media: bytes) -> dict:
    """Payload, page times and counts of a stored item; ValueError if damaged."""
    streams = demultiplex(media)
    if set(streams) != {_SAMPLES, _INDEX}:
        raise ValueError("streams are missing")
    (head, _), *packets = streams[_SAMPLES]
    mark, rate, length = struct.unpack("<4sIQ", head)
    payload = b"".join(p for p, _ in packets)
    sums = [zlib.crc32(p) for p, _ in packets]
    if mark != b"pcm8" or len(payload) != length or sums != [int.from_bytes(p, "little") for p, _ in streams[_INDEX][1:]]:
        raise ValueError("samples do not fit their index")
    times = [g / rate for _, g in packets if g is not None]
    return {"payload": payload, "rate": rate, "packets": len(packets), "times": times, "seconds": times[-1]}


def features(payload: bytes, found: dict) -> str:
    """Mean, root mean square and zero crossings of the centred samples, with packets and seconds."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    squares = int(np.square(x.astype(np.int32) - 128).sum(dtype=np.int64))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    mean, rms = total / n - 128, (squares / n) ** 0.5
    return f"mean={mean:.4f};rms={rms:.4f};crossings={crossings};packets={found['packets']};seconds={found['seconds']:.6f}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def _add(df, column, fields, run):
    """``df`` plus result columns computed per row from one column."""
    names = [f.name for f in fields]

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "value"):
                values = list(zip(*map(run, as_bytes(part.column("value"))))) or [[]] * len(names)
                arrays = [pa.array(v, t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *arrays], ["row", *names])

    types = [_ARROW[type(f.dataType)] for f in fields]
    kept = [c for c in df.columns if c not in names]
    rows_in = df.select(F.struct(*kept).alias("row"), F.col(column).alias("value"))
    schema = StructType([StructField("row", rows_in.schema["row"].dataType), *fields])
    done = rows_in.mapInArrow(rows, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], *names)


_ARROW = {LongType: pa.int64(), StringType: pa.string(), BinaryType: pa.binary(), DoubleType: pa.float64()}


def store_text(df: DataFrame, text_col="text") -> DataFrame:
    """Replace the text by its stored form: columns n_bytes and media."""

    def run(text):
        return len(text), write_ogg(padded(text))

    out = _add(df.withColumn(text_col, F.col(text_col).cast("string")), text_col,
               [StructField("n_bytes", LongType()), StructField("media", BinaryType())], run)
    return out.drop(text_col)


def read_media(df: DataFrame, media_col="media", with_payload=False) -> DataFrame:
    """Columns payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, seconds, error.

    ``with_payload`` adds the payload itself.
    """

    def run(media):
        size, digest = len(media), hashlib.sha256(media).hexdigest()
        try:
            found = read_ogg(media)
        except (ValueError, struct.error, IndexError) as e:
            return (None, None, None, size, digest, None, None, str(e), *((None,) if with_payload else ()))
        p = found["payload"]
        out = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), size, digest, features(p, found), found["seconds"], None)
        return (*out, p) if with_payload else out

    fields = [
        StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()),
        StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()),
        StructField("media_sha256", StringType()), StructField("feature", StringType()),
        StructField("seconds", DoubleType()), StructField("error", StringType()),
    ]
    return _add(df, media_col, fields + [StructField("payload", BinaryType())] * with_payload, run)
