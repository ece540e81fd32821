"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives one metadata record (source headers, outlinks) and one conversion record
(its visible text). Both refer to the response's WARC-Record-ID, keep its target URI and date, and
carry digests of their own blocks and of the source's payload.

Defined results: a record that cannot be read, has no id or is not a response gives one row with an
``error`` and null fields; a null url is left out of the headers and a null html is an empty payload;
equal rows give equal records; an empty table gives no rows.
"""

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.llm.common import as_bytes, slices
from lidarlake.llm.html_text import visible_text

DATE = "2000-01-01T00:00:00Z"
_NEWLINE = b"\r\n"
_LINK = re.compile(rb"""<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
FIELDS = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, record binary, error string"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(headers: list, block: bytes) -> bytes:
    """A WARC 1.1 record; headers with an empty value are left out, line breaks inside values become blanks."""
    lines = [f"{k}: {' '.join(v.split())}".encode() for k, v in headers if v]
    lines.append(b"Content-Length: %d" % len(block))
    return _NEWLINE.join([b"WARC/1.1", *lines, b"", block, b"", b""])


def parse(data: bytes) -> tuple[list, bytes, bytes]:
    """(headers, block, rest) of the first record in ``data``; ValueError if it is damaged."""
    head, found, rest = data.partition(_NEWLINE * 2)
    if not found or not head.startswith(b"WARC/1."):
        raise ValueError("no record")
    headers = []
    for line in head.split(_NEWLINE)[1:]:
        if line[:1] in b" \t" and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip().decode("utf-8", "replace"))
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        headers.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    length = get(headers, "content-length")
    if not length.isdigit() or len(rest) < int(length) + 4 or rest[int(length) : int(length) + 4] != _NEWLINE * 2:
        raise ValueError("record is cut")
    return headers, rest[: int(length)], rest[int(length) + 4 :]


def get(headers: list, name: str) -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), "")


def payload(block: bytes) -> tuple[list, bytes]:
    """(HTTP headers, body) of a response block."""
    head, found, body = block.partition(_NEWLINE * 2)
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP response")
    pairs = [line.decode("latin-1").partition(":") for line in head.split(_NEWLINE)[1:]]
    return [(k.strip(), v.strip()) for k, _, v in pairs], body


def response(uri: str | None, body: bytes, seed: str, date=DATE) -> bytes:
    """Response record of a page; the id follows from ``seed`` and content."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    block = _NEWLINE.join([*head, b"", body])
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{seed} {uri} {hashlib.sha256(body).hexdigest()}").urn
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", date), ("WARC-Target-URI", uri or ""),
         ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)),
         ("WARC-Payload-Digest", digest(body))], block,
    )


def derive(data: bytes) -> list:
    """Rows (FIELDS) of the records derived from one response record."""
    try:
        headers, block, _ = parse(data)
        source = get(headers, "warc-record-id")
        if get(headers, "warc-type") != "response" or not source:
            raise ValueError("not a response")
        http, body = payload(block)
        for name, part in (("warc-block-digest", block), ("warc-payload-digest", body)):
            told = get(headers, name)
            if told.startswith("sha1:") and told != digest(part):
                raise ValueError(f"{name} does not fit")
    except ValueError as e:
        return [(*[None] * (len(_NAMES) - 1), str(e))]
    m = _CHARSET.search(get(http, "content-type").encode()) or _CHARSET.search(body[:1024])
    try:
        page = body.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    links = list(dict.fromkeys(b"".join(x) for x in _LINK.findall(body)))
    told = [f"source-{k.lower()}: {v}" for k, v in http] + [f"outlink: {x.decode('utf-8', 'replace')}" for x in links]
    blocks = [("metadata", "application/warc-fields", "".join(f"{' '.join(x.split())}\r\n" for x in told).encode()),
              ("conversion", "text/plain; charset=utf-8", visible_text(page).encode())]
    ids = {kind: uuid.uuid5(uuid.NAMESPACE_URL, f"{source} {kind}").urn for kind, _, _ in blocks}
    uri, date, own = get(headers, "warc-target-uri"), get(headers, "warc-date"), get(headers, "warc-payload-digest") or digest(body)
    rows = []
    for kind, mime, content in blocks:
        other = ids["conversion" if kind == "metadata" else "metadata"]
        fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ids[kind]}>"), ("WARC-Refers-To", source), ("WARC-Date", date),
                  ("WARC-Target-URI", uri), ("WARC-Concurrent-To", f"<{other}>" if kind == "metadata" else ""),
                  ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("Content-Type", mime),
                  ("WARC-Block-Digest", digest(content)), ("WARC-Source-Payload-Digest", own)]
        rows.append((kind, f"<{ids[kind]}>", source, uri or None, date or None, mime, len(content), digest(content), own,
                     record(fields, content), None))
    return rows


def page_responses(df: DataFrame, id_col="page_id", url_col="url", html_col="html", date=DATE) -> DataFrame:
    """Response records (id, record) of a table of pages."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                urls, ids = part.column("url").to_pylist(), part.column("id").to_pylist()
                out = [response(u, b, str(i), date) for u, b, i in zip(urls, as_bytes(part.column("html")), ids)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], ["id", "record"])

    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, record binary")
    return done.withColumnRenamed("id", id_col)


def derivatives(df: DataFrame, id_col="page_id", record_col="record") -> DataFrame:
    """The derived records of a table of response records, two rows each: the id and FIELDS."""
    rows = df.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "record"):
                found = [derive(b) for b in as_bytes(part.column("record"))]
                ids = part.column("id").take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
                values = list(zip(*(row for f in found for row in f))) or [[]] * len(_NAMES)
                types = [_TYPES[f.split()[1]] for f in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(values, types))], ["id", *_NAMES])

    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {FIELDS}")
    return done.withColumnRenamed("id", id_col)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, place, record) of the records of WARC files, plain or one gzip member per record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                place, at = 0, []
                while data.strip(b"\r\n"):
                    _, _, rest = parse(data)
                    at.append((name, place, data[: len(data) - len(rest)]))
                    data, place = rest, place + 1
                columns = list(zip(*at)) or [[], [], []]
                types = (pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "place", "record"])

    return files.mapInArrow(run, "path string, place long, record binary")
