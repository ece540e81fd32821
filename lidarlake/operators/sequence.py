"""Ordered work per key that survives a key holding a third of all rows.

Plain windows put one key into one task. The helpers here cut every key into chunks, work inside
the chunks in parallel, and carry a small summary per chunk across.
"""

import itertools
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lidarlake.session import materialize


def _back(keys, chunk="_chunk"):
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def dense_position(df: DataFrame, keys, order: str, chunk_size=100_000, name="pos") -> DataFrame:
    """Zero-based rank of the numeric column ``order`` (unique per key) within each key."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_size)))
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(_back(keys)), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_chunk", "_rn", "_offset")
    )


def monotone_time(df: DataFrame, keys, order: str, ts="ts", chunk_size=100_000) -> DataFrame:
    """Keep rows whose time exceeds that of every earlier row of the key."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_size)))
    carry = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max(ts).alias("_max"))
        .withColumn("_carry", F.max("_max").over(_back(keys)))
        .drop("_max")
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.greatest("_seen", "_carry")
    return (
        rows.withColumn("_seen", F.max(ts).over(inside))
        .join(carry, [*keys, "_chunk"])
        .filter(seen.isNull() | (F.col(ts) > seen))
        .drop("_chunk", "_seen", "_carry")
    )


def asof_bracket(
    samples: DataFrame, keyframes: DataFrame, keys, ts="ts", order="kf_id", payload=None,
    tie="first", chunk_seconds=3600.0,
) -> DataFrame:
    """Attach structs ``before`` and ``after``: the keyframes around each sample's time.

    A missing side is NULL. Among keyframes of one time the lowest (``tie="first"``) or highest
    ``order`` counts. ``ts`` is in seconds on both sides.
    """
    payload = payload or [c for c in keyframes.columns if c not in keys]
    pick = F.min_by if tie == "first" else F.max_by
    right = keyframes.groupBy(*keys, ts).agg(
        pick(F.struct(*payload), order).alias("_kf")
    )
    both = (
        samples.withColumn("_side", F.lit(1))
        .unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        .withColumn("_chunk", F.floor(F.col(ts) / F.lit(chunk_seconds)))
    )
    has = F.when(F.col("_kf").isNotNull(), F.col(ts))
    ends = both.groupBy(*keys, "_chunk").agg(
        F.max_by("_kf", has).alias("_last"), F.min_by("_kf", has).alias("_first")
    )
    ahead = (
        Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = ends.select(
        *keys,
        "_chunk",
        F.last("_last", ignorenulls=True).over(_back(keys)).alias("_prev"),
        F.last("_first", ignorenulls=True).over(ahead).alias("_next"),
    )
    part = Window.partitionBy(*keys, "_chunk")
    upto = (Window.unboundedPreceding, 0)
    return (
        both.withColumn(
            "_b", F.last("_kf", ignorenulls=True).over(part.orderBy(ts, "_side").rowsBetween(*upto))
        )
        .withColumn(
            "_a",
            F.last("_kf", ignorenulls=True).over(
                part.orderBy(F.desc(ts), "_side").rowsBetween(*upto)
            ),
        )
        .filter("_side = 1")
        .join(carry, [*keys, "_chunk"])
        .withColumn("before", F.coalesce("_b", "_prev"))
        .withColumn("after", F.coalesce("_a", "_next"))
        .drop("_side", "_kf", "_chunk", "_b", "_a", "_prev", "_next")
    )


def asof_backward(samples, keyframes, keys, ts="ts", order="kf_id", payload=None, chunk_seconds=3600.0):
    """Latest keyframe at or before each sample, else the key's first keyframe, as ``anchor``."""
    payload = payload or [c for c in keyframes.columns if c not in keys]
    first = keyframes.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("_head"))
    return (
        asof_bracket(samples, keyframes, keys, ts, order, payload, "last", chunk_seconds)
        .join(first, keys, "left")
        .withColumn("anchor", F.coalesce("before", "_head"))
        .drop("before", "after", "_head")
    )


def nearest_by_time(samples, keyframes, keys, ts="ts", order="kf_id", payload=None, chunk_seconds=3600.0):
    """Keyframe of least absolute time difference as ``nearest``; the earlier one wins a tie."""
    payload = payload or [c for c in keyframes.columns if c not in keys]
    if ts not in payload:
        payload = [*payload, ts]
    out = asof_bracket(samples, keyframes, keys, ts, order, payload, "first", chunk_seconds)
    gap_b, gap_a = F.col(ts) - F.col("before")[ts], F.col("after")[ts] - F.col(ts)
    near = F.when(F.col("after").isNull() | (gap_b <= gap_a), F.col("before")).otherwise(F.col("after"))
    return out.withColumn("nearest", near).drop("before", "after")


def sync_nearest(a: DataFrame, b: DataFrame, keys, tol=0.1, ts="ts", order="b_id", payload=None,
                 chunk_seconds=3600.0) -> DataFrame:
    """Pair each row of ``a`` with the row of ``b`` nearest in time, within ``tol`` seconds."""
    near = nearest_by_time(a, b, keys, ts, order, payload, chunk_seconds)
    return near.filter(F.abs(F.col("nearest")[ts] - F.col(ts)) <= tol)


def chunked_fold(
    df: DataFrame, keys, chunk: Column, order, fold, out_ddl: str, initial
) -> DataFrame:
    """Sequential fold per key, computed chunk by chunk in parallel.

    ``fold(state, rows)`` is a generator over the ordered rows (dicts, structs as tuples) of one
    chunk that yields output dicts and returns the new state; states are JSON values. Chunks are
    sorted by Spark and read row by row, so many short ones cost no frame each and none is held. All chunks first start from ``initial``. A chunk whose true entry state (the exit
    state of the chunk before it) differs is run again, until no entry changes. The first chunk of
    a key is right after the first pass and each later pass settles at least one more chunk, so the
    result equals the plain sequential fold.
    """
    out_cols = [c.strip().rsplit(" ", 1)[0].split(" ")[0] for c in _split_ddl(out_ddl)]
    start = json.dumps(initial)
    ddl = f"{_key_ddl(df, keys)}, _chunk long, _exit string, {out_ddl}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = df.withColumn("_chunk", chunk.cast("long"))
    order = [order] if isinstance(order, str) else list(order)
    head = [*keys, "_chunk"]

    def outputs_of(batches):
        for part, chunk_rows in itertools.groupby(_rows(batches), lambda r: tuple(r[c] for c in head)):
            first = next(chunk_rows)
            at, end = dict(zip(head, part)), []

            def whole(first=first, chunk_rows=chunk_rows, end=end):
                end.append((yield from fold(json.loads(first["_entry"]), itertools.chain([first], chunk_rows))))

            for out in whole():
                yield {**{c: out[c] for c in out_cols}, **at, "_exit": None}
            yield {**dict.fromkeys(out_cols), **at, "_exit": json.dumps(end[0])}

    def run(batches):
        outs = outputs_of(batches)
        while some := list(itertools.islice(outs, 10_000)):
            yield pa.RecordBatch.from_pylist(some, schema)

    pending = rows.withColumn("_entry", F.lit(start))
    outputs, settled, round_no = [], None, 0
    while True:
        sorted_chunks = pending.repartition(*head).sortWithinPartitions(*head, *order)
        ran = materialize(sorted_chunks.mapInArrow(run, ddl))
        outputs.append(ran.filter("_exit is null").withColumn("_round", F.lit(round_no)))
        exits = ran.filter("_exit is not null").select(*keys, "_chunk", "_exit")
        if settled is None:
            settled = exits.withColumn("_used", F.lit(start)).withColumn("_round", F.lit(0))
        else:
            fresh = exits.join(stale, [*keys, "_chunk"]).select(
                *keys, "_chunk", "_exit", F.col("_entry").alias("_used"),
                F.lit(round_no).alias("_round"),
            )
            settled = settled.join(stale, [*keys, "_chunk"], "left_anti").unionByName(fresh)
        settled = materialize(settled)
        by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
        stale = (
            settled.withColumn("_entry", F.coalesce(F.lag("_exit").over(by_chunk), F.lit(start)))
            .filter("_entry <> _used")
            .select(*keys, "_chunk", "_entry")
        )
        if stale.isEmpty():
            break
        stale = materialize(stale)
        pending = rows.join(stale, [*keys, "_chunk"])
        round_no += 1
    if len(outputs) == 1:
        return outputs[0].select(*keys, *out_cols)
    result = outputs[0]
    for o in outputs[1:]:
        result = result.unionByName(o)
    return result.join(settled.select(*keys, "_chunk", "_round"), [*keys, "_chunk", "_round"]).select(
        *keys, *out_cols
    )


def _rows(batches):
    """Rows of Arrow batches as dicts; structs become tuples of their fields."""
    for batch in batches:
        columns = [_values(c) for c in batch.columns]
        for values in zip(*columns):
            yield dict(zip(batch.schema.names, values))


def _values(column):
    if not pa.types.is_struct(column.type):
        return column.to_pylist()
    fields = zip(*(f.to_pylist() for f in column.flatten()))
    return [v if ok else None for v, ok in zip(fields, column.is_valid().to_pylist())]


def _key_ddl(df, keys):
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def _split_ddl(ddl):
    """Split a DDL string at its top-level commas."""
    parts, depth, cur = [], 0, ""
    for ch in ddl:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return [*parts, cur]
