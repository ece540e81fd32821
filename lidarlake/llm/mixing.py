"""Mix sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order (a hash of the id), up to three times over. The
virtual finish time of a queue entry is the source's words up to its end divided by the source's
target. All entries are range-sorted by finish time and taken until the word budget is used up. The
entry in service at time one, when every source has met its target, is split there, so a long document
does not push its source away from the target.

Running totals never need one task per source: hash ranges are summed first and a total per range is
carried over. Only the table of sources (one row each) is ranked in one task.

Defined results: a null text or one of white space only has size 0 and is taken 0 times; null sources
form one source ranked last; the order of equal ids is settled by size and a hash of the text; a mix
of an empty table is empty.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import SPACE, WORD
from lidarlake.session import materialize

WEIGHTS = (5, 2, 1)
ROWS_PER_RANGE = 5000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats=3) -> DataFrame:
    """One row per source: source, source_size, target.

    The sources share the total by weight; a target above ``repeats`` times its source's size stops
    there and the excess is shared again by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*map(F.lit, weights))[rank % len(weights)]
    per = per.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("full_at", F.lit(float(repeats)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum(repeats * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - capped) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())
    per = per.withColumn("level", level["level"])
    full = F.lit(float(repeats)) * F.col("source_size")
    target = F.least(full, F.coalesce(F.col("level") * F.col("weight"), full))
    return per.select("source", "source_size", target.alias("target"))


def queue_entries(sizes: DataFrame, targets: DataFrame, repeats=3, split=True) -> DataFrame:
    """Rows (row_id, copy, piece, words, finish, ...) of all queue entries; ``split``: cut at the target.

    ``sizes``: row_id, doc_id, source, size, tie.
    """
    rows = sizes.withColumn("shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    digits, n = 0, rows.count()
    while 16**digits * ROWS_PER_RANGE < n:
        digits += 1
    rows = rows.withColumn("range", F.substring("shuffle", 1, digits))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("source", "range").orderBy("shuffle", "doc_id", "size", "tie", "row_id")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ahead", F.sum("size").over(inside) - F.col("size")).alias("r")
    sums = sums.withColumnRenamed("source", "s_source").withColumnRenamed("range", "s_range")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    targets = targets.withColumnRenamed("source", "t_source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).where("target > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("start", F.col("copy") * F.col("source_size") + F.col("carried") + F.col("ahead"))
    rows = rows.withColumn("stop", F.col("start") + F.col("size")).withColumn("met", F.floor("target"))
    at_target = F.lit(split) & (F.col("start") < F.col("met")) & (F.col("met") < F.col("stop"))
    ends = F.when(at_target, F.array("met", "stop")).otherwise(F.array("stop"))
    rows = rows.select("*", F.posexplode(ends).alias("piece", "end"))
    words = F.col("end") - F.when(F.col("piece") == 0, F.col("start")).otherwise(F.col("met"))
    finish = F.col("end") / F.col("target")
    keys = ["row_id", "doc_id", "shuffle", "size", "tie", "copy", "piece"]
    return rows.select(*keys, words.alias("words"), finish.alias("finish"), "stop", "target")


ORDER = ("finish", "shuffle", "doc_id", "size", "tie", "row_id", "copy", "piece")


def take_in_order(entries: DataFrame, budget: int, whole=False) -> DataFrame:
    """Entries in global order of finish time until their words exceed the budget: (row_id, copy, words).

    With ``whole`` the entry that crosses the budget is the last one taken, not the first one left.
    """
    spread = entries.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    spread = materialize(spread)
    sums = spread.groupBy("part").agg(F.sum("words").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spread.withColumn("ahead", F.sum("words").over(inside)).join(sums, "part")
    used = F.col("carried") + F.col("ahead")
    return rows.where(used - F.col("words") < budget if whole else used <= budget).select("row_id", "copy", "words")


def document_sizes(df: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Narrow written table: row_id, doc_id, source, size, tie."""
    text = F.col(text_col).cast("string")
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    return materialize(rows.withColumn("row_id", F.monotonically_increasing_id()))


def mix(sizes: DataFrame, weights=WEIGHTS, repeats=3) -> tuple[DataFrame, DataFrame]:
    """(taken entries, targets) of a table made by document_sizes, for a budget of all its words."""
    targets = materialize(source_targets(sizes, weights, repeats))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    return take_in_order(queue_entries(sizes, targets, repeats), budget), targets


def whole_entries(sizes: DataFrame, weights=WEIGHTS, repeats=3) -> DataFrame:
    """(row_id, copy, words) of a mix without split documents.

    A source's queue ends with the entry at its target, which stays if it brings the source nearer to the
    target (also if both are as near). What is left is taken whole in order of finish times until the budget is met.
    """
    targets = materialize(source_targets(sizes, weights, repeats))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    entries = queue_entries(sizes, targets, repeats, split=False)
    return take_in_order(entries.where(2 * F.col("stop") - F.col("words") <= 2 * F.col("target")), budget, whole=True)


def mixture(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, repeats=3) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken."""
    sizes = document_sizes(df, id_col, text_col, source_col)
    taken, targets = mix(sizes, weights, repeats)
    taken = taken.groupBy("row_id").agg(F.sum("words").alias("taken"))
    targets = targets.withColumnRenamed("source", "t_source")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).join(taken, "row_id", "left")
    taken = F.coalesce("taken", F.lit(0)).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken)


def mixed_documents(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, repeats=3, whole=False) -> DataFrame:
    """The documents of the mix, one row for each time one is taken; the columns of ``df``.

    A document cut at its source's target keeps its leading words and the white space between them;
    with ``whole`` it is taken or left uncut, whichever brings its source nearer to the target.
    """
    marked = materialize(df.select(F.struct(*df.columns).alias("row")).withColumn("row_id", F.monotonically_increasing_id()))
    text = F.col(f"row.{text_col}").cast("string")
    sizes = marked.select(
        "row_id", F.col(f"row.{id_col}").alias("doc_id"), F.col(f"row.{source_col}").alias("source"),
        word_count(text).alias("size"), F.xxhash64(text).alias("tie"),
    )
    sizes = materialize(sizes)
    taken = whole_entries(sizes, weights, repeats) if whole else mix(sizes, weights, repeats)[0]
    taken = taken.groupBy("row_id", "copy").agg(F.sum("words").alias("words"))
    taken = taken.join(sizes.select("row_id", "size"), "row_id").where("words > 0")
    rows = marked.join(taken, "row_id")
    pieces = F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    leading = F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), leading).otherwise(text)
    columns = [cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return rows.select(*columns)
