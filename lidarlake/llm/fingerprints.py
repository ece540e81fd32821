"""Document fingerprints: one-permutation MinHash in packed low-order bits, with built-in functions only.

Each word shingle is hashed once; the upper bits of the hash name a bin, the bin keeps its least hash.
An empty bin takes the value of another by optimal densification: it probes bins in the order of a
hash of (bin, attempt) until one is filled; after the last attempt it takes the filled bin with the
least hash of (bin, filled bin), so every empty bin finds one. BITS low-order bits per bin are packed
into 64-bit words. The likeness of two fingerprints is the share of equal bins, corrected for bins
that agree by chance.

Defined results: equal texts have equal fingerprints; a null text is empty; a text without words has
the fingerprint '' and likeness 1 with another such, 0 with all others; fewer than WIDTH words are one
shingle; rows of equal id follow each other in the order of their texts, a null id comes last; an empty
table gives no rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
BITS = 8
WIDTH = 5
ATTEMPTS = 12
ROWS_PER_CHUNK = 1000
MAX_CHUNKS = 10_000
PER_LONG = 64 // BITS
_SHIFT = 63 - (BINS.bit_length() - 1)
_LONG_MAX = (1 << 63) - 1
#: Lowest bit of each packed value.
_LOW = sum(1 << (BITS * i) for i in range(PER_LONG))


def _steps(text: str) -> list:
    """(column, SQL) of the steps from a text to its packed fingerprint, each used by the next."""
    hashed = ", ".join(f"get(f_words, i + {j})" for j in range(WIDTH))
    mark = f"((b + 1L) << {_SHIFT}) - 1L"
    probes = ", ".join(f"f_bins[cast(pmod(xxhash64(b, {a}), {BINS}) as int)]" for a in range(ATTEMPTS))
    filled = "filter(transform(f_bins, (y, j) -> struct(xxhash64(b, j) as k, y as y)), p -> p.y is not null)"
    packed = " | ".join(f"((f_full[{PER_LONG} * i + {j}] & {(1 << BITS) - 1}L) << {BITS * j})" for j in range(PER_LONG))
    return [
        ("f_words", f"filter(split(lower(coalesce({text}, '')), '[ \\\\t-\\\\r]+'), w -> w <> '')"),
        ("f_marks", f"transform(sequence(0, {BINS - 1}), b -> if(b = {BINS - 1}, {_LONG_MAX}L, {mark}))"),
        ("f_hashes", f"transform(sequence(0, greatest(size(f_words) - {WIDTH}, 0)), i -> shiftrightunsigned(xxhash64({hashed}), 1))"),
        ("f_sorted", "sort_array(concat(f_hashes, f_marks))"),
        # Sorting puts each bin's mark behind its hashes; the first value of a bin is its minimum.
        ("f_least", f"filter(f_sorted, (v, i) -> i = 0 or shiftright(v, {_SHIFT}) <> shiftright(get(f_sorted, i - 1), {_SHIFT}))"),
        ("f_bins", "transform(f_least, (v, b) -> if(v = f_marks[b], null, v))"),
        ("f_full", f"transform(f_bins, (v, b) -> coalesce(v, {probes}, array_min({filled}).y))"),
        ("f_packed", f"if(size(f_words) = 0, cast(array() as array<bigint>), transform(sequence(0, {BINS // PER_LONG - 1}), i -> {packed}))"),
    ]


def add_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the packed fingerprint (array<bigint>, empty without words) of a text column."""
    kept = df.columns
    for name, sql in _steps(text):
        df = df.withColumn(name, F.expr(sql))
    return df.select(*kept, F.col("f_packed").alias(into))


def likeness(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """``df`` with the estimated Jaccard similarity (0 to 1) of two packed fingerprints."""
    kept = [c for c in df.columns if c != into]
    df = df.withColumn("f_x", F.expr(f"zip_with({a}, {b}, (x, y) -> x ^ y)"))
    step = BITS // 2
    while step:
        # Fold every packed value onto its lowest bit: it is 1 there if the values differ.
        df = df.withColumn("f_x", F.expr(f"transform(f_x, x -> x | shiftrightunsigned(x, {step}))"))
        step //= 2
    differ = F.expr(f"aggregate(f_x, 0, (n, x) -> n + cast(bit_count(x & {_LOW}L) as int))")
    chance = 2.0**-BITS
    same = (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance)
    none = F.size(a) + F.size(b) == 0
    either = (F.size(a) == 0) | (F.size(b) == 0)
    value = F.when(none, 1.0).when(either, 0.0).otherwise(F.greatest(same, F.lit(0.0)))
    return df.select(*kept, value.alias(into))


def fingerprint_text(packed: str):
    """Packed fingerprint as hexadecimal text."""
    return F.expr(f"array_join(transform({packed}, x -> lpad(hex(x), 16, '0')), '')")


def followed(df: DataFrame, id_col: str, order_col: str, columns: list) -> DataFrame:
    """``df`` with next_<column> of the row that follows in descending id, after the last the first.

    Quantiles of the id cut the order into chunks, each headed by an id of the data. The rows of that
    id are copied to the end of the chunk before, so one shuffle brings each row and its follower
    together and no task sees more than a chunk's neighbourhood.
    """
    total, most = df.agg(F.count("*"), F.max(id_col)).first()
    n = min(MAX_CHUNKS, -(-total // ROWS_PER_CHUNK))
    heads = []
    if most is not None:
        shares = F.array(*[F.lit(i / n) for i in range(1, n)]).cast("array<double>")
        found = df.agg(F.percentile_approx(id_col, shares, 10 * n + 1000)).first()[0] if n > 1 else []
        heads = sorted({*found, most})
    top, all_heads = max(0, len(heads) - 1), f"array({', '.join(f'{h}L' for h in heads) or '0L'})"
    middle = "cast((s.lo + s.hi) div 2 as int)"
    # Binary search for the first head not below the id; rows without an id end the last chunk.
    chunk = (
        f"if({id_col} is null, 0, aggregate(sequence(1, {(top + 1).bit_length()}), struct(0 as lo, {top} as hi), (s, k) -> "
        f"if({all_heads}[{middle}] < {id_col}, struct({middle} + 1 as lo, greatest(s.hi, {middle} + 1) as hi), "
        f"struct(s.lo as lo, {middle} as hi))).lo)"
    )
    head = f"{id_col} = {all_heads}[f_chunk]" if heads else "true"
    before = f"if(f_chunk = {top}, 0, f_chunk + 1)"
    df = df.withColumn("f_chunk", F.expr(chunk))
    copies = f"if({head}, array(struct(f_chunk as c, 0 as copy), struct({before} as c, 1 as copy)), array(struct(f_chunk as c, 0 as copy)))"
    df = df.withColumn("f_at", F.explode(F.expr(copies)))
    df = df.withColumns({"f_chunk": F.col("f_at.c"), "f_copy": F.col("f_at.copy")}).drop("f_at")
    order = Window.partitionBy("f_chunk").orderBy("f_copy", F.col(id_col).desc_nulls_last(), order_col)
    df = df.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return df.where("f_copy = 0").drop("f_chunk", "f_copy")


def edited_fingerprints(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last half (rounded down) replaced by as many of the first code points of
    the next text, or all of them.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = followed(add_fingerprint(rows, "text", "fp"), "id", "text", ["text", "fp"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("cast(n_chars div 2 as int)"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - half), left(next_text, half))"))
    rows = rows.select("id", "n_chars", "edited", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"))
    rows = add_fingerprint(rows, "edited", "edited_fp").drop("edited")
    rows = likeness(likeness(rows, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    texts = fingerprint_text("fp").alias("fingerprint"), fingerprint_text("edited_fp").alias("edited_fingerprint")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", *texts, "near_edited", "near_next")
