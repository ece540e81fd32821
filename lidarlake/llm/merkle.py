"""Merkle manifest of a table: a tree per group, a tree over the groups, and a recursive climb per leaf.

A leaf is the digest of its row's fields; every ``fan`` consecutive nodes become their digest until one
is left, the group's subroot, and the subroots become the root the same way. All levels are written as
parent-linked node rows. One recursive query then climbs from every leaf: each step joins the parent,
emits the siblings met there and folds the (possibly tampered) digest with them.

Places are counted over ranges of (group, id), so no group is ranked in one task. All leaves of a group
end at one root node; to keep that join even, leaves are told apart by lanes of LANE consecutive ones
and a node is repeated once per lane below it, which adds a row per LANE leaves and level.

Defined results: a null field counts as ``-``; a null group is one group before all others; a null id
comes after all ids of its group; rows of one id are ordered by leaf digest, equal rows are leaves of
their own; a row without id is never tampered with; an empty table gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import lower_ascii
from lidarlake.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Leaves that share one copy of a node.
LANE = 4096
_TOP = "#"


@dataclass
class Manifest:
    """leaves: key, id, tree, pos, n, leaf, altered; nodes: tree, level, pos, n, hash, children; trees: tree, pos, n, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    fan: int = FAN


def digest(*fields):
    """Digest of fields one after the other, each with its length in bytes; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Add pos, the place of a row within its tree (from 0), and n, the rows of the tree."""
    spread = rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id())
    spread = materialize(spread)
    sums = spread.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    sums = sums.select("tree", "part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"), F.sum("c").over(whole).alias("n"))
    inside = Window.partitionBy("tree", "part").orderBy(*order)
    placed = spread.withColumn("pos", F.row_number().over(inside) - 1).join(sums, ["tree", "part"])
    return placed.withColumn("pos", (F.col("pos") + F.col("ahead")).cast("long")).drop("part", "ahead")


def levels(nodes: DataFrame, fan: int) -> list:
    """Written tables (tree, level, pos, n, hash, children) of all levels above ``nodes`` (tree, pos, n, hash)."""
    most, level, out = nodes.agg(F.max("n")).first()[0] or 0, 0, []
    while most > 1:
        level, most = level + 1, -(-most // fan)
        slot = F.struct((F.col("pos") % fan).alias("slot"), "hash")
        above = F.floor(F.col("pos") / fan).alias("pos")
        size = F.ceil(F.col("n") / fan).cast("long").alias("n")
        runs = nodes.where("n > 1").groupBy("tree", above, size).agg(F.array_sort(F.collect_list(slot)).alias("run"))
        text = F.array_join("run.hash", "")
        runs = runs.select("tree", F.lit(level).alias("level"), "pos", "n", F.sha2(text, 256).alias("hash"), F.unhex(text).alias("children"))
        nodes = materialize(runs)
        out.append(nodes)
    return out


def build_manifest(df: DataFrame, fields=FIELDS, id_col="doc_id", group_col="lang", altered=None, fan=FAN) -> Manifest:
    """The manifest of ``df``; ``altered``: {field: column} with the values a tampered row would have, null leaves rows alone."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("tree")
    plain = [F.col(c) for c in fields]
    other = F.lit(None).cast("string")
    if altered is not None:
        change = F.array_contains(F.array(*[c.isNotNull() for c in altered.values()]), True)
        other = F.when(change, digest(*[F.coalesce(altered[c], F.col(c)) if c in altered else F.col(c) for c in fields]))
    leaves = df.select(tree, F.col(id_col).alias("id"), digest(*plain).alias("leaf"), other.alias("altered"))
    leaves = materialize(leaves.withColumn("key", F.monotonically_increasing_id()))
    leaves = materialize(numbered(leaves, [F.col("id").asc_nulls_last(), "leaf", "key"]))
    base = leaves.select("tree", F.lit(0).alias("level"), "pos", "n", F.col("leaf").alias("hash"), F.lit(None).cast("binary").alias("children"))
    nodes = base
    for table in levels(base, fan):
        nodes = nodes.union(table)
    sizes = leaves.groupBy("tree").agg(F.max("n").alias("leaves"))
    subroots = nodes.where("n = 1").select(F.col("tree").alias("name"), F.col("hash").alias("subroot")).join(sizes.withColumnRenamed("tree", "name"), "name")
    trees = materialize(numbered(subroots.withColumn("tree", F.lit(_TOP)), ["name"]))
    top = trees.select("tree", F.lit(0).alias("level"), "pos", "n", F.col("subroot").alias("hash"), F.lit(None).cast("binary").alias("children"))
    for table in levels(top, fan):
        top = top.union(table)
    root = top.where("n = 1").select("hash").first()
    trees = trees.select(F.col("name").alias("tree"), "pos", "n", "leaves", "subroot")
    return Manifest(leaves, nodes.union(top).where("level > 0"), trees, root and root[0], fan)


def _power(fan, level):
    return F.pow(F.lit(fan), level).cast("long")


def node_links(manifest: Manifest) -> DataFrame:
    """Rows (tree, lane, id, parent, slot, children) to climb by: each inner node once per lane of leaves below it."""
    fan, span = manifest.fan, F.col("span")
    # The first node above a lone subroot belongs to the tree of the groups.
    homes = manifest.trees.select("tree", F.col("pos").alias("at"), F.col("n").alias("groups"), "leaves")
    own = manifest.nodes.where(F.col("tree") != _TOP).join(homes, "tree").withColumn("span", _power(fan, F.col("level")))
    last = F.least((F.col("pos") + 1) * span, F.col("leaves")) - 1
    lanes = F.sequence(F.floor(F.col("pos") * span / LANE), F.floor(last / LANE))
    own = own.select("tree", F.explode(lanes).alias("lane"), node_id("level", "pos").alias("id"), *parent_of("n", "groups", "level", "pos", "at", fan), "children")
    top = manifest.nodes.where(F.col("tree") == _TOP).select("level", "pos", "n", "children")
    paths = homes.withColumn("level", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log(F.col("groups").cast("double")) / F.log(F.lit(float(fan))) + 1).cast("int")))))
    paths = paths.withColumn("pos", F.floor(F.col("at") / _power(fan, F.col("level")))).join(top, ["level", "pos"])
    lanes = F.sequence(F.lit(0).cast("long"), F.floor((F.col("leaves") - 1) / LANE))
    none = F.lit(None)
    up = F.when(F.col("n") > 1, node_id(F.col("level") + 1, F.floor(F.col("pos") / fan), _TOP))
    paths = paths.select("tree", F.explode(lanes).alias("lane"), node_id("level", "pos", _TOP).alias("id"), up.alias("parent"), F.when(F.col("n") > 1, F.col("pos") % fan).otherwise(none).cast("int").alias("slot"), "children")
    return own.union(paths)


def node_id(level, pos, mark=""):
    level, pos = (F.col(c) if isinstance(c, str) else c for c in (level, pos))
    return F.concat(F.lit(mark), level.cast("string"), F.lit("/"), pos.cast("string"))


def parent_of(n, groups, level, pos, at, fan):
    """(parent, slot) of a node of a group's tree; the subroot's parent is in the tree of the groups."""
    n, groups, level, pos, at = map(F.col, (n, groups, level, pos, at))
    inner, outer = node_id(level + 1, F.floor(pos / fan)), node_id(F.lit(1), F.floor(at / fan), _TOP)
    slot = F.when(n > 1, pos % fan).when(groups > 1, at % fan).cast("int")
    return F.when(n > 1, inner).when(groups > 1, outer).alias("parent"), slot.alias("slot")


CLIMB = """
WITH RECURSIVE climb (tree, pos, lane, step, parent, slot, siblings, folded) AS (
  SELECT tree, pos, lane, 0, parent, slot, CAST(NULL AS BINARY), folded FROM {starts}
  UNION ALL
  SELECT c.tree, c.pos, c.lane, c.step + 1, n.parent, n.slot,
    concat(substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33)),
    sha2(lower(hex(concat(substring(n.children, 1, 32 * c.slot), unhex(c.folded), substring(n.children, 32 * c.slot + 33)))), 256)
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.lane = n.lane AND c.parent = n.id
)
SELECT tree, pos, step, parent, siblings, folded FROM climb
"""


def climb(manifest: Manifest) -> DataFrame:
    """Per leaf: tree, pos, proof_sha256 (digest of all siblings in order) and folded_root."""
    homes = manifest.trees.select("tree", F.col("pos").alias("at"), F.col("n").alias("groups"))
    starts = manifest.leaves.withColumn("level", F.lit(0)).join(homes, "tree")
    folded = F.coalesce("altered", "leaf").alias("folded")
    starts = starts.select("tree", "pos", F.floor(F.col("pos") / LANE).alias("lane"), *parent_of("n", "groups", "level", "pos", "at", manifest.fan), folded)
    starts, nodes = materialize(starts), materialize(node_links(manifest))
    spark = starts.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        steps = spark.sql(CLIMB, starts=starts, nodes=nodes)
        met = F.array_sort(F.collect_list(F.when(F.col("siblings").isNotNull(), F.struct("step", "siblings"))))
        joined = F.aggregate(met, F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))
        per = steps.groupBy("tree", "pos").agg(joined.alias("proof"), F.max(F.when(F.col("parent").isNull(), F.col("folded"))).alias("folded_root"))
        # Written here, since the limit holds for the session at the time the query runs.
        return materialize(per.select("tree", "pos", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root"))
    finally:
        spark.conf.set(limit, before)


def verified_leaves(manifest: Manifest) -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    if manifest.root is None:
        ddl = "string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return manifest.leaves.sparkSession.createDataFrame([], f"id {manifest.leaves.schema['id'].dataType.simpleString()}, leaf {ddl}")
    rows = manifest.leaves.select("tree", "pos", "id", "leaf").join(climb(manifest), ["tree", "pos"])
    rows = rows.join(manifest.trees.select("tree", "subroot"), "tree").withColumn("root", F.lit(manifest.root))
    return rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered_third(id_col="doc_id", text_col="text"):
    """The text in lower case where 3 divides the checksum of the id, else null."""
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, lower_ascii(F.col(text_col).cast("string")))


def tamper_check(df: DataFrame) -> DataFrame:
    """The manifest of a documents table, checked against rows of which about a third had their text lowered."""
    manifest = build_manifest(df, altered={"text": lowered_third()})
    return verified_leaves(manifest).withColumnRenamed("id", "doc_id")
