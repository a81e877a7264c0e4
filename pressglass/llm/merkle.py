"""A Merkle manifest of a table: each source has a tree over its rows, and the sources' roots have one above them.

Levels are built from places in order, LEVELS of them in a job, and stored: the lowest ones in a row for each block of
leaves, those above as node rows, each with its siblings and a link to its parent.  A recursive query ascends from the blocks:
each step joins the rows with the nodes that they have reached, appends the nodes' siblings to the proof and folds every
leaf's hash, as recomputed from the table as found, with them.  Leaves of a block have all nodes above it in common, so
they climb in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressglass.llm.common import Scratch, placed, stored

#: Nodes in a run, and levels that one job builds.
FAN, LEVELS = 3, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources' roots.
TOP = -1
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, block, up_tree, up_level, up_pos, folded, proof, subroot, root FROM {blocks}
  UNION ALL
  SELECT c.tree, c.block, n.up_tree, n.up_level, n.up_pos,
    IF(n.up_tree IS NULL, c.folded, transform(c.folded, x -> unhex(sha2(lower(hex(concat(n.left, x, n.right))), 256)))) AS folded,
    concat(c.proof, n.left, n.right) AS proof,
    coalesce(c.subroot, IF(n.tree = -1, n.digest, NULL)) AS subroot,
    IF(n.up_tree IS NULL, n.digest, NULL) AS root
  FROM climb AS c JOIN {nodes} AS n ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos
)
SELECT tree, block, folded, proof, subroot, root FROM climb WHERE root IS NOT NULL
"""


@dataclass
class Manifest:
    """blocks: tree, block, height, leaves (id, leaf, found), l0 to l3 (digests of levels 0 to 3).  nodes: tree, level, pos,
    digest, left and right (its siblings' digests), up_tree, up_level, up_pos (its parent; null at the root)."""

    blocks: DataFrame
    nodes: DataFrame


def _h(digests: Column) -> Column:
    """SHA-256 of digests in a row, which go in as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _glued(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _runs(level: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / FAN).cast("int")), lambda i: _h(_glued(F.slice(level, i * FAN + 1, F.lit(FAN)))))


def _left(level: Column, i: Column) -> Column:
    return _glued(F.slice(level, i - i % FAN + 1, i % FAN))


def _right(level: Column, i: Column) -> Column:
    return _glued(F.slice(level, i + 2, FAN - 1 - i % FAN))


def _levels(groups: DataFrame, base: int) -> DataFrame:
    """Adds l1 to l3 to l0: each level's digests, or those below where the tree ends."""
    for j in range(LEVELS):
        groups = groups.withColumn(f"l{j + 1}", F.when(F.col("height") > base + j, _runs(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
    return groups


def _height(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(39)]), lambda x: x < n))


def _up(level: Column, pos: Column) -> list[Column]:
    """The link to a node's parent, of which a source's last one is a leaf of the tree above."""
    last, source = level + 1 >= F.col("height"), F.col("tree") != TOP
    return [
        F.when(last & source, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when(last & source, F.lit(0)).otherwise(level + 1).cast("int").alias("up_level"),
        F.when(last & source, F.col("tree")).otherwise(F.floor(pos / FAN)).cast("long").alias("up_pos"),
    ]


def _upper(rows: DataFrame, base: int, tables: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The node rows of all levels from base on, and each tree's last node. rows: tree, height, pos, digest of level base."""
    nodes, tops = [], []
    most = rows.agg(F.max("height")).first()[0] or 0
    while base < most:
        tops.append(rows.where(F.col("height") <= base))
        groups = rows.where(F.col("height") > base).groupBy("tree", "height", F.floor(F.col("pos") / BLOCK).alias("block"))
        groups = groups.agg(F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("l0"))  # BLOCK at most
        groups = tables.stored(_levels(groups, base), "levels")
        for j in range(LEVELS):
            level = F.lit(base + j)
            each = groups.where(F.col("height") > level).select("*", F.posexplode(f"l{j}").alias("i", "digest"))
            each = each.withColumn("pos", F.col("block") * FAN ** (LEVELS - j) + F.col("i"))
            nodes.append(each.select("tree", level.alias("level"), "pos", "digest", _left(F.col(f"l{j}"), F.col("i")).alias("left"), _right(F.col(f"l{j}"), F.col("i")).alias("right"), *_up(level, F.col("pos"))))
        rows = groups.select("tree", "height", F.col("block").alias("pos"), F.get(f"l{LEVELS}", F.lit(0)).alias("digest"))
        base += LEVELS
    for t in tops:
        rows = rows.unionByName(t.select(*rows.columns))
    return nodes, rows


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields in a row: `-` for null, else the value's bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def manifest(docs: DataFrame, found: dict[str, Column], tables: Scratch, fields: tuple[str, ...] = FIELDS, source_col: str = "source") -> Manifest:
    """Builds and stores the trees of docs; fields[0] is the id. found: fields as they are found now, where they differ."""
    own = docs.select(F.col(source_col).alias("source"), F.col(fields[0]).alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"), leaf([found.get(f, F.col(f)) for f in fields]).alias("found"))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.col("leaf"), F.col("found")]
    leaves = placed(tables.stored(own, "leaves"), order, tables.stored)
    sources = leaves.groupBy("source").agg(F.min("place").alias("ahead"), F.count("*").alias("n"))
    sources = tables.stored(placed(sources, [F.col("ahead")], tables.stored, "tree"), "sources")
    trees = sources.select(F.col("source").alias("of"), "tree", "ahead", _height(F.col("n")).alias("height"))
    rows = leaves.join(trees, F.col("source").eqNullSafe(F.col("of"))).withColumn("pos", F.col("place") - F.col("ahead"))
    blocks = rows.groupBy("tree", "height", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "found"))).alias("leaves"))
    blocks = tables.stored(_levels(blocks.withColumn("l0", F.col("leaves.leaf")), 0), "blocks")
    roots = blocks.select("tree", "height", F.col("block").alias("pos"), F.get(f"l{LEVELS}", F.lit(0)).alias("digest"))
    nodes, tops = _upper(roots, LEVELS, tables)
    n_sources = sources.count()
    above = tops.select(F.lit(TOP).cast("long").alias("tree"), _height(F.lit(n_sources)).alias("height"), F.col("tree").alias("pos"), "digest")
    upper, root = _upper(tables.stored(above, "subroots"), 0, tables)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("up_tree", "long"), ("up_level", "int"), ("up_pos", "long"))]
    last = root.select("tree", F.col("height").alias("level"), F.lit(0).cast("long").alias("pos"), "digest", F.lit(b"").alias("left"), F.lit(b"").alias("right"), *none)
    for more in [*nodes, *upper]:
        last = last.unionByName(more)
    return Manifest(blocks, tables.stored(last, "nodes"))


def climb(spark: SparkSession, built: Manifest) -> DataFrame:
    """For each leaf its id, leaf, subroot, root, proof_sha256, folded_root, verified (see proofs())."""
    i, height = F.col("i"), F.col("height")

    def folded(j: int, at: Column, x: Column) -> Column:
        """x, a hash at level j of a leaf, folded up to the block's last level."""
        if j == LEVELS:
            return x
        level, at_j = F.col(f"l{j}"), (at / FAN**j).cast("int")
        return F.when(height > j, folded(j + 1, at, _h(F.concat(_left(level, at_j), x, _right(level, at_j))))).otherwise(x)

    lower = F.lit(b"")
    for j in range(LEVELS):
        level, at_j = F.col(f"l{j}"), (i / FAN**j).cast("int")
        lower = F.concat(lower, F.when(height > j, F.concat(_left(level, at_j), _right(level, at_j))).otherwise(F.lit(b"")))
    start = built.blocks.select("tree", "block", *_up(F.least(height, F.lit(LEVELS)) - 1, F.col("block") * FAN), F.transform("leaves", lambda x, k: folded(0, k, x["found"])).alias("folded"), F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # there are as many rows as blocks at every level
    try:
        reached = stored(spark.sql(CLIMB, blocks=start, nodes=built.nodes), "climb")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
    each = built.blocks.join(reached, ["tree", "block"]).select("*", F.posexplode("leaves").alias("i", "own"))

    def text(digest: Column) -> Column:
        return F.lower(F.hex(digest))

    end = F.get("folded", i)
    return each.select(F.col("own.id").alias("id"), text(F.col("own.leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"), F.sha2(text(F.concat(lower, F.col("proof"))), 256).alias("proof_sha256"), text(end).alias("folded_root"), (end == F.col("root")).alias("verified"))


def proofs(docs: DataFrame, found: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, source_col: str = "source") -> DataFrame:
    """One row per row of docs: its id (fields[0]), leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is built over docs; found says how fields are found later (none: unchanged), and verified whether the
    leaf recomputed from them leads to the root.  A null field is `-`; null sources are one source, the first; rows
    with null ids come first in theirs, rows with equal ids are in the order of their leaves, and repeated rows are a leaf each.
    Empty and long texts are as any other; columns that aren't fields aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark, "merkle") as tables:
        built = manifest(docs, found or {}, tables, fields, source_col)
        out = climb(spark, built)
        return stored(out.withColumnRenamed("id", fields[0]), "proofs")
