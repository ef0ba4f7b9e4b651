"""Merkle manifest of a table: leaves of rows, one tree a group, one tree over the groups, and each row's proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.llm.common import staged

LOCAL = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its partition in the lower 33 bits


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def proof_text(path: Column) -> Column:
    """The hex digests of a path's siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))), "")


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: digest(_hex(p["before"]), h, _hex(p["after"])))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place in their ``tree``, and ``size``, the tree's rows.

    One sorted shuffle by (tree, order) cuts any tree, also one that holds most
    rows, into ranges; a row's place is what earlier ranges hold of its tree
    plus its place in its own.
    """
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL))
    placed = staged(ranged.withColumns({"part": F.spark_partition_id(), "at": at}), "placed")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A tree has one run a range at most, so these windows stay as small as the number of ranges.
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("tree").alias("in_tree"), F.col("part").alias("in_part"), (before - F.col("first")).alias("offset"), F.sum("n").over(tree).alias("size"))
    on = (F.col("tree") == F.col("in_tree")) & (F.col("part") == F.col("in_part"))
    return placed.join(runs, on).withColumn("idx", F.col("offset") + F.col("at")).drop("in_tree", "in_part", "part", "at", "offset", *[c for c in order if c == "spread"])


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``before`` and ``after``: the digests of the run's other nodes on either side, by one self-join a shift."""
    slot = F.col("idx") % arity
    out, shown = nodes, nodes.columns
    for shift in range(1, arity):
        place = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        side = nodes.select(F.col("tree").alias(f"tree_{shift}"), F.col("idx").alias(f"idx_{shift}"), F.col("hash").alias(f"hash_{shift}"))
        out = out.join(side, (F.col("tree") == F.col(f"tree_{shift}")) & (place == F.col(f"idx_{shift}")), "left")
    others = F.array(*[F.coalesce(F.col(f"hash_{shift}"), F.lit(b"")) for shift in range(1, arity)])

    def at(position: int) -> Column:
        return F.element_at(others, F.when(slot == position, F.lit(1)).otherwise((F.lit(position + arity) - slot) % arity).cast("int"))

    sides = [(p, F.concat(*[F.when(test(p), at(p)).otherwise(F.lit(b"")) for p in range(arity)])) for p, test in (("before", lambda p: slot > p), ("after", lambda p: slot < p))]
    return out.select(*shown, *[column.alias(name) for name, column in sides])


def _climb(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees at once, staged: every node with its siblings; a tree ends with its node of ``size`` 1."""
    most = leaves.agg(F.max("size").alias("n")).first().n
    levels: list[DataFrame] = []
    nodes = leaves
    while most is not None:
        levels.append(staged(_with_siblings(nodes, arity), f"level{len(levels)}"))
        if most <= 1:
            break
        first = levels[-1].where((F.col("size") > 1) & (F.col("idx") % arity == 0))
        parent = F.unhex(digest(_hex(F.col("hash")), _hex(F.col("after"))))
        nodes = first.select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), parent.alias("hash"))
        most = -(-most // arity)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """``tree`` and ``hash`` of every tree's last node."""
    out = None
    for level in levels:
        ended = level.where("size = 1").select("tree", "hash")
        out = ended if out is None else out.unionByName(ended)
    return out


def _descend(levels: list[DataFrame], arity: int, tops: DataFrame) -> DataFrame:
    """The first level with ``top`` and ``path``: from each tree's last node down, a node's own siblings before its parent's path."""
    above = None
    for level in reversed(levels):
        here = F.array(F.struct("before", "after"))
        ended = level.where("size = 1").join(tops.withColumnRenamed("tree", "of"), F.col("tree") == F.col("of")).drop("of")
        if above is not None:
            parents = above.select(F.col("tree").alias("of"), F.col("idx").alias("parent"), "top", "path")
            on = (F.col("tree") == F.col("of")) & (F.expr(f"idx div {arity}") == F.col("parent"))
            inner = level.where("size > 1").join(parents, on).withColumn("path", F.concat(here, "path")).drop("of", "parent")
            ended = ended.unionByName(inner)
        above = ended
    return above


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", order_col: str = "doc_id",
    arity: int = 3, carry: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root`` (hex) and ``path`` of every row; ``path`` holds the digests before and after it, as bytes, from its run up to the root.

    The rows of a group, in order of ``order_col``, are the leaves of its tree:
    of the nodes of a level every ``arity`` consecutive ones become the digest
    of their digests, the last run having fewer, until one is left.  Those
    ends, in order of the group (null first, then by UTF-8 bytes), likewise
    give the root.  Each level is an equijoin of its nodes with the computed
    places of their siblings (``idx`` XOR 1 for two, shifted slots for more);
    the rows of slot zero emit the parents.  Levels are staged, and hold a
    third of the one below, so all of them cost half as much again as the first.

    A null field is part of the leaf as ``-``, an empty one as ``0:``.  A null
    id comes before all others; rows that repeat an id stand in order of their
    leaves, and equal rows are leaves of their own.  An empty table gives no
    rows.  Other columns aren't read, but ``carry`` is one more to bring along.
    """
    if arity < 2:
        raise ValueError("a run needs two nodes at least")
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    more = [] if carry is None else [carry.alias("carried")]
    leaves = docs.select(tree.alias("tree"), F.col(order_col).alias("doc_id"), F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("hash"), *more)
    # Rows alike in all of these are told apart by where they were read, so a row repeated a million times still spreads over the ranges.
    leaves = staged(leaves, "leaves").withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    levels = _climb(_numbered(leaves, ["doc_id", "hash", "spread"]), arity)
    shown = ["doc_id", _hex(F.col("hash")).alias("leaf"), _hex(F.col("top")).alias("subroot")]
    if not levels:
        none = leaves.select("*", F.lit(b"").alias("top"), F.array(F.struct(F.lit(b"").alias("before"), F.lit(b"").alias("after"))).alias("path"))
        return none.select(*shown, F.lit("").alias("root"), "path", *["carried"] * len(more)).where("false")
    ends = staged(_roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), "ends")
    upper = _climb(_numbered(ends, ["name"]), arity)
    root = _roots(upper).first().hash
    no_path = F.array().cast("array<struct<before:binary,after:binary>>")
    whole = ends.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(bytes(root)).alias("top"), no_path.alias("path"))
    tops = staged(_descend(upper, arity, whole).select(F.col("name").alias("tree"), F.col("hash").alias("top"), "path"), "tops")
    rows = _descend(levels, arity, tops)
    return rows.select(*shown, F.lit(bytes(root).hex()).alias("root"), "path", *["carried"] * len(more))
