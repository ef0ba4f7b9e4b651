"""Connected components of an edge table: contraction inside tasks, then large-star and small-star steps across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import staged

EDGES_PER_TASK = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as a star around the least node of each component that it can see."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row.n, row.x


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): a written table, so that the join with it can split a node with very many edges."""
    return staged(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't the least of its component.

    Each task first contracts up to ``per_task`` edges to stars; where one task
    holds all, that is the answer.  Otherwise stars are joined by grouped
    minima, which combine before the shuffle, and joins, until nothing changes.
    Self loops, repeated edges and nulls are ignored.
    """
    real = staged(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    tasks = max(1, -(-real.count() // per_task))
    now = staged(real.repartition(tasks).mapInArrow(_contract, "u long, v long"), "stars")
    seen = _fingerprint(now) if tasks > 1 else (0, None)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large")
        least = _least_neighbour(large)
        hooked = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(hooked.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
