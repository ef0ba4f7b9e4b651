"""Rows by their rank in a whole table, without sorting it: counts between sampled keys locate the cut."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CUTS, SAMPLE, FEW = 64, 4_000, 20_000


def sort_key(order: list[str]) -> Column:
    """The order columns as one value; structs compare field by field, nulls first."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])


def key_literal(key: Row, kind: StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind)])


def key_at(df: DataFrame, order: list[str], position: int) -> tuple[Row, StructType, int] | None:
    """The sort key of the row at ``position`` (from 0, ascending), its type, and how many rows have smaller keys; None beyond the table.

    Each round counts the rows below, at and between a few sampled keys and
    goes on with the part that holds the position, until that part is small.
    Every round is one pass that sends a count per part; nothing is sorted but
    the last part.  A key that a third of the rows share is a part of its own
    as soon as a sample meets it.
    """
    keys = df.select(sort_key(order).alias("k"))
    kind = keys.schema["k"].dataType
    left, smaller = keys.count(), 0
    if not 0 <= position < left:
        return None
    part, seed = keys, 0
    while left > FEW:
        seed += 1
        drawn = sorted_keys(part.sample(min(1.0, SAMPLE / left), seed=seed).distinct())
        cuts = drawn[:: -(-len(drawn) // CUTS)] if drawn else []
        if not cuts:
            continue
        held = F.array(*[key_literal(c, kind) for c in cuts])
        place = 2 * F.size(F.filter(held, lambda c: c < F.col("k"))) + F.array_contains(held, F.col("k")).cast("int")
        counts = {r.place: r.n for r in part.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        for here in range(2 * len(cuts) + 1):
            n = counts.get(here, 0)
            if position < smaller + n:
                break
            smaller += n
        number, at_cut = divmod(here, 2)
        if at_cut:
            return cuts[number], kind, smaller
        if number:
            part = part.where(F.col("k") > key_literal(cuts[number - 1], kind))
        if number < len(cuts):
            part = part.where(F.col("k") < key_literal(cuts[number], kind))
        left = n
    for row in part.groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect():  # FEW rows at most
        if position < smaller + row.n:
            return row.k, kind, smaller
        smaller += row.n
    return None


def sorted_keys(keys: DataFrame) -> list[Any]:
    return [r.k for r in keys.orderBy("k").collect()]
