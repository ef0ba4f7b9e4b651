"""Running aggregates and exact percentiles that no hot key can pile into one task.

A plain window sends a whole key to one task.  Here the order column is cut at
fixed points, more of them the more rows there are; rows shuffle once by (key,
bucket), per-bucket totals (a few rows per key) give each bucket its offset, and
the window only runs inside a bucket.  Tables of all sizes go this way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BUCKETS, MOST_BUCKETS = 8, 1_024  # the cut points are literals of the plan

Aggs = dict[str, tuple[str, Column]]
FOLD = {"sum": F.sum, "count": F.sum, "rank": F.sum, "max": F.max, "min": F.min}


def bucket_count(rows: int) -> int:
    """A quarter of the square root of the row count, within what a plan holds."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, math.isqrt(rows) // 4))


def order_bounds(df: DataFrame, order: str, buckets: int | None = None) -> list[int | float]:
    """Cut points of the order column, as many as the row count asks for.

    They become literals, so every later evaluation of a row, also a repeated
    one after a lost executor, puts it in the same bucket.
    """
    buckets = buckets or bucket_count(df.count())
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return sorted(set(df.agg(F.percentile_approx(order, points, F.lit(4 * MOST_BUCKETS)).alias("p")).first().p or []))


def _bucket(order: str, bounds: list) -> Column:
    """How many cut points lie below the value, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(0)

    def descend(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) > F.lit(bounds[middle]), descend(middle + 1, high)).otherwise(descend(low, middle))

    return descend(0, len(bounds))


def _within(part: list[str], order: str, ties: list[str], aggs: Aggs, descending: bool) -> dict[str, Column]:
    """The running columns inside one window partition."""
    direction = F.desc if descending else F.asc
    ordered = Window.partitionBy(*part).orderBy(direction(order), *[direction(t) for t in ties])
    local = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*part).orderBy(direction(order))
    out = {}
    for name, (kind, _) in aggs.items():
        value = F.col(f"__in_{name}")
        if kind == "rank":
            out[name] = F.rank().over(peers).cast("long")
        elif kind == "prev":
            out[name] = F.lag(F.struct(value.alias("v"))).over(ordered)
        else:
            out[name] = FOLD[kind](value).over(local)
    return out


def running(
    df: DataFrame, keys: list[str], order: str, ties: list[str], aggs: Aggs,
    bounds: list | None = None, descending: bool = False,
) -> DataFrame:
    """Add running ``sum`` / ``count`` / ``max`` / ``min`` / ``rank`` / ``prev`` columns per key.

    ``aggs`` maps an output name to (kind, expression).  The frame runs from
    the start of the key to the row itself; ``descending`` reverses the order;
    ``prev`` is the value on the row before.  The order column must be a number
    and not null, and ``ties`` should make the order total.  Pass ``bounds``
    (``order_bounds`` of the base table) where ``df`` is costly to read twice.
    """
    bounds = order_bounds(df, order) if bounds is None else bounds
    inputs = {n: (F.lit(1) if kind in ("count", "rank") else expr) for n, (kind, expr) in aggs.items()}
    staged = df.withColumns({f"__in_{n}": e for n, e in inputs.items()})
    staged = staged.withColumn("__bucket", _bucket(order, bounds))
    # Key and bucket as one text that is never null: rows shuffle by it once, for the window and the join.
    staged = staged.withColumn("__spot", F.to_json(F.struct(*keys, "__bucket")))
    position = F.struct(order, *ties)
    ends_with = F.min_by if descending else F.max_by

    def total(name: str, kind: str) -> Column:
        value = F.col(f"__in_{name}")
        return ends_with(F.struct(value.alias("v")), position) if kind == "prev" else FOLD[kind](value)

    totals = staged.groupBy("__spot", *keys, "__bucket").agg(*[total(n, k).alias(f"__t_{n}") for n, (k, _) in aggs.items()])
    direction = F.desc if descending else F.asc
    before = Window.partitionBy(*keys).orderBy(direction("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__spot").alias("__s"),
        *[FOLD.get(k, F.last)(f"__t_{n}").over(before).alias(f"__o_{n}") for n, (k, _) in aggs.items()],
    )
    local = staged.repartition("__spot").withColumns({f"__w_{n}": c for n, c in _within(["__spot"], order, ties, aggs, descending).items()})
    added = []
    for name, (kind, _) in aggs.items():
        here, offset = F.col(f"__w_{name}"), F.col(f"__o_{name}")
        if kind == "prev":
            value = F.coalesce(here, offset)["v"]
        elif kind in ("max", "min"):
            wins = here > offset if kind == "max" else here < offset
            value = F.when(offset.isNull() | wins, here).otherwise(offset)
        else:
            value = F.when(offset.isNull(), here).otherwise(offset + F.coalesce(here, F.lit(0)))
        added.append(value.alias(name))
    return local.join(offsets, F.col("__spot") == F.col("__s"), "left").select(*df.columns, *added)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], bounds: list | None = None) -> DataFrame:
    """Interpolated percentiles per key from a histogram of distinct values.

    The histogram combines on the map side; ranks come from the running count,
    so no group is ever held in memory the way an exact percentile buffer is.
    """
    held = df.where(F.col(value).isNotNull())
    bounds = order_bounds(held, value) if bounds is None else bounds
    hist = held.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    cum = running(hist, keys, value, [], {"__upto": ("sum", F.col("__n"))}, bounds)
    total = hist.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    renamed = total.select(*[F.col(k).alias(f"__p_{k}") for k in keys], "__total")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in keys])
    ranked = cum.join(renamed, on)

    def position(q: float) -> Column:
        return F.lit(q) * (F.col("__total") - 1)

    picks = []
    for name, q in points.items():
        picks.append(F.min(F.when(F.col("__upto") > F.floor(position(q)), F.col(value))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("__upto") > F.ceil(position(q)), F.col(value))).alias(f"__hi_{name}"))
    got = ranked.groupBy(*keys).agg(F.first("__total").alias("__total"), *picks)
    out = []
    for name, q in points.items():
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (high - low) * (position(q) - F.floor(position(q)))).alias(name))
    return got.select(*keys, *out)
