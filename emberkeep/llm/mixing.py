"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.llm.common import staged

WEIGHTS = (5, 2, 1)
LEAST_SUBS = 64
CLASSES_PER_DOUBLING = 8
OFFSETS = 16  # evenly spaced from a random one; the one that takes nearest to the target is used


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` from (source, source_size): one row per source.

    Sources in code-point order, null last, take the weights in turn.  A source
    is full at ``most`` times its size; what it can't take is shared by weight
    among the others.  Sorted by the level at which each is full, a running sum
    gives the level at which the whole is placed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    limits = sources.withColumn("weight", cycle).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = wanted - F.coalesce(F.sum("limit").over(by_level), F.lit(0.0))
    still = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    levels = limits.withColumn("level", left / still).withColumn("fits", F.col("level") <= F.col("limit") / F.col("weight"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, carry: Column | None = None,
) -> DataFrame:
    """How often the mix takes each document: ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``copies``, ``taken``.

    Every document of a source is expected ``target / source_size`` times.  The
    documents of a source stand in order of size class, a hash of the id and
    the id; expected copies are summed along that order from one random offset
    per source, and a document is taken once per integer that its step
    crosses.  Sizes nearly ascend, so the words taken stay near the target; of
    a few evenly spaced offsets the one that comes nearest is used.

    One row per input row.  A null source is a source of its own, a null text
    has no words; sources without words have target 0.  Rows that repeat an id
    are documents of their own; ``carry`` is one more column to bring along.
    Reruns agree: every draw is a hash of the id, the source and ``seed``.

    The running sum has three levels (classes of a source, hash slots of a
    class, documents of a slot), so a source that holds most rows is dealt by
    slot.  The slots follow the square root of the row count.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")]
    sized = staged(docs.select(*columns), "sizes")
    subs = max(LEAST_SUBS, math.isqrt(sized.count()))
    spot = ["source", "class", "sub"]
    place = {
        "class": F.floor(CLASSES_PER_DOUBLING * F.log2(F.col("size") + 1)).cast("int"),
        "sub": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(subs)).cast("int"),
    }
    slots = staged(sized.withColumns(place).groupBy(*spot).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "slots")
    classes = slots.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, most).withColumnRenamed("source", "name")

    def before(*keys: str, by: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    starts = classes.withColumn("class_start", before("source", by="class")).join(targets, F.col("source").eqNullSafe(F.col("name")))
    starts = starts.select(F.col("source").alias("name"), F.col("class").alias("name_class"), "class_start", "source_size", "target")
    slots = slots.withColumn("slot_start", before("source", "class", by="sub"))
    slots = slots.join(starts, F.col("source").eqNullSafe(F.col("name")) & (F.col("class") == F.col("name_class")))
    slots = slots.select(
        F.col("source").alias("in_source"), F.col("class").alias("in_class"), F.col("sub").alias("in_sub"),
        (F.col("class_start") + F.col("slot_start")).alias("start"), "source_size", "target",
    )
    def ranked(base: DataFrame, slots: DataFrame) -> DataFrame:
        on = F.col("source").eqNullSafe(F.col("in_source")) & (F.col("class") == F.col("in_class")) & (F.col("sub") == F.col("in_sub"))
        rank = F.col("start") + F.row_number().over(Window.partitionBy(*spot).orderBy("doc_id", "size")) - 1
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        return base.withColumns(place).join(slots, on).withColumn("rank", rank).withColumn("rate", rate)

    def copies(offset: Column) -> Column:
        return (F.floor(F.col("rate") * (F.col("rank") + 1) + offset) - F.floor(F.col("rate") * F.col("rank") + offset)).cast("long")

    slots = staged(slots, "starts")
    draw = F.pmod(F.xxhash64("source", F.lit(seed), F.lit("offset")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    tries = [draw + F.lit(i / OFFSETS) - F.floor(draw + F.lit(i / OFFSETS)) for i in range(OFFSETS)]
    sums = ranked(sized, slots).groupBy("source", "class").agg(F.max("target").alias("target"), *[F.sum(F.col("size") * copies(t)).alias(f"t{i}") for i, t in enumerate(tries)])
    sums = sums.groupBy("source").agg(F.max("target").alias("target"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(OFFSETS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")), t.alias("offset")) for i, t in enumerate(tries)]))
    offsets = sums.select(F.col("source").alias("name"), nearest["offset"].alias("offset"))
    slots = staged(slots.join(offsets, F.col("in_source").eqNullSafe(F.col("name"))).drop("name"), "offsets")

    base = sized if carry is None else docs.select(*columns, carry.alias("carried"))
    out = ranked(base, slots).withColumn("copies", copies(F.col("offset")))
    shown = ["doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return out.select(*shown, *([] if carry is None else ["carried"]))
