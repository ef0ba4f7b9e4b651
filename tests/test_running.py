"""Running aggregates: the bucketed way equals a plain window, also under a hot key."""

import random

from pyspark.sql import functions as F

from emberkeep.operators.running import bucket_count, exact_percentiles, order_bounds, running

def all_kinds():
    return {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "hi": ("max", F.struct("at", "v")), "lo": ("min", F.col("v")),
            "r": ("rank", F.lit(1)), "p": ("prev", F.col("v"))}


def frame(spark, seed):
    rng = random.Random(seed)
    # One key holds about half of the rows and many times repeat.
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(40), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    return spark.createDataFrame(rows, "k string, at long, id long, v long")


def test_bucketed_equals_plain(spark):
    for seed, descending in ((1, False), (2, True)):
        df = frame(spark, seed)
        plain = running(df, ["k"], "at", ["id"], all_kinds(), bounds=[], descending=descending)
        cut = running(df, ["k"], "at", ["id"], all_kinds(), bounds=[3, 7, 8, 20, 33], descending=descending)
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_global_running_sum(spark):
    df = frame(spark, 3)
    plain = running(df, [], "at", ["id"], {"s": ("sum", F.col("v"))}, bounds=[])
    cut = running(df, [], "at", ["id"], {"s": ("sum", F.col("v"))}, bounds=[5, 15, 30])
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_every_table_is_cut_and_larger_ones_more(spark):
    df = frame(spark, 4)
    assert 0 < len(order_bounds(df, "at")) < 8 and order_bounds(df.where("at < 0"), "at") == []
    assert bucket_count(0) < bucket_count(10**6) < bucket_count(10**7)


def test_a_row_shuffles_once(spark):
    """The window and the join read one shuffle of the rows; only totals, added up before, move besides."""
    cut = running(frame(spark, 6), ["k"], "at", ["id"], {"s": ("sum", F.col("v"))}, bounds=[10, 20])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.rindex("ENSURE_REQUIREMENTS") < plan.index("partial_sum")


def test_percentiles_equal_the_exact_aggregate(spark):
    df = frame(spark, 5).where("k is not null")
    got = {r.k: (r.p50, r.p95) for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}
