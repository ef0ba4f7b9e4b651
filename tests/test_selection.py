"""Rows by rank, webhook signatures from key columns, and vectors that hold no finite numbers."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from emberkeep.functions import register, security
from emberkeep.functions import versions as V
from emberkeep.operators import artefacts as A
from emberkeep.operators import logs as L
from emberkeep.operators import selection
from emberkeep.operators import vectors as O


@pytest.fixture
def small_parts(monkeypatch):
    """Rounds of counting also for small tables."""
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "SAMPLE", 40)
    monkeypatch.setattr(selection, "CUTS", 5)


def test_keys_by_rank_match_a_sort(spark, small_parts):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, rng.randrange(300)]), rng.choice(["a", None, "b"]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "x int, s string, i long").repartition(4)
    ranked = sorted(rows, key=lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r[:2]))
    for position in (0, 1, 350, 698, 699):
        key, _, smaller = selection.key_at(df, ["x", "s"], position)
        assert tuple(key) == ranked[position][:2]
        assert smaller == next(i for i, r in enumerate(ranked) if r[:2] == ranked[position][:2])
    assert selection.key_at(df, ["x"], 700) is None and selection.key_at(df.limit(0), ["x"], 0) is None


def test_deep_pages(spark, small_parts):
    df = spark.range(1_000).select((F.col("id") % 7).alias("g"), "id").repartition(5)
    rows = sorted((i % 7, i) for i in range(1_000))
    for page in (1, 2, 9, 10):
        got = [(r.g, r.id, r.total, r.pages) for r in A.paginate(df, ["g", "id"], page, 100).collect()]
        assert got == [(*r, 1_000, 10) for r in rows[(page - 1) * 100 : page * 100]]
    assert A.paginate(df, ["g", "id"], 11, 100).collect() == []
    assert len(A.paginate(df, ["g"], 5, 100).collect()) == 100


@pytest.mark.parametrize("n", [0, 1, 333, 500, 5_000])
def test_retention_over_all(spark, small_parts, n):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("at")).repartition(4)
    kept, evicted = O.retain_recent(df, [], "at", n)
    newest = sorted(((i * 37 % 101, i) for i in range(500)), reverse=True)[:n]
    assert sorted(r.id for r in kept.collect()) == sorted(i for _, i in newest)
    assert kept.count() + evicted.count() == 500
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "Join" not in plan


def test_signatures_of_many_hooks(spark):
    secrets = {f"h{i}": "k" * (i % 150) + str(i) for i in range(20_000)}
    hooks = spark.createDataFrame([(h, ["e", "e"] if h == "h7" else [h], True, s) for h, s in secrets.items()] + [("off", ["e"], False, "x"), ("bare", ["e"], True, None)],
                                  "hook_id string, events array<string>, enabled boolean, secret string")
    events = spark.createDataFrame([("e", "a1", 5), ("h149", "a2", 6), ("h19999", "a3", 7)], "event string, artefact_id string, at_ms long")
    matched = L.match_webhooks(events, hooks)
    got = {(r.hook_id, r.event): (r.payload, r.signature) for r in matched.collect()}
    assert set(got) == {("h7", "e"), ("bare", "e"), ("h149", "h149"), ("h19999", "h19999")}
    for (hook, _), (payload, signature) in got.items():
        want = None if hook == "bare" else "hmac:" + hmac.new(secrets[hook].encode(), payload.encode(), hashlib.sha256).hexdigest()
        assert signature == want
    assert "CaseWhen" not in matched._jdf.queryExecution().logical().toString()


def test_key_columns_and_literal_keys_sign_alike(spark):
    keys = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(200))]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    got = [r.s for r in df.select(security.sign_with(F.lit("message é"), security.hmac_pads(F.col("k"))).alias("s")).collect()]
    assert got == ["hmac:" + hmac.new(k, "message é".encode(), hashlib.sha256).hexdigest() for k in keys]


def test_vectors_without_finite_numbers_never_match(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [inf, 0.0]), ("d", [nan, 1.0]), ("e", [0.0, 0.0]), ("f", [-inf, inf]), ("g", [None, 1.0]), ("h", None), ("i", [3e38, 3e38])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert [(r.id, r.score) for r in O.search_topk(df, [1.0, 0.0], 9).collect()] == [("a", 1.0), ("b", 0.707106781), ("i", 0.707106781)]
    assert [r.id for r in O.search_threshold(df, [1.0, 0.0], 0.9).collect()] == ["a"]


def test_sql_names_agree_with_columns(spark):
    register.register_functions(spark)
    texts = ["1.0.0-alpha.2", "1.0.0-alpha.10", "1.0.0-alpha", "1.0.0-alpha.beta", "1.0.0", "2.10.3", "2.9.3", "99999999999999999999.0.0", "x", "1.2", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    both = df.select(V.semver(F.col("s")).alias("c"), F.expr("semver(s)").alias("q")).collect()
    assert all(r.c == r.q for r in both)
    assert spark.sql("select semver('1.0.0-alpha.10') > semver('1.0.0-alpha.2') as x").first().x
    refs = spark.createDataFrame([(t,) for t in ["ns/a@1.2", "a", "/a", "ns/", "a@x", "a@1.0.0-rc.1", None, "ns/b/c@"]], "s string")
    assert all(r.c == r.q for r in refs.select(V.parse_artefact_ref(F.col("s")).alias("c"), F.expr("parse_artefact_ref(s)").alias("q")).collect())
    numbers = spark.createDataFrame([(d,) for d in [0.0, -0.0, 1.5, 1e300, float("nan"), float("-inf"), None, -2e-7]], "d double")
    from emberkeep.functions import text

    assert all(r.c == r.q for r in numbers.select(text.line_number(F.col("d")).alias("c"), F.expr("line_number(d)").alias("q")).collect())


def test_a_hot_event_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "EVENT_ROWS", 20)
    monkeypatch.setattr(L, "HOOK_ROWS", 10)
    events = spark.createDataFrame([("hot", f"a{i}", i) for i in range(200)] + [("unheard", "b", 1)], "event string, artefact_id string, at_ms long")
    hooks = spark.createDataFrame([(f"h{i}", ["hot", "never"], True, f"s{i}") for i in range(40)], "hook_id string, events array<string>, enabled boolean, secret string")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = L.match_webhooks(events, hooks).select("hook_id", "artefact_id", F.spark_partition_id().alias("task")).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert {(r.hook_id, r.artefact_id) for r in got} == {(f"h{i}", f"a{j}") for i in range(40) for j in range(200)}
    assert len(got) == 8_000 and len({r.task for r in got}) > 1


def test_matches_of_small_tables_spread_over_tasks(spark):
    """AQE, which goes by the bytes that meet and not by the matches they make, leaves the tasks alone."""
    events = spark.range(0, 3_000, 1, 1).select(F.lit("hot").alias("event"), F.concat(F.lit("a"), "id").alias("artefact_id"), F.col("id").alias("at_ms"))
    hooks = spark.range(0, 300, 1, 1).select(F.concat(F.lit("h"), "id").alias("hook_id"), F.array(F.lit("hot")).alias("events"), F.lit(True).alias("enabled"), F.lit("s").alias("secret"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        matched = L.match_webhooks(events, hooks).select(F.spark_partition_id().alias("task"), "artefact_id", "hook_id")
        rows = matched.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("artefact_id", "hook_id").alias("pairs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum(r.n for r in rows) == sum(r.pairs for r in rows) == 900_000
    assert len(rows) > 3 and max(r.n for r in rows) < 600_000
