"""The entry table: literal cases and the ways taken on large inputs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberkeep.operators import similarity as S
from emberkeep.operators import vectors as O

FRUIT, VEHICLE = [1.0, 0.8, 0.1, 0.2], [0.1, 0.2, 0.9, 0.8]
BANANA, ORTHO = [0.9, 0.75, 0.15, 0.1], [0.0, 0.0, 1.0, 0.0]
ENTRY = "id string, embedding array<float>, namespace string, inserted_ms long, expires_ms long, last_accessed_ms long, estimated_bytes long"


def entries(spark, *rows):
    return spark.createDataFrame(
        [(i, v, ns, at, exp, at, 4 * len(v) + 128) for i, v, ns, at, exp in rows], ENTRY)


def shelf(spark):
    return entries(spark, ("fruit", FRUIT, "f", 1, 0), ("banana", BANANA, "f", 2, 0), ("vehicle", VEHICLE, "v", 3, 0))


def ids(df):
    return [r.id for r in df.collect()]


def test_topk_order_and_oversized_k(spark):
    assert ids(O.search_topk(shelf(spark), FRUIT, 3)) == ["fruit", "banana", "vehicle"]
    assert len(ids(O.search_topk(shelf(spark), FRUIT, 100))) == 3
    assert ids(O.search_topk(shelf(spark).limit(0), FRUIT, 5)) == []


def test_threshold_leaves_out_the_far_one(spark):
    assert "vehicle" not in ids(O.search_threshold(shelf(spark), FRUIT, 0.95))


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        O.search_topk(shelf(spark), FRUIT, 0)
    with pytest.raises(ValueError):
        O.search_topk(shelf(spark), [0.0, 0.0], 1)
    with pytest.raises(ValueError):
        O.search_threshold(shelf(spark), FRUIT, 1.5)


def test_dimension_zero_norm_and_expiry(spark):
    df = entries(spark, ("a", FRUIT, "f", 1, 0), ("short", [1.0, 0.0, 0.0], "f", 1, 0), ("zero", [0.0] * 4, "f", 1, 0),
                 ("old", FRUIT, "f", 1, 50), ("edge", FRUIT, "f", 1, 100))
    assert sorted(ids(O.search_topk(df, FRUIT, 9, now_ms=100))) == ["a", "edge"]


def test_ties_break_by_id(spark):
    df = entries(spark, ("c", FRUIT, "f", 1, 0), ("a", FRUIT, "f", 1, 0), ("b", FRUIT, "f", 1, 0))
    assert ids(O.search_topk(df, FRUIT, 2)) == ["a", "b"]


def test_fifo_and_lru(spark):
    rows = [("a", FRUIT, "f", 1, 0), ("b", FRUIT, "f", 2, 0), ("c", FRUIT, "f", 3, 0), ("d", FRUIT, "f", 5, 0)]
    kept, evicted = O.retain_recent(entries(spark, *rows), [], "inserted_ms", 3)
    assert sorted(ids(kept)) == ["b", "c", "d"] and ids(evicted) == ["a"]
    touched = entries(spark, *rows).withColumn("last_accessed_ms", F.when(F.col("id") == "a", 4).otherwise(F.col("last_accessed_ms")))
    assert ids(O.retain_recent(touched, [], "last_accessed_ms", 3)[1]) == ["b"]


def test_memory_ceiling(spark):
    kept, evicted = O.enforce_memory_ceiling(shelf(spark), 350)
    assert sorted(ids(kept)) == ["banana", "vehicle"] and ids(evicted) == ["fruit"]
    assert len(ids(O.enforce_memory_ceiling(shelf(spark), 0)[0])) == 3


def test_flush_splits_the_table(spark):
    kept, summary = O.flush_where(shelf(spark), *O.flush_condition("namespace", "f"))
    assert ids(kept) == ["vehicle"]
    assert tuple(summary.first()) == (2, 288, "flushNamespace(f)")
    null_ns = shelf(spark).withColumn("namespace", F.lit(None).cast("string"))
    assert len(ids(O.flush_where(null_ns, *O.flush_condition("namespace", "f"))[0])) == 3


def test_upsert_last_write_wins(spark):
    batch = entries(spark, ("fruit", BANANA, "x", 8, 0), ("fruit", ORTHO, "y", 9, 0), ("new", ORTHO, "z", 9, 0)).withColumn("seq", F.col("inserted_ms"))
    after, displaced = O.upsert_entries(shelf(spark), batch, "seq")
    assert {r.id: r.namespace for r in after.collect()} == {"fruit": "y", "banana": "f", "vehicle": "v", "new": "z"}
    assert ids(displaced) == ["fruit"]


# --- many queries, joins ------------------------------------------------------


def cloud(spark, n, dim, seed, prefix):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dim))
    data = centers[rng.integers(0, 4, n)] + 0.4 * rng.normal(size=(n, dim))
    rows = [(f"{prefix}{i}", [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    return rows, spark.createDataFrame(rows, "id string, embedding array<float>")


def unit(rows):
    m = np.array([v for _, v in rows])
    return m / np.linalg.norm(m, axis=1)[:, None]


def test_batch_topk_broadcast_and_grid_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 25)
    e_rows, e = cloud(spark, 90, 8, 1, "e")
    q_rows, q = cloud(spark, 60, 8, 2, "q")
    q = q.withColumnRenamed("id", "query_id")
    scores = np.round(unit(q_rows) @ unit(e_rows).T, S.SCORE_DECIMALS)
    want = set()
    for i, (name, _) in enumerate(q_rows):
        best = sorted(range(len(e_rows)), key=lambda j: (-scores[i, j], e_rows[j][0]))[:4]
        want |= {(name, e_rows[j][0], rank + 1) for rank, j in enumerate(best)}
    for limit in (S.QUERY_BYTES_LIMIT, 0):
        got = S.search_topk_batch(e, q, 4, 8, query_bytes_limit=limit).collect()
        assert {(r.query_id, r.id, r["rank"]) for r in got} == want


def test_similarity_join_with_small_blocks_is_exact(spark):
    a_rows, a = cloud(spark, 120, 8, 3, "a")
    b_rows, b = cloud(spark, 80, 8, 4, "b")
    for threshold in (0.2, 0.9):
        scores = np.round(unit(a_rows) @ unit(a_rows).T, S.SCORE_DECIMALS)
        want = {tuple(sorted((a_rows[i][0], a_rows[j][0]))) for i in range(120) for j in range(i) if scores[i, j] >= threshold}
        got = [(r.id_a, r.id_b) for r in S.similarity_join(a, None, threshold, 8, pivots=5, block_rows=15).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        cross = np.round(unit(a_rows) @ unit(b_rows).T, S.SCORE_DECIMALS)
        want = {(a_rows[i][0], b_rows[j][0]) for i in range(120) for j in range(80) if cross[i, j] >= threshold}
        assert {(r.id_a, r.id_b) for r in S.similarity_join(a, b, threshold, 8, pivots=5, block_rows=15).collect()} == want


def clustered(n, dim, seed, spread):
    """Families of near copies around directions of their own, and as many loners."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(n // 20, dim))
    rows = np.concatenate([heads[rng.integers(len(heads), size=n // 2)] + spread * rng.normal(size=(n // 2, dim)), rng.normal(size=(n - n // 2, dim))])
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_few_pairs_are_multiplied():
    for seed, spread in ((1, 0.2), (2, 0.0)):
        rows = clustered(1_200, 64, seed, spread) if spread else np.random.default_rng(seed).normal(size=(1_200, 64))
        rows = rows / np.linalg.norm(rows, axis=1)[:, None]
        turned = rows @ S.leading_rotation(rows[:500])
        for threshold, share in ((0.95, 0.02), (0.8, 0.1)):
            got, _, scores, multiplied = S.block_matches(turned, turned, threshold)
            want = np.round(rows @ rows.T, S.SCORE_DECIMALS) >= threshold
            assert len(got) == want.sum() and multiplied - want.sum() < share * rows.shape[0] ** 2


def test_pivots_prune_families_and_lose_nothing():
    rows = clustered(3_000, 32, 5, 0.05)
    index = S.Pivots(rows[::37])
    home, angle, _ = index.home(rows)
    radius = np.full(len(index.centers), -np.inf)
    np.maximum.at(radius, home, angle)
    reach = np.arccos(0.95)
    visited = index.reachable(rows, reach, radius)
    linked = np.argwhere(rows @ rows.T >= 0.95)
    assert all(home[j] in visited[i] for i, j in linked)
    assert np.allclose(np.arccos(np.clip((rows * index.centers[home]).sum(axis=1), -1, 1)), angle, atol=1e-6)


def test_pivots_follow_the_row_count():
    assert S.pivot_count(10, 64) == S.LEAST_PIVOTS and S.pivot_count(10**8, 64) == 5_000
    assert S.pivot_count(10**14, 64) * 64 * 8 <= S.PIVOT_BYTES


def test_copies_collapse_to_a_representative(spark):
    df = spark.createDataFrame([(f"x{i}", FRUIT) for i in range(50)] + [("y", BANANA)], "id string, embedding array<float>")
    distinct = S.distinct_vectors(df)
    assert {(r.id, r.copies) for r in distinct.collect()} == {("x0", 50), ("y", 1)}
    assert S.similarity_join(distinct, None, 0.9, 4).count() == 1
    assert S.copy_members(df, distinct).where("representative = 'x0'").count() == 50


def test_a_bad_vector_costs_no_other_row(spark):
    """NaN, null elements and zeros in the middle of a batch leave the others' matches alone."""
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("bad", [nan, 1.0]), ("hole", [None, 1.0]), ("zero", [0.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])]
    entries = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = entries.select(F.col("id").alias("query_id"), "embedding").where("id in ('a', 'bad')")
    for limit in (1 << 20, 0):
        got = S.search_topk_batch(entries, queries, 2, 2, query_bytes_limit=limit).collect()
        assert sorted((r.query_id, r["rank"], r.id) for r in got) == [("a", 1, "a"), ("a", 2, "b")]
    assert [(r.id_a, r.id_b) for r in S.similarity_join(entries, None, 0.8, 2).collect()] == [("a", "b")]


def test_a_search_evaluates_its_kernel_once(spark):
    entries = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.9, 0.1], 0)], "id string, embedding array<double>, expires_ms long")
    found = O.search_threshold(entries, [1.0, 0.0], 0.5)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.id for r in found.collect()] == ["a", "b"]


def test_many_queries_multiply_in_bounded_parts():
    rng = np.random.default_rng(9)
    wanted, rows = rng.normal(size=(3_000, 4)), rng.normal(size=(5_000, 4))
    ids, names = np.array([f"e{i:04}" for i in range(5_000)], dtype=object), [f"q{i}" for i in range(3_000)]
    best = S._Best(names, 3)
    tracemalloc.start()
    best.add_all(wanted, ids, rows)
    held = [r for b in best.batches() for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # all scores at once are 120 MB
    want = {(names[q], ids[r]) for q, row in enumerate(np.round(wanted @ rows.T, S.SCORE_DECIMALS)) for r in np.argsort(-row, kind="stable")[:3]}
    assert {(r["query_id"], r["id"]) for r in held} == want and len(held) == 9_000


def test_low_thresholds_go_through_the_grid(spark, monkeypatch):
    monkeypatch.setattr(S, "GRID_ROWS", 30)
    monkeypatch.setattr(S, "PRODUCT_ROWS", 7)
    a_rows, a = cloud(spark, 120, 8, 3, "a")
    b_rows, b = cloud(spark, 80, 8, 4, "b")
    a, b = (df.withColumn("n", F.length("id").cast("long")) for df in (a, b))
    scores = np.round(unit(a_rows) @ unit(a_rows).T, S.SCORE_DECIMALS)
    want = {(*sorted((a_rows[i][0], a_rows[j][0])), scores[i, j]) for i in range(120) for j in range(i) if scores[i, j] >= 0.2}
    joined = S.similarity_join(a, None, 0.2, 8, carry=("n",))
    assert "FlatMapGroupsInArrow" in joined._jdf.queryExecution().toString()
    got = [(r.id_a, r.id_b, r.n_a, r.n_b) for r in joined.collect()]
    assert len(got) == len(set(got)) == len(want) and {x[:2] for x in got} == {x[:2] for x in want}
    assert all((x[2], x[3]) == (len(x[0]), len(x[1])) for x in got)
    cross = np.round(unit(a_rows) @ unit(b_rows).T, S.SCORE_DECIMALS)
    want = {(a_rows[i][0], b_rows[j][0]) for i in range(120) for j in range(80) if cross[i, j] >= 0.2}
    assert {(r.id_a, r.id_b) for r in S.similarity_join(a, b, 0.2, 8).collect()} == want
