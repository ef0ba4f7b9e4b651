"""URL filter and vector operators against brute force, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberkeep.llm.components import components
from emberkeep.llm.queries import URL_RULES
from emberkeep.llm.rotated_codes import encode, estimates, units
from emberkeep.llm.url_reputation import filter_urls, host_reputation
from emberkeep.llm.vector_dedup import near_duplicate_vectors, table_plan
from emberkeep.llm.vector_search import nearest_neighbours


def test_urls_are_cut_and_ruled(spark):
    urls = [
        "HTTP://WWW.Example.ORG/es/1?q", "http://example.org/en/1#x", "http://example.org/en/2", "http://a.com/fr/1", "http://b.com/de/", "http://notexample.org", None, "", "no scheme",
        "x://h?p/q", "http://É.net/a", "http://xcom/de/1", "http://b.com/de/",
    ]
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(rows, URL_RULES).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][:3] == ("notexample.org", "", None) and got[9][:2] == ("h", "") and got[10][:3] == ("É.net", "/a", None) and got[11][2] is None
    assert all(got[i] == ("", "", None, "allow") for i in (6, 7, 8)) and len(got) == len(urls)
    assert filter_urls(rows.where("page_id > 99"), URL_RULES).collect() == []


def test_reputation_shrinks_and_bad_hosts_fall(spark):
    counts = [("bad.one.com", 0, 400), ("good.one.com", 395, 400), ("new.one.com", 0, 0), ("few.one.com", 0, 1), ("a.b.co.uk", 3, 4)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(counts, "host string, good long, n long")).collect()}
    assert got["bad.one.com"].upper < 0.5 < got["good.one.com"].reputation
    assert got["few.one.com"].upper >= 0.5 and 0 < got["few.one.com"].reputation < got["new.one.com"].reputation


def cloud(seed=1, n=260, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:60] + rng.normal(size=(60, dim)) * 0.25
    chain = [base[0]]
    for _ in range(20):
        chain.append(chain[-1] + rng.normal(size=dim) * 0.3)
    return np.concatenate([base, near, base[:15] * 3, np.array(chain), np.tile(base[5], (30, 1))])


def frame(spark, vectors, odd=()):
    rows = [(i, [float(x) for x in v], "n") for i, v in enumerate(vectors)] + [(None if i is None else i, v, "n") for i, v in odd]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")


ODD = [(9001, None), (9002, [0.0] * 24), (9003, [1.0, None] + [0.0] * 22), (9004, [float("nan")] * 24), (9005, [float("inf")] + [0.0] * 23), (9006, [1.0, 2.0]), (9007, []), (None, [1.0] * 24)]


def test_near_duplicate_vectors_match_brute_force(spark):
    df = frame(spark, cloud(), ODD)
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in df.where("vec_id < 9000").collect()}
    ids = sorted(vectors)
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(ids))
    for _ in ids:
        root = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1))
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    assert all((got[i].n_links, got[i].component_id) == (linked[k].sum(), root[k]) for k, i in enumerate(ids))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in ODD if i is not None)
    assert got[None].component_id is None and len(got) == df.count()
    assert near_duplicate_vectors(df.where("vec_id < 0")).collect() == []


def test_tables_follow_the_row_count():
    assert table_plan(0, 0.95)[0] < table_plan(10**6, 0.95)[0] < table_plan(10**9, 0.95)[0]


def test_nearest_neighbours_match_brute_force(spark):
    df = frame(spark, cloud(3), ODD)
    got: dict[int, list] = {}
    for r in nearest_neighbours(df, df.where(F.col("vec_id") % 20 == 0), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.where("vec_id < 9000").collect()}
    for q in [i for i in rows if i % 20 == 0]:
        want = sorted((-float(rows[i] @ rows[q]), i) for i in rows if i != q)[:20]
        assert [v for _, v, _ in sorted(got[q])] == [i for _, i in want]
        assert all(abs(s - rows[v] @ rows[q]) < 1e-9 for _, v, s in got[q])
    assert set(got) == {i for i in rows if i % 20 == 0}
    assert nearest_neighbours(df.where("vec_id < 3"), df.where("vec_id = 0"), k=20).count() == 2
    assert nearest_neighbours(df.where("vec_id < 0"), df, k=20).collect() == []


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(7)
    rows, queries = units(rng.normal(size=(800, 64)))[0], units(rng.normal(size=(50, 64)))[0]
    codes, fit = encode(rows)
    cosine, error = estimates(codes, fit, queries)
    off = cosine - rows @ queries.T
    assert abs(off.mean()) < 0.005 and (np.abs(off) <= error[:, None]).mean() > 0.999


@pytest.mark.parametrize("per_task", [1_000, 25])
def test_components_of_chains_stars_and_loops(spark, per_task):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = spark.createDataFrame([*chain, *[(5, i) for i in range(6, 40)], (7, 7), (300, 301), (301, 300)], "a long, b long")
    got = {r.node: r.root for r in components(edges, per_task).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 5 for i in range(6, 40)}, 301: 300}
    assert components(edges.where("a < 0")).collect() == []
