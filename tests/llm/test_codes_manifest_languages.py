"""Vector codes, Merkle manifests and languages against brute force, on odd rows and empty tables."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberkeep.llm.languages import CHUNK, LanguageModel, find_words, fit_languages, identify_languages, label_texts, most_likely_path
from emberkeep.llm.common import text_bytes
from emberkeep.llm.merkle import digest, fold_path, leaf_digest, merkle_manifest, proof_text
from emberkeep.llm.vector_codes import books_sha256, code_vectors, with_label_totals


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain integers and loops: the first entries are the smallest ids', then rounds of nearest entry and floor of the mean."""
    rows = sorted(rows)
    length = len(rows[0][1])
    cut = {i: [[int(np.floor(4096 * x)) for x in v[p * length // parts : (p + 1) * length // parts]] for p in range(parts)] for i, v in rows}
    books = [[cut[i][p] for i, _ in rows[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = {(i, p): nearest(p, cut[i][p])[1] for i in cut for p in range(parts)}
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in cut if chosen[i, p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = {}
    for i in cut:
        best = [nearest(p, cut[i][p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [300, 9])
def test_codes_match_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vectors = [(i * 3, [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(size=(n, 24)))]
    odd = [(5001, None), (5002, []), (5003, [1.0, None] + [0.0] * 22), (5004, [float("nan")] * 24), (5005, [float("-inf")] + [0.0] * 23)]
    rows = [(i, v, None if i % 2 else i % 5, "c", 1) for i, v in vectors + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    coded, books = code_vectors(df)
    got = {r.vec_id: r for r in with_label_totals(coded).collect()}
    want, sha = brute_codes(vectors)
    assert {i: (r.code, r.error) for i, r in got.items()} == want and books_sha256(books) == sha
    labels = {i: label for i, _, label, *_ in rows}
    for i, r in got.items():
        assert r.label_error == sum(want[j][1] for j in want if labels[j] == labels[i])


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    same = [(1, [0.5] * 16, None)] * 40 + [(None, [0.25] * 16, 1), (2, [1e30] * 16, 1), (3, [1.0] * 3, 2)]
    coded, books = code_vectors(spark.createDataFrame(same, schema))
    got = coded.collect()
    assert len(got) == 43 and len(books[0]) == 16 and books[0].max() == 1 << 26
    assert [(r.code, r.error) for r in got if r.vec_id == 3] == [(None, None)]
    assert {r.error for r in got if r.vec_id == 1} == {0} and len({r.code for r in got if r.vec_id == 1}) == 1
    uneven, _ = code_vectors(spark.createDataFrame([(i, [float(i)] * 11, 0) for i in range(5)], schema))
    assert sorted(r.code for r in uneven.collect()) == [f"0{i}" * 8 for i in range(5)]
    none, books = code_vectors(spark.createDataFrame([(1, None, 1)], schema))
    assert with_label_totals(none).collect() == [] and books == []


def brute_manifest(rows, arity, altered):
    """Recursive trees over lists of leaves: (subroot, root, proof, folded root) by id."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(values):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def tree(level):
        """The root, and of each leaf the (before, after) of every level."""
        paths, spot = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for path, at in zip(paths, spot):
                first = at // arity * arity
                path.append(("".join(level[first:at]), "".join(level[at + 1 : first + arity])))
            level, spot = [h(*level[i : i + arity]) for i in range(0, len(level), arity)], [s // arity for s in spot]
        return level[0], paths

    groups = {}
    for values in rows:
        groups.setdefault(values[1], []).append(values)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        mine = sorted(groups[name], key=lambda v: (v[0] is not None, v[0] or 0, leaf(v)))
        trees.append((mine, *tree([leaf(v) for v in mine])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops):
        for values, path in zip(mine, paths):
            whole, folded = path + top, leaf(altered(values))
            for before, after in whole:
                folded = h(before, folded, after)
            out.append((values[0], leaf(values), subroot, root, h(*[b + a for b, a in whole]), folded))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_matches_recursion(spark, arity):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en" if i % 2 else None, i, f"text\n{i}" * (i % 4)) for i in range(170)]
    rows += [(None, None, None, None, None), (3, "hot", "", 0, "é\n"), (3, "hot", "", 0, "é\n"), (7, "", "x", 1, "alone"), (8, "ünï", "x", 1, "\n")] + [(9, "hot", "x", 1, "same")] * 60
    df = spark.createDataFrame([(*r, "t", "h", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, idx int").repartition(6)
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle_manifest(df, arity=arity, carry=leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text))
    got = got.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))), fold_path(F.col("carried"), F.col("path"))).collect()

    def altered(v):
        return (*v[:4], v[4].replace("\n", "") if v[0] is not None and v[0] % 2 == 0 and v[4] is not None else v[4])

    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows, arity, altered)


def test_manifest_of_one_row_and_of_none(spark, odd):
    one = merkle_manifest(odd.where("doc_id = 1").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(3)))
    (row,) = one.collect()
    assert row.leaf == row.subroot == row.root and row.path == []
    empty = merkle_manifest(odd.where("doc_id > 1000"), fields=("doc_id", "text"))
    assert empty.collect() == [] and empty.columns == one.columns


def brute_path(scores, switch):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        top = value.max() - switch
        back.append(np.where(top > value, value.argmax(), np.arange(len(s))))
        value = np.maximum(value, top) + s
    return value.max()


def test_chunked_search_finds_the_best_path():
    rng = np.random.default_rng(5)
    sizes = [1, CHUNK, CHUNK + 1, 0, 5 * CHUNK - 1, 7, 0, 13 * CHUNK]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for k in (1, 2, 5):
        scores = rng.normal(size=(bounds[-1], k))
        path = most_likely_path(scores, bounds, 2.0)
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                mine = path[a:b]
                got = scores[np.arange(a, b), mine].sum() - 2.0 * (np.diff(mine) != 0).sum()
                assert got == pytest.approx(brute_path(scores[a:b], 2.0))


def test_words_are_runs_of_letters():
    texts = ["Ça va? don't", None, "", "12 .. —", "été Ω", "́x"]
    words = find_words(*text_bytes(pa.array(texts)))
    found = [(r, (texts[r])[s:e]) for r, s, e in zip(words.rows, words.starts, words.ends)]
    assert found == [(0, "Ça"), (0, "va"), (0, "don"), (0, "t"), (4, "été"), (4, "Ω"), (5, "́x")]


def test_scripts_narrow_candidates():
    model = LanguageModel(["el", "en", "fr"], np.zeros(1 << 18, np.int32), np.zeros((1, 3)), np.zeros((40, 3), bool))
    model.scripts[1] = [False, True, True]
    model.scripts[2] = [True, False, False]
    langs, scores, spans = label_texts(pa.array(["καλη μερα", "good day", "καλη μερα to you", "да", "7", None]), model)
    assert langs.to_pylist() == ["el", "en", "el", "el", "und", "und"] and scores.to_pylist()[4:] == [0.0, 0.0]
    assert spans.to_pylist()[2] == [{"start": 0, "end": 9, "lang": "el"}, {"start": 10, "end": 16, "lang": "en"}]


def test_held_out_languages(spark, documents):
    model = fit_languages(documents)
    got = identify_languages(documents, model).join(documents.select("doc_id", F.col("lang").alias("said")), "doc_id")
    right = got.where("crc32(cast(doc_id as string)) % 4 = 2").agg(F.avg((F.col("lang") == F.col("said")).cast("double"))).first()[0]
    assert right >= 0.95


def test_mixed_text_has_spans(spark, documents):
    model = fit_languages(documents)
    parts = {r.lang: r.text[:600] for r in documents.where("n_chars > 700").orderBy("doc_id").collect()}
    text = parts["en"] + " " + parts["de"]
    _, _, spans = label_texts(pa.array([text]), model)
    found = spans.to_pylist()[0]
    assert [s["lang"] for s in found] == ["en", "de"] and abs(found[1]["start"] - 600) < 60


def test_languages_of_odd_rows(spark, odd, none, documents):
    model = fit_languages(documents)
    got = identify_languages(odd, model).collect()
    assert len(got) == odd.count()
    assert all(r.lang == "und" and r.score == 0 and r.spans == [] for r in got if r.doc_id in (3, 4, 5))
    assert all(0 < r.score <= 1 for r in got if r.doc_id in (1, 2, 8))
    assert identify_languages(none, model).collect() == []
    untaught = odd.withColumn("lang", F.lit(None).cast("string"))
    assert fit_languages(untaught) is None and {r.lang for r in identify_languages(odd, None).collect()} == {"und"}
    hot = odd.where("doc_id = 1").crossJoin(spark.range(50)).withColumn("lang", F.lit("en"))
    assert fit_languages(hot).languages == ["en"]
