"""Operators on documents against brute force, and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberkeep.llm.bottomk import bottomk_near_duplicates
from emberkeep.llm.lexicon_bpe import Transducer, WordBpe, build_lexicon, encode_words
from emberkeep.llm.mixing import mix_sources
from emberkeep.llm.notices import NOTICES, PHRASES, Notice, scan_notices, scan_text
from emberkeep.llm.suffix_dedup import remove_repeats, repeated_windows, suffix_ranks
from emberkeep.llm.toxicity import fit_toxicity, held_out, score_toxicity
from emberkeep.llm.wavelet import WaveletMatrix, read_shards, token_counts, write_shards
from pyspark.sql import functions as F

from .conftest import ODD, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def groups(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(documents, size):
    want = groups(texts_of(documents), size)
    got = bottomk_near_duplicates(documents, words=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_family_of_chained_copies_is_one_component(spark):
    """Each copy changes its predecessor a little: neighbours link, the ends don't; rounds and the final pairs find it all."""
    rng = np.random.default_rng(4)
    words, rows = [f"w{i}" for i in rng.integers(0, 10_000, 120)], []
    for i in range(90):
        words = list(words)
        for at in rng.integers(0, 120, 3):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in bottomk_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {i: c for i, (_, c) in groups(rows, 2).items()}


def test_near_duplicates_of_odd_rows(odd, none):
    got = bottomk_near_duplicates(odd, words=2).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[7].component_id == 6
    assert [by_id[i].n_shingles for i in (3, 4, 5)] == [0, 0, 0] and all(by_id[i].kept for i in (3, 4, 5))
    assert by_id[None].component_id is None and by_id[None].kept and by_id[8].n_shingles == 1
    assert bottomk_near_duplicates(none).collect() == []


def cut_by_hand(rows, length):
    first, out = {}, {}
    for i, text in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(text))
        for j in range(len(text) - length + 1):
            if first.setdefault(text[j : j + length], i) != i:
                gone[j : j + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = bytes(b for b, g in zip(text, gone) if not g), spans
    return out


@pytest.mark.parametrize("length", [50, 150])
def test_repeats_match_brute_force(documents, length):
    want = cut_by_hand(texts_of(documents), length)
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in remove_repeats(documents, length=length).collect()}
    assert got == want


def test_suffix_ranks_order_any_string():
    rng = np.random.default_rng(1)
    for _ in range(60):
        letters, need = rng.integers(0, rng.integers(1, 5), rng.integers(1, 300)).astype(np.uint8), int(rng.integers(1, 60))
        order = np.argsort(suffix_ranks(letters.astype(np.int64), need), kind="stable")
        raw = letters.tobytes() + b"\0" * 64
        heads = [raw[i : i + need] for i in order]
        assert heads == sorted(heads)


def test_repeated_windows_need_a_smaller_owner():
    data = np.frombuffer(b"ab" * 40 + b"ab" * 40, np.uint8)
    is_window = np.zeros(160, bool)
    is_window[[0, 80]] = True
    assert repeated_windows(data, is_window, np.array([5, 3]), 50).tolist() == [True, False]


def test_repeats_of_odd_rows(odd, none):
    got = remove_repeats(odd).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and bytes(by_id[None].kept) == b"a text without an id of its own"
    # Document 2 differs from 1 in its first letter; its own copy doesn't remove it.
    assert bytes(by_id[2].kept) == b"T" and [bytes(by_id[i].kept) for i in (3, 4)] == [b"", b""]
    assert len(by_id[8].kept) == 150_000 and len(by_id[9].kept) == 200_000  # repeats inside a document stay
    assert remove_repeats(none).collect() == []


def test_notices_match_brute_force(documents):
    splitter = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in scan_notices(documents).collect()}
    for i, text in texts_of(documents):
        words = splitter.findall(lower(text))
        at, labels = [], set()
        for phrase, label in PHRASES:
            seek = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(seek)] == seek]
            at += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_every_notice_within_its_edits_is_found():
    rng = np.random.default_rng(3)
    for notice in NOTICES:
        for _ in range(20):
            letters = list(notice.words)
            for _ in range(notice.edits):
                at = int(rng.integers(1, len(letters) - 1))
                lone = letters[at] == " " or (letters[at - 1] == " " and letters[at + 1] == " ")
                kind = 1 if lone else int(rng.integers(0, 3))  # blanks never double, that would be an edit more
                letters[at : at + 1] = [[], ["q"], [letters[at], "q"]][kind]
            found = scan_text(("filler words " + "".join(letters) + " more words").encode())
            assert notice.label in found["labels"].split(","), "".join(letters)
    assert scan_text(b"nothing to see here")["score"] == 0.0
    assert sum(len(s) for _, s in Notice("x", "abcdefghij", 2).seeds()) == 10


def test_notices_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in scan_notices(odd).collect()}
    assert got[3].n_words == 0 and got[3].labels == "" and got[3].score == 0.0 and got[3].first_word is None
    assert (got[11].n_base, got[11].first_word, got[11].base_labels) == (4, 2, "cc-by,reserved")
    assert scan_notices(none).collect() == []


def test_toxicity_learns_words_and_misspellings(spark):
    rng = np.random.default_rng(2)
    clean, rude = [f"word{i}" for i in range(400)], ["scumbag", "worthless", "pathetic"]
    docs, labels = [], []
    for i in range(400):
        words = [clean[k] for k in rng.integers(0, 400, 60)]
        if i % 3 == 0:
            word = rude[int(rng.integers(0, 3))]
            words[int(rng.integers(0, 60))] = word if i % 5 else word[:-1] + "x" + word[-1]
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in scored)
    assert len(scored) > 50 and right / len(scored) >= 0.95


def test_toxicity_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (3, 0)], "doc_id long, toxic int")
    got = score_toxicity(odd, fit_toxicity(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[4] == 0.0
    assert [r.score for r in score_toxicity(odd, fit_toxicity(odd, labels.where("doc_id > 99"))).collect()] == [0.0] * len(ODD)
    assert score_toxicity(none, None).collect() == []


def test_mix_comes_near_its_targets(documents):
    got = mix_sources(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    total, by_source = sum(r.size for r in got), {}
    for r in got:
        assert r["size"] == r.size and r.taken in (0, r.size, 2 * r.size)
        held = by_source.setdefault(r.source, {"size": 0, "taken": 0, "target": r.target, "largest": 0})
        held["size"] += r.size
        held["taken"] += r.taken
        held["largest"] = max(held["largest"], r.size)
    # Water filling by hand: raise the level until everything is placed.
    names = sorted(by_source, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = set(), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 2 * by_source[s]["size"]}
        if not over:
            break
        full |= over
        left -= sum(2 * by_source[s]["size"] for s in over)
    for s, held in by_source.items():
        want = 2 * held["size"] if s in full else level * weight[s]
        assert held["target"] == pytest.approx(want) and abs(held["taken"] - want) <= held["largest"]


def test_mix_agrees_between_runs_and_takes_odd_rows(odd, none):
    once, again = (sorted(map(tuple, mix_sources(odd).collect()), key=str) for _ in range(2))
    assert once == again and len(once) == len(ODD)
    assert {r.doc_id: r.size for r in mix_sources(odd).collect()}[3] == 0
    carried = mix_sources(odd, carry=F.struct("*")).select("doc_id", "carried.n_shingles").collect()
    assert len(carried) == len(ODD) and all(r.n_shingles == "keep" for r in carried)
    assert mix_sources(none).collect() == []


STRANGE = [
    "", "  \n", "a<|endoftext|>B <|startoftext|>c", "İstanbul ΣΑΣ ς ÅÅ é é", "x\x1cy \x1f z\x85w q", "don't CAN'T I'll '", "123 4½ ² ٣", "a" * 3000, "ab" * 500 + " é",
    "😀👍🏽 日本語", "!!!?? --", "\x00\x01\x7f\u200b\ufeffzero", "ﬁ ŉ ǰ", "\u0301abc \u0301", "<|endoftext", "A" + "\u0301" * 50, "two  spaces \n and\t\ttabs ",
]


def test_word_bpe_matches_the_library(documents):
    texts = STRANGE + [t for _, t in texts_of(documents)]
    with open(WORD_BPE, "rb") as f:
        model = f.read()
    lexicon = build_lexicon(model, [w for t in texts[:60] for w in t.split()])
    bpe, library = WordBpe(model, Transducer.from_buffer(lexicon.to_bytes())), Tokenizer.from_file(WORD_BPE)
    for text, ids, want in zip(texts, bpe.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:60]
        assert bpe.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_transducer_is_minimal_and_exact():
    entries = {w.encode(): [i, i + 1] for i, w in enumerate(["walk", "walked", "walking", "talk", "talked", "talking", ""])}
    made = Transducer.build(entries)
    numbers = made.numbers([*entries, b"wal", b"walks", b"talkin"])
    assert [made.word_ids(n).tolist() for n in numbers[:7]] == list(entries.values()) and (numbers[7:] == -1).all()
    assert len(made.finals) - 5 <= 10  # the endings of both stems are shared


def test_word_bpe_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in encode_words(odd, WORD_BPE).collect()}
    assert len(got) == len({i for i, _, _ in ODD}) and got[3].n_tokens == 0 and got[3].decoded == ""
    library = Tokenizer.from_file(WORD_BPE)
    for i, text, _ in ODD:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert encode_words(none, WORD_BPE).collect() == []


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 5), (1, 1), (700, 3), (5_000, 16)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint16)
        made = WaveletMatrix.from_bytes(WaveletMatrix.from_ids(ids, bits).to_bytes())
        assert (made.all_ids() == ids).all() and (made.access(np.arange(n)) == ids).all() and made.select(0, n + 1) == -1
        for token in ids[:10].tolist():
            places = np.flatnonzero(ids == token)
            assert made.rank(token, n // 2) == (ids[: n // 2] == token).sum() and made.count(token) == len(places)
            assert made.select(token, len(places) - 1) == places[-1]


def test_shards_hold_what_the_library_says(spark, documents, odd, none, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    for k, df in enumerate((documents, odd, none)):
        write_shards(df, f"{tmp_path}/{k}", BYTE_BPE)
        start, want, twos = 0, [], 0
        rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0))
        for i, text in rows:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
            twos += int((ids == 2).sum())
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_shards(spark, f"{tmp_path}/{k}").collect()]
        assert sorted(got, key=lambda r: r[1]) == want
        assert (token_counts(spark, f"{tmp_path}/{k}", 2).agg(F.sum("occurrences")).first()[0] or 0) == twos


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf).cache()
        if name == "minhash_near_dedup":
            want = groups(texts_of(before), 5)
            assert {i for i, _ in texts_of(docs)} == {i for i, (_, c) in want.items() if i == c}
        if name == "suffix_array_dedup":
            want = cut_by_hand(texts_of(before), corpus_pipeline.REPEATED_BYTES)
            assert {i: t for i, t in texts_of(docs)} == {i: kept.decode("utf-8", "ignore") for i, (kept, _) in want.items()}
        if name == "mix_to_weights":
            assert {i for i, _ in texts_of(docs)} <= {i for i, _ in texts_of(before)}
        if name != "bpe":
            assert docs.columns == columns
    assert docs.count() == before.count()
    assert all(hashlib.sha256(r.ids).digest() for r in docs.select("ids").limit(3).collect())
