"""The passes of op1 on Arrow tables: what they send each other, whatever order rows arrive in."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from emberkeep.llm import suffix_dedup as S

LENGTH, BUCKETS, CHUNKS = 50, 4, 2


def chunk_of(rows, number):
    ids, texts = zip(*rows)
    return pa.table({"chunk": pa.array([number] * len(rows), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "carried": pa.array(ids, pa.int64())})


def told_to(table, number):
    return table.filter(pc.equal(table["chunk"], number))


def by_bucket(tables):
    whole = pa.concat_tables(tables)
    return [whole.filter(pc.equal(whole["bucket"], b)) for b in sorted(set(whole["bucket"].to_pylist()))]


def passes(chunks, later, hot=S.HOT_PIECES, buckets=BUCKETS):
    """Kept bytes by id, and the letters of each bucket; the last pass sees the rows of each chunk in the order of ``later``."""
    listed = by_bucket([S._list_keys(LENGTH, CHUNKS)(c) for c in chunks])
    told = pa.concat_tables([S._match_keys(CHUNKS, hot)(b) for b in listed])
    sent = [S._send_contexts(LENGTH, buckets)(c, told_to(told, i)) for i, c in enumerate(chunks)]
    found = pa.concat_tables([S._sort_bucket(LENGTH)(b) for b in by_bucket(sent)])
    cut = S._cut(LENGTH, buckets, ["doc_id", "n_bytes", "kept", "spans", "carried"])
    out = [r for i, c in enumerate(later) for r in cut(c, told_to(found, i)).to_pylist()]
    assert all(r["carried"] == r["doc_id"] for r in out)
    sizes = [sum(int(np.frombuffer(x.as_py(), np.int32).sum()) for x in b["sizes"]) for b in by_bucket(sent)]
    return {r["doc_id"]: r["kept"] for r in out}, sizes


def brute(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        for at in range(len(text) - LENGTH + 1):
            first.setdefault(text[at : at + LENGTH], i)
    for i, text in rows:
        covered = np.zeros(len(text), bool)
        for at in range(len(text) - LENGTH + 1):
            covered[at : at + LENGTH] |= first[text[at : at + LENGTH]] < i
        out[i] = "".join(c for c, gone in zip(text, covered) if not gone).encode()
    return out


def letters(rng, n):
    return "".join(map(chr, rng.integers(97, 123, n)))


def test_rows_of_a_chunk_may_arrive_in_another_order():
    rng = np.random.default_rng(1)
    passages = [letters(rng, 200) for _ in range(12)]
    rows = [(i, "".join(x for j in rng.integers(0, 12, 3) for x in (letters(rng, 90), passages[j]))) for i in range(24)]
    halves = [rows[:12], rows[12:]]
    chunks = [chunk_of(h, i) for i, h in enumerate(halves)]
    shuffled = [chunk_of([h[j] for j in rng.permutation(12)], i) for i, h in enumerate(halves)]
    assert passes(chunks, chunks)[0] == brute(rows)
    assert passes(chunks, shuffled)[0] == brute(rows)


def test_ends_of_a_common_passage_spread_over_buckets():
    """Each document has the same passage between letters of its own; some tails repeat."""
    rng = np.random.default_rng(2)
    passage, tails = letters(rng, 300), [letters(rng, 40) for _ in range(30)]
    rows = [(i, letters(rng, 60) + passage + (tails[i % 30] if i % 3 == 0 else "") + letters(rng, 60)) for i in range(600)]
    chunks = [chunk_of(rows[:300], 0), chunk_of(rows[300:], 1)]
    whole, before = passes(chunks, chunks, hot=10**9, buckets=64)
    split, after = passes(chunks, chunks, hot=100, buckets=64)
    assert whole == split == brute(rows)
    assert max(before) > 600 * LENGTH and max(after) < sum(after) / 16
