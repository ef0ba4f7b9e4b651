"""A large group of near copies whose changed words are shared by a few of them each."""

import random

from emberkeep.llm import bottomk


def test_short_lists_inside_a_group_make_no_pairs(spark, monkeypatch):
    extra = [[] for _ in range(120)]
    for slot in range(6):
        order = random.Random(slot).sample(range(120), 120)
        for place, i in enumerate(order):
            extra[i].append(f"x{slot}y{place // 8}")
    base = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join(base + more)) for i, more in enumerate(extra)] + [(500, "a b c d"), (501, "a b c e"), (502, "a b c d e"), (503, None)]
    tried, likely = [], bottomk._likely

    def counted(pairs, *args):
        tried.append(pairs.count())
        return likely(pairs, *args)

    monkeypatch.setattr(bottomk, "_likely", counted)
    got = bottomk.bottomk_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    wanted = dict.fromkeys(range(120), 0) | {500: 500, 501: 500, 502: 500, 503: 503}
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert sum(tried) < 1200  # the pairs of the short lists alone are more
