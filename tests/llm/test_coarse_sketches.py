"""A linked pair whose coarse sketches differ by bad luck."""

import numpy as np
import pyarrow as pa

from emberkeep.llm.bottomk import SIGN_BINS, SKETCH, _signs, bottomk_near_duplicates, shingle_sets
from emberkeep.llm.common import NOT_SPACE, U, shingle_hashes, word_bounds, word_hashes


def hashes_of(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, rows = word_bounds(data, np.array([0, len(data)]), NOT_SPACE)
    return shingle_hashes(word_hashes(data, starts, ends), rows, 1, 1)[0].view(np.int64)


def test_coarse_sketches_rule_no_pair_out(spark):
    common = [f"c{i}" for i in range(900)]
    held = hashes_of(common)
    past = np.sort(held)[SKETCH + 2]  # what is added lies above, so the bottom sketches stay equal
    bins = (held.view(U) % U(SIGN_BINS)).astype(int)
    least = {b: held[bins == b].min() for b in set(bins.tolist())}
    offered, added = [f"n{i}" for i in range(300_000)], {}
    for word, value in zip(offered, hashes_of(offered).tolist()):
        number = value % 2**64
        low = least.get(number % SIGN_BINS)
        if low is not None and past < value < low and (number >> 8) % 4 != (int(low) % 2**64 >> 8) % 4:
            added.setdefault(number % SIGN_BINS, word)
    texts = [" ".join(common), " ".join(common + list(added.values()))]
    one, two = (_signs(next(shingle_sets(pa.array([t]), 1))).view(U) for t in texts)
    differ = one ^ two
    assert sum(bin(int((d | (d >> U(1))) & U(0x5555555555555555))).count("1") for d in differ) > 40 and len(added) < 200
    got = bottomk_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0}
