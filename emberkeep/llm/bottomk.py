"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import LOWER, NOT_SPACE, U, give_back, mixed, shingle_hashes, slices, staged, with_keys, word_bounds, word_hashes
from emberkeep.llm.components import components

SKETCH = 64  # values kept of each document
SIGN_BINS = 128  # two bits from each bin of the hash range: a coarse sketch that fits in four longs and orders what is tried
SIGNS = ("s0", "s1", "s2", "s3")
SPOT = ["value", "list_band"]
FACTS = ("doc_id", "n")
SHORT_LIST = 8  # documents up to which a list is compared pair by pair, after the rounds
LEADERS = 3  # documents of a longer list that the others are compared with in a round
TRIES = 8  # leaders that a document is compared with in a round
ROUNDS = 4
EVEN_BITS = 0x5555555555555555

Batches = Iterator[pa.RecordBatch]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed longs."""
    for first, last, raw, offsets in slices(column):
        data = LOWER[raw]
        starts, ends, rows = word_bounds(data, offsets, NOT_SPACE)
        hashes, bounds = shingle_hashes(word_hashes(data, starts, ends), rows, words, last - first)
        signed = hashes.view(np.int64)
        for i in range(last - first):
            part = np.sort(signed[bounds[i] : bounds[i + 1]])
            yield part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part


def _signs(values: np.ndarray) -> np.ndarray:
    unsigned = values.view(U)
    held = np.zeros(SIGN_BINS, U)
    # The last assignment to a bin stands, and that is its least value.
    held[(unsigned % U(SIGN_BINS)).astype(np.int64)[::-1]] = ((unsigned >> U(8)) & U(3))[::-1]
    return np.bitwise_or.reduce(held.reshape(-1, 32) << (U(2) * np.arange(32, dtype=U)), axis=1).view(np.int64)


def _sketches(words: int, k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            n, fp, fq, signs, kept = [], [], [], [], []
            for values in shingle_sets(batch.column(1), words):
                unsigned = values.view(U)
                n.append(len(values))
                fp.append(int(mixed(unsigned, 1).sum(dtype=U).view(np.int64)))
                fq.append(int(np.bitwise_xor.reduce(mixed(unsigned, 2)).view(np.int64)) if len(values) else 0)
                signs.append(_signs(values))
                kept.append(values[:k])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(x) for x in kept]))), pa.int32()),
                pa.array(np.concatenate([np.zeros(0, np.int64), *kept])),
            )
            columns = [pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(fq, pa.int64()), *[pa.array([x[i] for x in signs], pa.int64()) for i in range(len(SIGNS))]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, lists], names=["doc_id", "n", "fp", "fq", *SIGNS, "sketch"])
        give_back()

    return run


def _full_sets(words: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([int(mixed(s.view(U), 1).sum(dtype=U).view(np.int64)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "fp", "values"],
            )
        give_back()

    return run


def _confirm(percent: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            left, right = batch.column("a_values"), batch.column("b_values")
            held = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.int64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                held.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))
        give_back()

    return run


def _as(side: str, column: str) -> str:
    return side if column == "doc_id" else f"{side}_{column}"


def _side(name: str) -> list[Column]:
    return [F.col(c).alias(_as(name, c)) for c in FACTS]


def _misses() -> Column:
    """Bins in which the coarse sketches of a pair differ."""
    misses = F.lit(0)
    for sign in SIGNS:
        differ = F.col(f"a_{sign}").bitwiseXOR(F.col(f"b_{sign}"))
        misses += F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(EVEN_BITS)))
    return misses


def _plausible(percent: int, a_n: Column | str = "a_n", b_n: Column | str = "b_n") -> Column:
    """Sizes that a linked pair can have."""
    return 100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n)


def _band(n: Column | str, percent: int) -> Column:
    """The band of a set size; sizes that a linked pair can have are at most one apart."""
    return F.floor(F.log(n) / math.log(100 / percent) + F.lit(1e-9)).cast("int")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """Candidate pairs (a, b) whose union sketch doesn't rule them out."""
    pairs = staged(pairs, "pairs")
    met = with_keys(sketches.select("doc_id", "sketch"), _ids(pairs), "doc_id")
    for side in "ab":
        pairs = pairs.join(met.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"{side}_sketch")), side)
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), union))
    # Six standard deviations below the threshold for a full sketch; exact sets settle the rest.
    return staged(pairs.where(100 * shared >= (percent - 30) * F.size(union)).select("a", "b"), "likely")


def _links(likely: DataFrame, docs: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """Of likely pairs those that the full sets confirm; only texts of such pairs are read again."""
    sets = with_keys(docs, _ids(likely), "doc_id").mapInArrow(_full_sets(words), "doc_id long, fp long, values binary")
    sets = staged(sets.join(sketches.select("doc_id", "fp"), ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id"]), "sets")
    for side in "ab":
        likely = likely.join(sets.select(F.col("doc_id").alias(side), F.col("values").alias(f"{side}_values")), side)
    return staged(likely.mapInArrow(_confirm(percent), "a long, b long"), "links")


def index_lists(sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """(value, list_band, docs, doc_id, n): the inverted lists that every linked pair must share one of.

    A linked pair shares at least m retained values, so it shares one of the
    len - m + 1 rarest of each side.  With whole sets in the sketch m is exact;
    else it is k / 2, six standard deviations below the expected overlap.
    Lists are split by set size: a document enters the band of its size and
    the next, so linked pairs meet in the band of the larger one.
    """
    shown = sketches.select("doc_id", F.explode("sketch").alias("value"))
    common = staged(shown.groupBy("value").agg(F.count("*").alias("docs")).where("docs > 1"), "common")
    # Values that no other document has come first in the order and need no list.
    ranked = shown.join(common, "value").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("docs", "value"))).alias("values"))
    overlap = F.when(100 * F.col("n") <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(k // 2)
    facts = sketches.select("doc_id", "n", _band("n", percent).alias("band"), (F.size("sketch") - overlap + 1).alias("needed"), F.size("sketch").alias("held"))
    chosen = ranked.join(facts, "doc_id")
    chosen = chosen.withColumn("take", (F.col("needed") - F.col("held") + F.size("values")).cast("int")).where("take > 0")
    listed = chosen.select("doc_id", "n", "band", F.explode(F.slice("values", F.lit(1), F.col("take"))).alias("e"))
    listed = listed.select(F.col("e.value").alias("value"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("list_band"), "doc_id", "n")
    listed = staged(listed, "listed")
    several = staged(listed.groupBy(*SPOT).agg(F.count("*").alias("docs")).where("docs > 1"), "several")
    return staged(listed.join(several, SPOT), "lists")


def _leader_pairs(lists: DataFrame, sketches: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each document with some of the leaders of its lists, in other components than its own."""
    def rank(seed: int) -> Column:
        return F.xxhash64("doc_id", *SPOT, F.lit(turn * LEADERS + seed))

    heads = lists.groupBy(*SPOT).agg(F.array_distinct(F.array(*[F.min_by(F.struct("at", *FACTS), rank(i)) for i in range(LEADERS)])).alias("heads"))
    heads = heads.select(*SPOT, F.explode("heads").alias("h")).select(*SPOT, F.col("h.at").alias("a_at"), *[F.col(f"h.{c}").alias(_as("a", c)) for c in FACTS])
    signs = [sketches.select(F.col("doc_id").alias(side), *[F.col(c).alias(_as(side, c)) for c in SIGNS]) for side in "ab"]
    heads = staged(heads.join(signs[0], "a"), "heads")
    met = lists.select(*SPOT, "at", *_side("b")).join(signs[1], "b").join(heads, SPOT).where((F.col("at") != F.col("a_at")) & _plausible(percent))
    # The leaders that look most alike first.
    some = met.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct(_misses().alias("misses"), "a"))), 1, TRIES).alias("tries"))
    tried = some.select("b", F.explode("tries").alias("t")).select(F.col("t.a").alias("a"), "b")
    return tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _at(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists with each document's component as ``at``."""
    rooted = lists.drop("at").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return rooted.withColumn("at", F.coalesce("root", "doc_id")).drop("root")


def _placed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that several components share, with each document's component as ``at``."""
    placed = staged(_at(lists, roots), "placed")
    shared = placed.groupBy(*SPOT).agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high").select(*SPOT)
    return staged(placed.join(staged(shared, "open"), SPOT, "left_semi"), "apart")


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All plausible pairs of lists of at most ``SHORT_LIST`` documents that are in different components."""
    held = lists.groupBy(*SPOT).agg(F.array_sort(F.collect_list(F.struct("doc_id", "n", "at"))).alias("held"), F.min("at").alias("low"), F.max("at").alias("high"))

    def later(x: Column, i: Column) -> Column:
        def here(y: Column) -> Column:
            return (x["at"] != y["at"]) & _plausible(percent, x["n"], y["n"]) & (F.col("list_band") == _band(F.greatest(x["n"], y["n"]), percent))

        return F.transform(F.filter(F.slice("held", i + 2, F.lit(SHORT_LIST)), here), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))

    return held.where("low < high").select(F.inline(F.flatten(F.transform("held", later)))).distinct()


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All plausible pairs of each list that are in different components, each from its first list only."""
    mine = lists.groupBy("doc_id", "list_band").agg(F.array_sort(F.collect_set("value")).alias("mine"))
    rows = staged(lists.join(mine, ["doc_id", "list_band"]), "mine")
    left = rows.select(*SPOT, "at", F.col("mine").alias("a_mine"), *_side("a"))
    right = rows.select(*SPOT, F.col("at").alias("b_at"), F.col("mine").alias("b_mine"), *_side("b"))
    first = F.element_at(F.array_intersect("a_mine", "b_mine"), 1) == F.col("value")
    here = (F.col("a") < F.col("b")) & (F.col("at") != F.col("b_at")) & (F.col("list_band") == _band(F.greatest("a_n", "b_n"), percent))
    return left.join(right, SPOT).where(here & _plausible(percent) & first).select("a", "b")


def bottomk_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (least id reachable over links) and ``kept`` (is the least).  Texts are cut
    into words at ASCII white space after lower-casing A-Z; a text with fewer
    than ``words`` words is one shingle, and one without words (null, empty)
    has an empty set and no links.  Equal sets collapse before the index is
    built.  Ids are integers; a null id gets a null component and is kept.  Rows
    that repeat an id with the same words share its component; where the words
    differ, the text of least fingerprint among those that no smaller id has is
    the one compared.  Extra columns are not read.

    In long lists documents meet a few leaders, in rounds, and drop out with the
    lists that one component fills, so a large group of copies costs some
    comparisons each.  Short lists, and what the rounds left of long ones, are
    then compared pair by pair where documents are still in different
    components.  No group is gathered and none is cut short.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n long, fp long, fq long, s0 long, s1 long, s2 long, s3 long, sketch array<long>"
    every = staged(docs.mapInArrow(_sketches(words, k), schema), "sketches")
    usable = every.where("n > 0 and doc_id is not null")
    classes = staged(usable.groupBy("fp", "fq", "n").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("fp", "fq", "n")).alias("c")).select("doc_id", "c.*")
    sketches = staged(usable.join(firsts, ["doc_id", "fp", "fq", "n"], "left_semi").dropDuplicates(["doc_id"]), "firsts")
    lists = index_lists(sketches, percent, k).withColumn("at", F.col("doc_id"))
    short, long = lists.where(F.col("docs") <= SHORT_LIST), lists.where(F.col("docs") > SHORT_LIST)

    def linked(pairs: DataFrame) -> DataFrame:
        return _links(_likely(pairs, sketches, percent, k), docs, sketches, words, percent)

    roots = staged(components(linked(_leader_pairs(long, sketches, 0, percent))), "roots")
    edges = F.col("node").alias("a"), F.col("root").alias("b")
    open_lists = _placed(long, roots)
    for turn in range(1, ROUNDS):
        links = linked(_leader_pairs(open_lists, sketches, turn, percent))
        if links.isEmpty():
            break
        roots = staged(components(roots.select(*edges).union(links)), "roots")
        open_lists = _placed(open_lists, roots)
    # Short lists and whatever the rounds left are compared whole.
    links = linked(_short_pairs(_at(short, roots), percent).union(_pairs(open_lists, percent)).distinct())
    final = components(roots.select(*edges).union(links))

    named = classes.join(final, F.col("rep") == F.col("node"), "left").select("fp", "fq", "n", F.coalesce("root", "rep").alias("component"))
    named = staged(named, "named")
    out = every.select("doc_id", "n", "fp", "fq").join(named, ["fp", "fq", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
