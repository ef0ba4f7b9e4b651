"""Product codes of integer vectors: per-dimension value dictionaries turn part distances into gathers and adds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkeep.llm.common import staged

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
WIDEST = 1 << 26  # larger integers count as this, so that squared distances and sums stay within 64 bits
BLOCK_VALUES = 1 << 19  # integers of a block: 4 MB, whatever the length of the vectors
SALTS = 32


def part_bounds(dim: int, parts: int) -> list[int]:
    """Where parts begin and end; the first ones are longer where the length doesn't divide."""
    return [0, *np.cumsum([len(p) for p in np.array_split(np.arange(dim), parts)]).tolist()]


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -WIDEST, WIDEST).astype(np.int64)


def _usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _one_list(column: pa.Array) -> pa.Array:
    """A column of one row that holds the whole of another."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _block_kernel(dim: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK_VALUES // dim)
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                cut = batch.slice(first, rows)
                column = cut.column(0)
                values = integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim), scale)
                found = [np.unique(values[:, d], return_inverse=True) for d in range(dim)]
                words = pa.array([w for w, _ in found], pa.list_(pa.int64()))
                # A block has fewer rows than 2^32, so a code fits 32 bits, and 16 where the dictionaries are short.
                codes = np.stack([c for _, c in found]).astype("<u4" if rows > 1 << 16 else "<u2")
                columns = [_one_list(cut.column(1)), _one_list(words), pa.array([codes.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rows", "words", "codes"])

    return run


class Block:
    """Vectors as dictionary codes: of each dimension its distinct integers, and which of them each row has."""

    def __init__(self, words: list[np.ndarray], codes: np.ndarray):
        self.words, self.codes, self.n = words, codes, codes.shape[1]

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        words = [w.values.to_numpy() for w in batch.column("words")[i].values]
        raw, n = batch.column("codes")[i].as_py(), len(batch.column("rows")[i].values)
        return cls(words, np.frombuffer(raw, "<u2" if len(raw) == 2 * n * len(words) else "<u4").reshape(len(words), n))

    def nearest(self, entries: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry of a part (ties to the lower index) and its squared distance.

        Of every dimension the squared differences of all its distinct integers
        to all entries are tabulated once; a row gathers its own and adds them.
        """
        total = np.zeros((self.n, len(entries)), np.int64)
        for d in range(low, high):
            table = np.square(self.words[d][:, None] - entries[:, d - low][None, :])
            total += table[self.codes[d]]
        best = total.argmin(axis=1)
        return best, total[np.arange(self.n), best]

    def sums(self, best: np.ndarray, n_entries: int, low: int, high: int) -> np.ndarray:
        """Per entry the sums of the rows that chose it, from counts of dictionary words, and their number."""
        out = np.zeros((n_entries, high - low + 1), np.int64)
        for d in range(low, high):
            words = self.words[d]
            counts = np.bincount(best * len(words) + self.codes[d], minlength=n_entries * len(words)).reshape(n_entries, -1)
            out[:, d - low] = counts @ words
        out[:, -1] = np.bincount(best, minlength=n_entries)
        return out


def _sum_kernel(books: list[np.ndarray], bounds: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(batch, i)
                for p, book in enumerate(books):
                    best, _ = block.nearest(book, bounds[p], bounds[p + 1])
                    total[p] += block.sums(best, len(book), bounds[p], bounds[p + 1])
        for p, sums in enumerate(total):
            entry, place = (a.ravel() for a in np.indices(sums.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums.ravel())], names=["part", "entry", "place", "total"])

    return run


def _code_kernel(books: list[np.ndarray], bounds: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(batch, i)
                chosen = [block.nearest(book, bounds[p], bounds[p + 1]) for p, book in enumerate(books)]
                codes = np.stack([best for best, _ in chosen], axis=1).astype(np.uint8)
                hexes = codes.tobytes().hex()
                width = 2 * len(books)
                text = [hexes[at : at + width] for at in range(0, len(hexes), width)]
                yield pa.RecordBatch.from_arrays([batch.column("rows")[i].values, pa.array(text, pa.string()), pa.array(sum(far for _, far in chosen))], names=["row", "code", "error"])

    return run


def code_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id``, ``label``, ``code`` and ``error`` of every usable vector, and the codebooks, one array (entries x length) a part.

    A component x becomes floor(scale * x).  The codebooks start as the parts
    of the smallest ids' vectors; each round assigns every part to its nearest
    entry and puts the floor of the mean in that entry's place.  The rows are
    staged once as blocks of dictionary codes; a round reads those and sends
    one sum per part, entry and dimension from each task.

    Vectors that are null or empty, or hold null or non-finite components, give
    no row.  A vector of another length than that of the smallest usable id has
    a null code and error.  Rows that repeat an id count and return each for
    itself, a null id counts as the smallest; integers beyond 2^26 count as
    2^26.  With fewer than ``entries`` vectors the codebooks are as short.  An
    empty table gives no rows and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    held = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    row = F.struct("vec_id", "label")
    out = T.StructType([T.StructField("row", held.select(row.alias("row")).schema[0].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    # The smallest ids, ties by the vector itself; all of the first one's length.
    head = held.orderBy(F.col("vec_id").asc_nulls_first(), "vector").limit(1).first()
    shown = ["row.vec_id", "row.label", "code", "error"]
    if head is None:
        return held.sparkSession.createDataFrame([], out).select(*shown), []
    dim = len(head.vector)
    same = held.where(F.size("vector") == dim)
    seeds = same.orderBy(F.col("vec_id").asc_nulls_first(), "vector").limit(entries).collect()
    start, bounds = integers(np.array([r.vector for r in seeds]), scale), part_bounds(dim, parts)
    books = [start[:, low:high].copy() for low, high in zip(bounds, bounds[1:])]
    block = T.StructType([T.StructField("rows", T.ArrayType(out[0].dataType)), T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("codes", T.BinaryType())])
    blocks = staged(same.select("vector", row.alias("row")).mapInArrow(_block_kernel(dim, scale), block), "blocks")
    for _ in range(rounds):
        partial = blocks.mapInArrow(_sum_kernel(books, bounds), "part int, entry int, place int, total long")
        found = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for r in partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():  # entries x (dimensions + parts) numbers
            found[r.part][r.entry, r.place] = r.total
        books = [np.where(f[:, -1:] > 0, f[:, :-1] // np.maximum(f[:, -1:], 1), b) for f, b in zip(found, books)]
    coded = blocks.mapInArrow(_code_kernel(books, bounds), out).select(*shown)
    other = held.where(F.size("vector") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' integers in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_totals(coded: DataFrame, salts: int = SALTS) -> DataFrame:
    """``label_error``: the errors of all rows of a label, added up; null labels are one label.

    Totals are added up before the shuffle and sent back to ``salts`` shares of
    each label's rows, so a label that holds most rows isn't one task.
    """
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("share"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(salts)).cast("int"))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("share"))).drop("of", "share", "salt")
