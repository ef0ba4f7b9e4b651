"""Token ids in wavelet-matrix shards: encode, write in id order, read back, count and find tokens."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberkeep.llm.common import NOT_SPACE, distinct_runs, gathered, give_back, slices

SHARD_TOKENS = 1_000_000  # a shard closes with the document that reaches this
PARTITION_BYTES = 16 << 20
CACHED_CHUNKS = 200_000  # of a generation; of the one before a worker keeps what is met again
LONGEST_CACHED = 100
BLOCK_WORDS = 8  # 64-bit words between two entries of the rank directory

# White space beyond ASCII, in UTF-8: a run that mixes both kinds can't be cut between them.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class WaveletMatrix:
    """A sequence of ids as bit planes; each plane is ordered by the planes above it.

    ``planes`` holds packed bits from the highest on, ``ranks`` the ones before
    each block of a plane, ``zeros`` the zeros of each plane.  Access, rank and
    select walk one bit per plane; nothing else of the file is decoded.
    """

    def __init__(self, n: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def from_ids(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        words = -(-max(n, 1) // (64 * BLOCK_WORDS)) * BLOCK_WORDS
        planes, zeros = np.zeros((bits, words), np.uint64), np.zeros(bits, np.int64)
        for level in range(bits):
            ones = (ids >> (bits - 1 - level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes[level].view(np.uint8)[: len(packed)] = packed
            below = ids[~ones]
            zeros[level] = len(below)
            ids = np.concatenate((below, ids[ones]))
        return cls(n, planes, cls._directory(planes), zeros)

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(planes).reshape(len(planes), -1, BLOCK_WORDS).sum(axis=2, dtype=np.uint32)
        return np.concatenate((np.zeros((len(planes), 1), np.uint32), np.cumsum(ones, axis=1, dtype=np.uint32)), axis=1)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.planes), self.planes.shape[1]], np.int64)
        return b"".join(x.tobytes() for x in (head, self.zeros, self.planes, self.ranks))

    @classmethod
    def from_bytes(cls, block: bytes) -> WaveletMatrix:
        n, bits, words = np.frombuffer(block, np.int64, 3).tolist()
        at = 24 + 8 * bits
        planes = np.frombuffer(block, np.uint64, bits * words, at).reshape(bits, words)
        ranks = np.frombuffer(block, np.uint32, -1, at + planes.nbytes).reshape(bits, -1)
        return cls(n, planes, ranks, np.frombuffer(block, np.int64, bits, 24))

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def _ones(self, level: int, upto: np.ndarray) -> np.ndarray:
        """Ones among the first ``upto`` bits of a plane."""
        word, block = upto >> 6, upto >> 6 >> 3
        count = self.ranks[level][block].astype(np.int64)
        plane = np.concatenate((self.planes[level], np.zeros(1, np.uint64)))
        for step in range(BLOCK_WORDS - 1):
            at = block * BLOCK_WORDS + step
            count += np.where(at < word, np.bitwise_count(plane[np.minimum(at, len(plane) - 1)]), 0)
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return count + np.bitwise_count(plane[np.minimum(word, len(plane) - 1)] & mask)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit.astype(np.int64)
            at = np.where(bit > 0, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(1, np.int64), np.array([upto], np.int64)
        for level in range(len(self.planes)):
            a, b = self._ones(level, low), self._ones(level, high)
            one = token >> (len(self.planes) - 1 - level) & 1
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if one else (low - a, high - b)
        return low, high

    def rank(self, token: int, upto: int) -> int:
        """How often a token stands among the first ``upto`` ids."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, upto)
        return int(high[0] - low[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, number: int) -> int:
        """The place of occurrence ``number`` (from 0) of a token, found upwards through the planes; -1 if there is none."""
        if not 0 <= number < self.count(token):
            return -1
        at = int(self._range(token, 0)[0][0]) + number
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            wanted = at - int(self.zeros[level]) if one else at
            low, high = 0, self.n - 1
            while low < high:  # the first place with more than ``wanted`` such bits up to it
                middle = (low + high) // 2
                ones = int(self._ones(level, np.array([middle + 1]))[0])
                if (ones if one else middle + 1 - ones) > wanted:
                    high = middle
                else:
                    low = middle + 1
            at = low
        return at

    def all_ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        out, bits = np.zeros(self.n, np.uint32), len(self.planes)
        for level in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(out)
            above[~ones] = out[: int(self.zeros[level])]
            above[ones] = out[int(self.zeros[level]) :] | np.uint32(1 << (bits - 1 - level))
            out = above
        return out


class ChunkEncoder:
    """A tokenizers model whose answers are kept for runs of white space and what follows.

    The model's pattern never joins a letter or sign with the white space after
    it, so such runs encode alone as they do in place.  A text with white space
    beyond ASCII is one chunk.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model.decode())
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ask(self, chunks: list[bytes]) -> list[bytes]:
        coded = self.model.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of texts in UTF-8, as little-endian 32-bit numbers; each distinct chunk is looked up once."""
        raw, n = data.tobytes(), len(offsets) - 1
        blank = ~NOT_SPACE[data]
        begins = blank & np.concatenate(([True], ~blank[:-1])) if len(data) else blank
        for odd in ODD_SPACE.finditer(raw):  # such a text stays whole
            row = int(np.searchsorted(offsets, odd.start(), "right")) - 1
            begins[offsets[row] : offsets[row + 1]] = False
        begins[offsets[:-1][offsets[:-1] < np.minimum(offsets[1:], len(data))]] = True
        starts = np.flatnonzero(begins)
        ends = np.concatenate((starts[1:], [len(data)]))
        first, number = distinct_runs(data, starts, ends)
        chunks = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > CACHED_CHUNKS:
            self.older, self.known = self.known, {}
        self.known.update((c, self.older[c]) for c in chunks if c not in self.known and c in self.older)
        fresh = [c for c in chunks if c not in self.known]
        answers = dict(zip(fresh, self._ask(fresh)))
        self.known.update((c, i) for c, i in answers.items() if len(c) <= LONGEST_CACHED)
        ids, bounds = gathered([answers[c] if c in answers else self.known[c] for c in chunks], number, np.searchsorted(offsets, starts, "right") - 1, n)
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


_workers: dict[int, ChunkEncoder] = {}


def _write_kernel(shared, end_id: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value)
        if key not in _workers:
            _workers[key] = ChunkEncoder(shared.value)
        encoder, end, part, seq = _workers[key], np.array([end_id], "<u4").tobytes(), None, 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), "<u4")
            bounds = np.concatenate(([0], np.cumsum([len(h) // 4 for h in held])))
            block = WaveletMatrix.from_ids(tokens.astype(np.uint16 if bits <= 16 else np.uint32), bits).to_bytes()
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([bounds.tolist()], pa.list_(pa.int64())), pa.array([block], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_tokens", "doc_ids", "bounds", "matrix"])

        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2), 1 << 20):
                part = batch.column(0)[0].as_py()
                for doc_id, coded in zip(batch.column(1).slice(first, last - first).to_pylist(), encoder.encode(data, offsets)):
                    ids.append(doc_id)
                    held.append(coded + end)
                    size += len(coded) // 4 + 1
                    if size >= SHARD_TOKENS:
                        yield shard()
                        ids, held, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()
        give_back()

    return run


def write_shards(docs: DataFrame, path: str, model_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts in ascending id order and write one row per shard: place, document bounds and wavelet matrix.

    Ids are ranges of a sorted shuffle, so ``part`` and ``seq`` order the
    shards.  Null ids come first, a null text is empty, rows that repeat an id
    are kept side by side; other columns aren't read.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_str(model.decode()).get_vocab_size() - 1, end_id)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = held.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    parts = max(16, total // PARTITION_BYTES)
    ordered = held.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    schema = "part int, seq int, n_tokens long, doc_ids array<long>, bounds array<long>, matrix binary"
    shards = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_write_kernel(shared, end_id, int(largest).bit_length()), schema)
    shards.write.option("compression", "zstd").parquet(path)


def _read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = WaveletMatrix.from_bytes(batch.column("matrix")[i].as_py()).all_ids().astype("<u4").tobytes()
            ids, bounds = batch.column("doc_ids")[i].values, np.array(batch.column("bounds")[i].as_py(), np.int64)
            n = len(ids)
            sums = [zlib.crc32(raw[4 * low : 4 * high]) for low, high in zip(bounds.tolist(), bounds[1:].tolist())]
            columns = [pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("part", "seq")]
            yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the shards' matrices.

    Starts come from the shards' sizes alone: sums over the parts, then over
    the shards of a part.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    docs = shards.select("part", "seq", "doc_ids", "bounds", "matrix").mapInArrow(_read_kernel, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, seq, occurrences, first) of a token in each shard that has it, by rank and select alone; ``first`` is its place in the shard."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [WaveletMatrix.from_bytes(m.as_py()) for m in batch.column("matrix")]
            columns = [batch.column("part"), batch.column("seq"), pa.array([m.count(token) for m in held], pa.int64()), pa.array([m.select(token, 0) for m in held], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "occurrences", "first"])

    found = spark.read.parquet(path).select("part", "seq", "matrix").mapInArrow(look, "part int, seq int, occurrences long, first long")
    return found.where("occurrences > 0")
