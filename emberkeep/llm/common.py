"""Helpers that several operators share: staged tables, byte views of Arrow text, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkeep.session import work_dir

SLICE_BYTES = 1 << 20  # kernels work on this much text at a time, whatever the Arrow batch holds
BROADCAST_KEYS = 200_000  # most keys that a join may send to every executor: under 4 MB

U = np.uint64
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage in storage that outlives executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_keys(df: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``keys`` (one column of that name), or with ``left_anti`` is not.

    The keys are counted first; few go to every executor, so the wide side
    stays where it is, and more are joined by a shuffle.
    """
    keys = keys.select(column).distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, column, how)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets from 0) of runs of whole rows of about ``limit`` bytes."""
    if len(column) == 0:
        return
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def byte_class(wanted) -> np.ndarray:
    """A table of 256 truth values."""
    return np.array([bool(wanted(b)) for b in range(256)])


NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM_OR_HIGH = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes; no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = inside[data]
    heads, tails = offsets[:-1], offsets[1:]
    before = np.concatenate(([False], held[:-1]))
    before[heads[heads < len(data)]] = False
    after = np.concatenate((held[1:], [False]))
    after[tails[tails > 0] - 1] = False
    starts, ends = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * MIX_A
    h = (h ^ (h >> U(27))) * MIX_B
    return h ^ (h >> U(31))


BASE = 0x5851F42D4C957F2D
BYTE_CODES = mixed(np.arange(256, dtype=U), 7)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for at least ``n`` positions."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            column = np.full(size, U(base))
            column[0] = U(1)
            _powers[name] = np.cumprod(column)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from one running sum over the bytes."""
    up, down = _power_table(len(data) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(BYTE_CODES[data] * up[: len(data)])))
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct run of bytes, and the number of each run among those.

    Equal hashes are checked byte by byte, so the answer is exact.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, like = ends - starts, first[number]
    alike = bool((sizes == sizes[like]).all())
    if alike:
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        alike = bool((data[np.repeat(starts, sizes) + inner] == data[np.repeat(starts[like], sizes) + inner]).all())
    if not alike:
        raw, seen = data.tobytes(), {}
        number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])
        first = np.unique(number, return_index=True)[1]
    return first, number


def gathered(pieces: list[bytes], number: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of each run's piece, one after the other, and where each row's begin."""
    flat = np.frombuffer(b"".join(pieces), "<u4")
    sizes = np.array([len(p) // 4 for p in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    mine = sizes[number] if len(number) else np.zeros(0, np.int64)
    at = np.arange(int(mine.sum())) + np.repeat(begin[number] - (np.cumsum(mine) - mine), mine) if len(number) else np.zeros(0, np.int64)
    counts = np.bincount(rows, mine, n_rows).astype(np.int64)
    return flat[at], np.concatenate(([0], np.cumsum(counts)))


def give_back() -> None:
    """Returns what a task has freed to the system, since workers live on with the next stage."""
    import ctypes
    import gc

    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their row bounds; a shorter row is one run of all its words."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.maximum(counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(out)))
    owner = np.repeat(np.arange(n_rows), out)
    at = first[owner] + (np.arange(bounds[-1]) - bounds[owner])
    h = np.zeros(len(at), U)
    last = first[owner + 1] - 1
    for j in range(size):
        there = at + j <= last
        h[there] = mixed(h[there] ^ words[at[there] + j], 11 + j)
    return h, bounds
