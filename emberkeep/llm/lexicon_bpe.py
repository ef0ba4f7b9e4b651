"""BPE encoding with a minimal acyclic transducer of frequent words; exact merges for the rest."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import NOT_SPACE, distinct_runs, gathered, give_back, slices, staged, word_bounds
from emberkeep.operators.selection import key_at, key_literal, sort_key

LEXICON_CHUNKS = 50_000  # frequent words compiled into the transducer
LONGEST_CACHED = 100  # characters
CACHED_CHUNKS = 200_000  # runs of a generation that a worker keeps; of the one before it keeps what is met again
COUNTED_CHUNKS = 120_000  # distinct runs after which a task sends its counts
SHORT_WORD = 48  # symbols up to which a scan finds the next merge
STOPS = (b".", b",", b"!", b"?", b";", b":", b")")
PAIR_SHIFT, NO_RANK = 24, 2**40  # bits of a token id in a pair's key; beyond every rank
BATCH_BYTES = 1 << 20

# Fixed values of the tokenizer's file format.
WORD_END = "</w>"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

class Transducer:
    """A minimal acyclic automaton of byte strings whose arcs add up to each word's number, and the ids of each number.

    States with the same continuations are one state, so suffixes are shared.
    The tables are plain arrays in one block of bytes, which can be mapped.
    """

    FIELDS = (("arcs", np.int64), ("targets", np.int32), ("adds", np.int32), ("finals", np.uint8), ("offsets", np.int64), ("ids", np.uint32))

    def __init__(self, tables: dict[str, np.ndarray]):
        for name, _ in self.FIELDS:
            setattr(self, name, tables[name])

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Transducer:
        """From words and their ids; words are added in order, finished states are merged as they close."""
        register: dict[tuple, int] = {}
        closed: list[tuple[bool, tuple]] = []

        def close(final: bool, arcs: list) -> int:
            state = (final, tuple(arcs))
            number = register.setdefault(state, len(closed))
            if number == len(closed):
                closed.append(state)
            return number

        path: list[list] = [[False, []]]  # open states: final, arcs
        last = b""
        words = sorted(entries)
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for depth in range(len(last), common, -1):
                path[depth - 1][1].append((last[depth - 1], close(*path.pop())))
            path.extend([False, []] for _ in range(common, len(word)))
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], close(*path.pop())))
        root = close(*path[0])
        below = [0] * len(closed)  # words from each state on; targets close before their sources
        for i, (final, arcs) in enumerate(closed):
            below[i] = final + sum(below[t] for _, t in arcs)
        rows = []
        for i, (final, arcs) in enumerate(closed):
            passed = int(final)
            for label, target in arcs:
                rows.append((i * 256 + label, target, passed))
                passed += below[target]
        rows.sort()
        lists = [entries[w] for w in words]
        return cls({
            "arcs": np.array([r[0] for r in rows] + [2**62], np.int64), "targets": np.array([r[1] for r in rows] + [0], np.int32),
            "adds": np.array([r[2] for r in rows] + [0], np.int32), "finals": np.array([f for f, _ in closed] + [0, root % 256, root >> 8 & 255, root >> 16 & 255, root >> 24], np.uint8),
            "offsets": np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))), "ids": np.array([i for x in lists for i in x], np.uint32),
        })

    @property
    def root(self) -> int:
        return sum(int(b) << 8 * i for i, b in enumerate(self.finals[-4:]))

    def to_bytes(self) -> bytes:
        parts = [getattr(self, name).tobytes() for name, _ in self.FIELDS]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def from_buffer(cls, block) -> Transducer:
        sizes, at, tables = np.frombuffer(block, np.int64, len(cls.FIELDS)), 8 * len(cls.FIELDS), {}
        for (name, kind), size in zip(cls.FIELDS, sizes.tolist()):
            tables[name] = np.frombuffer(block, kind, size // np.dtype(kind).itemsize, at)
            at += size + -size % 8
        return cls(tables)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for unknown ones; all words step through the automaton together."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        for step in range(int(sizes.max(initial=0))):
            going = alive[sizes[alive] > step]
            if not len(going):
                break
            key = state[going] * 256 + data[begin[going] + step]
            arc = np.searchsorted(self.arcs, key)
            found = self.arcs[arc] == key
            number[going[~found]] = -1
            state[going[found]] = self.targets[arc[found]]
            number[going[found]] += self.adds[arc[found]]
            alive = going[found]
        ended = (number >= 0) & (self.finals[:-5][state] > 0)
        return np.where(ended, number, -1)

    def word_ids(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


class WordBpe:
    """The tokenizer of a ``word_bpe`` file: NFC, white space, lower case, word pattern, byte letters, merges to word ends."""

    def __init__(self, model: bytes, lexicon=None):
        spec = json.loads(model)
        vocab = spec["model"]["vocab"]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[(vocab[left], vocab[right])] = (rank, vocab[left + right])
        pairs = np.array([(a, b, rank, new) for (a, b), (rank, new) in self.merges.items()], np.int64).reshape(-1, 4)
        keys = pairs[:, 0] << PAIR_SHIFT | pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys = np.concatenate((keys[order], [np.int64(2**62)]))
        self.pair_ranks, self.pair_news = (np.concatenate((pairs[order, c], [NO_RANK])) for c in (2, 3))
        letters = _byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + WORD_END) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(WORD_PATTERN)
        self.lexicon = lexicon
        self.inner_ids, self.final_ids = (np.array([-1 if x is None else x for x in t], np.int64) for t in (self.inner, self.final))
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.older: dict[bytes, tuple[bytes, str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merges of one word, lowest rank and leftmost first; symbols that the vocabulary lacks are dropped."""
        ids = [x for x in (*(self.inner[b] for b in word[:-1]), *(self.final[b] for b in word[-1:])) if x is not None]
        if len(ids) > SHORT_WORD:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = merges.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols and what it becomes; ``NO_RANK`` where it is no merge."""
        key = left << PAIR_SHIFT | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK), self.pair_news[at]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, as little-endian 32-bit numbers: in each round every word does its next merge."""
        long = {i: np.array(self.merge(w), "<u4").tobytes() for i, w in enumerate(words) if len(w) > SHORT_WORD}
        sizes = np.array([0 if i in long else len(w) for i, w in enumerate(words)], np.int64)
        data = np.frombuffer(b"".join([w for i, w in enumerate(words) if i not in long]), np.uint8)
        ids, owner = self.inner_ids[data], np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes)[sizes > 0] - 1
        ids[last] = self.final_ids[data[last]]
        ids, owner = ids[ids >= 0], owner[ids >= 0]
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at some places, the last place of a word having none."""
            after = np.minimum(at + 1, len(ids) - 1)
            rank, new = self._pairs(ids[at], ids[after])
            return np.where((owner[after] == owner[at]) & (after > at), rank, NO_RANK), new

        rank, new = ranked(np.arange(len(ids))) if len(ids) else (ids, ids)
        while len(ids):
            begins = np.concatenate(([True], owner[1:] != owner[:-1]))
            starts = np.flatnonzero(begins)
            word = np.cumsum(begins) - 1
            least = np.minimum.reduceat(rank, starts)[word]
            going = least < NO_RANK
            if not going.all():
                done.append((owner[~going], ids[~going]))
                ids, owner, rank, new, least, word = (x[going] for x in (ids, owner, rank, new, least, word))
                if not len(ids):
                    break
            best = np.flatnonzero(rank == least)
            best = best[np.concatenate(([True], word[best][1:] != word[best][:-1]))]  # the leftmost of each word
            ids[best] = new[best]
            keep = np.ones(len(ids), bool)
            keep[best + 1] = False
            moved = np.cumsum(keep) - 1
            ids, owner, rank, new = ids[keep], owner[keep], rank[keep], new[keep]
            touched = moved[best]
            touched = np.unique(np.concatenate((touched, np.maximum(touched - 1, 0))))
            rank[touched], new[touched] = ranked(touched)
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        flat = np.concatenate([i for _, i in done])[order].astype("<u4") if done else np.zeros(0, "<u4")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(words))))).tolist()
        return [long[i] if i in long else flat[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before, alive = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [True] * len(ids)
        heap = [(*self.merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(rank, i, new, p) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (ids[left], ids[right]) in self.merges:
                    rank, made = self.merges[(ids[left], ids[right])]
                    heapq.heappush(heap, (rank, left, made, (ids[left], ids[right])))
        return [x for x, held in zip(ids, alive) if held]

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The words of a run without white space, as bytes; special tokens as their ids."""
        out: list[bytes | int] = []
        parts = self.split_special.split(chunk) if self.split_special and "<" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    part = part.lower()
                else:  # letter by letter: no rule looks at neighbours
                    part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                out.extend(w.encode() for w in self.pattern.findall(part))
        return out

    def learn(self, chunks: list[bytes]) -> dict[bytes, tuple[bytes, str]]:
        """The ids of runs without white space, as little-endian 32-bit numbers, and what they decode to."""
        cut = {}
        for c in chunks:
            if c.isalpha():  # letters of ASCII are one word, a stop after them is another
                cut[c] = [c.lower()]
            elif c[-1:] in STOPS and c[:-1].isalpha():
                cut[c] = [c[:-1].lower(), c[-1:]]
            else:
                cut[c] = self.pieces(c.decode("utf-8", "replace"))
        words = list({w for ws in cut.values() for w in ws if isinstance(w, bytes)})
        ids: dict[bytes | int, bytes] = {}
        numbers = self.lexicon.numbers(words) if self.lexicon is not None and words else np.full(len(words), -1)
        unknown = [w for w, number in zip(words, numbers.tolist()) if number < 0]
        ids.update(zip(unknown, self.merge_all(unknown)))
        ids.update((w, self.lexicon.word_ids(number).tobytes()) for w, number in zip(words, numbers.tolist()) if number >= 0)
        for number in self.special.values():
            ids[number] = np.array([number], "<u4").tobytes()
        joined = {c: b"".join([ids[w] for w in ws]) for c, ws in cut.items()}
        return {c: (i, self.decode(i)) for c, i in joined.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        return self.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))), False)[0]

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, decode: bool = True) -> tuple[list[bytes], list[str]]:
        """Ids and decoded texts of texts in UTF-8; each distinct run without white space is looked up once.

        Runs end at white space of ASCII; other white space inside a run is
        passed over when its words are found.
        """
        raw, n = data.tobytes(), len(offsets) - 1
        starts, ends, rows = word_bounds(data, offsets, NOT_SPACE)
        first, number = distinct_runs(data, starts, ends)
        chunks = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > CACHED_CHUNKS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        again = [c for c in chunks if c not in known and c in older]
        known.update((c, older[c]) for c in again)
        fresh = self.learn([c for c in chunks if c not in known])
        self.known.update((c, i) for c, i in fresh.items() if len(c) <= LONGEST_CACHED)
        found = [fresh[c] if c in fresh else self.known[c] for c in chunks]
        ids, bounds = gathered([i for i, _ in found], number, rows, n)
        coded = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        if not decode:
            return coded, []
        # Runs without ids (control signs that no rule keeps) have no token between blanks either.
        texts, spoken = [t for _, t in found], np.array([bool(i) for i, _ in found], bool)
        shown = spoken[number] if len(number) else np.zeros(0, bool)
        words = number[shown].tolist()
        stops = np.concatenate(([0], np.cumsum(np.bincount(rows[shown], minlength=n)))).tolist()
        return coded, [" ".join([texts[w] for w in words[a:b]]) for a, b in zip(stops, stops[1:])]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_workers: dict[bytes, WordBpe] = {}


def _mapped(block: bytes):
    """The bytes as a memory-mapped file that vanishes with the process."""
    with tempfile.TemporaryFile() as f:
        f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _worker(shared) -> WordBpe:
    model, lexicon = shared.value
    key = hashlib.sha256(model + lexicon).digest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = WordBpe(model, Transducer.from_buffer(_mapped(lexicon)))
    return _workers[key]


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def shown() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c.decode("utf-8", "replace") for c in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), BATCH_BYTES):
            raw = data.tobytes()
            starts, ends, _ = word_bounds(data, offsets, NOT_SPACE)
            first, number = distinct_runs(data, starts, ends)
            counts = np.bincount(number, minlength=len(first)).tolist()
            for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), counts):
                seen[raw[a:b]] += n
            if len(seen) > COUNTED_CHUNKS:
                yield shown()
                seen.clear()
    yield shown()
    give_back()


def frequent_chunks(docs: DataFrame, text_col: str = "text", most: int = LEXICON_CHUNKS) -> list[str]:
    """The most frequent runs without white space in all documents, ``most`` at most.

    Tasks send all their counts, so the result doesn't depend on partitions.  The
    last run that belongs is found by counting; only those before it, ``most``
    rows in all, reach the driver.
    """
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_chunks, "chunk string, n long")
    sums = staged(counted.groupBy("chunk").agg(F.sum("n").alias("n")), "counts")
    ranked = sums.select((-F.col("n")).alias("rank"), "chunk")
    last = key_at(ranked, ["rank", "chunk"], most - 1)
    if last is not None:
        ranked = ranked.where(sort_key(["rank", "chunk"]) <= key_literal(last[0], last[1]))
    return [r.chunk for r in sorted(ranked.collect(), key=lambda r: (r["rank"], r.chunk))]


def build_lexicon(model: bytes, chunks: list[str]) -> Transducer:
    bpe = WordBpe(model)
    words = {w for c in chunks for w in bpe.pieces(c) if isinstance(w, bytes)}
    return Transducer.build({w: bpe.merge(w) for w in words})


def _kernel(shared, decode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared)
        gc.disable()  # what is kept holds no cycles, and is much to look through
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(batch.num_columns - 1), BATCH_BYTES):
                ids, texts = bpe.encode_rows(data, offsets, decode)
                columns = [c.slice(first, last - first) for c in batch.columns[:-1]]
                columns += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = [*batch.schema.names[:-1], "n_tokens", "ids"]
                if decode:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        gc.enable()
        bpe.known, bpe.older = {}, {}  # the worker lives on with other stages
        give_back()

    return run


def encode_words(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, lexicon_size: int = LEXICON_CHUNKS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of every row.

    The frequent words of all documents are compiled into a transducer once;
    each worker maps it, looks new words up in it together, and merges those
    that it lacks exactly as the model says.  ``decoded`` is the tokens of the
    ids between blanks.  A null or empty text has no ids and decodes to "".
    One row per input row, no shuffle of texts; ids of any type, null or
    repeated, pass through, and other columns aren't read.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    lexicon = build_lexicon(model, frequent_chunks(docs, text_col, lexicon_size))
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon.to_bytes()))
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {held.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary" + (", decoded string" if decode else "")
    return held.mapInArrow(_kernel(shared, decode), schema)
