"""Removal of byte strings that repeat an earlier document, by difference-cover suffix sorting.

A 50-byte string and every copy of it choose the same anchor, the least hash
among their own short grams.  Anchors that only one document has rule out most
text.  The text around the others goes to the bucket of its anchor, so that all
copies of a string meet; each bucket sorts its suffixes with a difference cover
modulo three (sampled triples get names, the names are sorted recursively, the
remaining suffixes are merged), and adjacent prefixes show the copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkeep.llm.common import MIX_A, MIX_B, U, mixed, slices, word_bounds

CHUNK_BYTES = 8 << 20  # text that one task holds at a time
SLICE_BYTES = 1 << 20
LEAST_CHUNKS = 64
KEY_BYTES = 6
HOT_PIECES = 1 << 14  # pieces that may meet on one anchor
COUNT_ALL = 32  # pieces of an anchor in a chunk from which they are counted one by one, else by a sample
COVERED = np.array([False, True])


def _gram(length: int) -> int:
    return 16 if length < 100 else 32


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number."""
    padded = np.concatenate((data, np.zeros(64, np.uint8)))
    return np.ndarray((len(data) + 56,), dtype="<u8", buffer=padded, strides=(1,))


def _run_keys(words: np.ndarray, at: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    """48-bit hashes of the ``size`` bytes from each place."""
    h = np.full(len(at), salt, U)
    for step in [*range(0, size - 8, 8), size - 8]:
        h = (h ^ words[at + step]) * MIX_A
        h ^= h >> U(29)
    h *= MIX_B
    return (h ^ (h >> U(31))) >> U(16)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, row, windows of the left key, left key, right key) for each anchor.

    A window is a start whose ``length`` bytes lie in one row; its anchor is
    the leftmost gram of least hash inside it, which depends on those bytes
    alone.  The windows of one anchor are consecutive.  The earlier ones also
    hold the bytes before the gram that the left key covers, the later ones
    those after it, up to the right key's end.
    """
    n = len(data)
    starts = np.arange(n)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    valid = starts + length <= row_end
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none, none, none.astype(U), none.astype(U)
    gram, words = _gram(length), _words_at(data)
    h = np.zeros(n, U)
    for at in range(0, gram, 8):
        h = (h ^ words[at : at + n]) * (MIX_A if at % 16 else MIX_B)
        h ^= h >> U(29)
    h *= MIX_A
    h ^= h >> U(32)
    best = (h & U(0xFFFFFFFF00000000)) | starts.astype(U)
    grams, span = length - gram + 1, 1
    while span < grams:
        step = min(span, grams - span)
        best[:-step] = np.minimum(best[:-step], best[step:])
        span += step
    first = starts[valid]
    where = (best[valid] & U(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    counts = np.diff(np.concatenate((begins, [len(where)])))
    rows = np.searchsorted(offsets, first[begins], "right") - 1
    at, side = where[begins], (length - gram) // 2
    lefts = np.clip(at - side - first[begins] + 1, 0, counts)
    # A key is read at a clipped place only where no window uses it.
    left = _run_keys(words, np.maximum(at - side, 0), gram + side, U(1))
    right = _run_keys(words, np.minimum(at, max(n - gram - side, 0)), gram + side, U(2))
    return h[at] >> U(16), first[begins], counts, rows, lefts, left, right


def pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel().astype(U)


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are in ``held``, which is sorted."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _dense(keys: np.ndarray) -> np.ndarray:
    top = int(keys.max(initial=0))
    if top < 1 << 24 and len(keys) > 1 << 16:  # few possible keys: a table instead of a sort
        present = np.zeros(top + 1, np.int64)
        present[keys] = 1
        return np.cumsum(present)[keys] - 1
    return np.unique(keys, return_inverse=True)[1]


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One number per row that sorts as the columns do."""
    key = columns[0]
    for column in columns[1:]:
        width = int(column.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + width > 63:
            key = _dense(key)
        key = (key << width) | column
    return key


def _counts_below(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of x are below each x, of y below each x, of x below each y."""
    keys = np.concatenate((x, y))
    order = np.argsort(keys)
    held = keys[order]
    fresh = np.concatenate(([True], held[1:] != held[:-1])) if len(held) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(fresh, np.arange(len(held)), 0))
    from_x = np.concatenate(([0], np.cumsum(order < len(x))))
    below_x = np.empty(len(keys), np.int64)
    below_x[order] = from_x[group]
    below_all = np.empty(len(keys), np.int64)
    below_all[order] = group
    return below_x[: len(x)], (below_all - below_x)[: len(x)], below_x[len(x) :]


def suffix_ranks(letters: np.ndarray, need: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """A number per wanted suffix that orders suffixes by their first ``need`` letters or more.

    Letters are non-negative.  Suffixes that agree on ``need`` letters are
    consecutive in that order, whatever comes after.
    """
    n = len(letters)
    padded = np.concatenate((letters, np.zeros(3, np.int64)))
    if n < 3 or need <= 3:
        ranks = _dense(_packed(padded[:n], padded[1 : n + 1], padded[2 : n + 2]))
        return ranks if wanted is None else ranks[wanted]
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names = _dense(_packed(padded[sample], padded[sample + 1], padded[sample + 2])) + 1
    # A letter below all names parts the two halves of the shorter string.
    deeper = suffix_ranks(np.concatenate((names[: len(one)], [0], names[len(one) :])), -(-need // 3)) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[one], rank[two] = deeper[: len(one)], deeper[len(one) + 1 :]

    zero = np.arange(0, n, 3)
    if wanted is not None:
        zero, one, two = (x[wanted[x]] for x in (zero, one, two))
    total = np.zeros(n, np.int64)
    tied = np.concatenate((rank[one], rank[two]))
    below, _, _ = _counts_below(tied, tied[:0])
    total[one], total[two] = below[: len(one)], below[len(one) :]
    both = np.concatenate((zero, one))
    keys = _packed(padded[both], rank[both + 1])
    own, other, back = _counts_below(keys[: len(zero)], keys[len(zero) :])
    total[zero] += own + other
    total[one] += back
    both = np.concatenate((zero, two))
    keys = _packed(padded[both], padded[both + 1], rank[both + 2])
    _, other, back = _counts_below(keys[: len(zero)], keys[len(zero) :])
    total[zero] += other
    total[two] += back
    return total if wanted is None else total[wanted]


def repeated_windows(data: np.ndarray, is_window: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each window, whether its ``length`` bytes also start in a window of a smaller owner."""
    ranks = suffix_ranks(data.astype(np.int64), length, is_window)
    at = np.flatnonzero(is_window)
    order = np.argsort(ranks, kind="stable")
    words, sorted_at = _words_at(data), at[order]
    same = np.ones(len(at), bool)
    same[:1] = False
    for shift in [*range(0, length - 7, 8), length - 8]:
        column = words[sorted_at + shift]
        same[1:] &= column[1:] == column[:-1]
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(owners[order], heads)
    out = np.empty(len(at), bool)
    out[order] = owners[order] > np.repeat(least, np.diff(np.concatenate((heads, [len(at)]))))
    return out


def _in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in an order of their own: shuffled blocks arrive in any, and passes number pieces by it."""
    return table.take(pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


class _Chunk:
    """The anchors of a group of documents, and what is known of them from the group alone."""

    def __init__(self, table: pa.Table, length: int):
        self.length, self.parts = length, []
        ids, texts = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
        for first, last, data, offsets in slices(texts, SLICE_BYTES):
            own = ids.slice(first, last - first)
            key, window, count, row, lefts, left, right = anchors(data, offsets, length)
            held = ~own.is_null().to_numpy(zero_copy_only=False)
            docs = own.fill_null(0).to_numpy(zero_copy_only=False)
            named = held[row]
            self.parts.append((own, data, offsets, key[named], window[named], count[named], docs[row[named]], lefts[named], left[named], right[named]))
        keys, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, _, _, _, _, count, docs, lefts, left, right in self.parts:
            keys += [left[lefts > 0], right[lefts < count]]
            owners += [docs[lefts > 0], docs[lefts < count]]
        self.keys, self.docs = np.concatenate(keys), np.concatenate(owners)

    def own_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and whether several of the documents here have them."""
        order = np.argsort(self.keys, kind="stable")
        keys, docs = self.keys[order], self.docs[order]
        if not len(keys):
            return keys, np.zeros(0, bool)
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[heads], np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads)

    def counted_anchors(self, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and how many different pieces they have here.

        Few pieces count as ``COUNT_ALL`` with the chance that makes the
        expectation right, so that most anchors needn't be sent.
        """
        keys, pieces = [np.zeros(0, U)], [np.zeros(0, U)]
        for _, data, _, key, window, count, *_ in self.parts:
            words = _words_at(data)
            # The first and the last window hold all bytes of a piece, since it is shorter than two.
            ends = [_run_keys(words, at, self.length, U(salt)) for salt, at in ((4, window), (5, window + count - 1))]
            keys.append(key)
            pieces.append(mixed(ends[0]) ^ ends[1] ^ key)
        key = np.concatenate(keys)
        key = key[np.unique(np.concatenate(pieces), return_index=True)[1]]
        key, many = np.unique(key, return_counts=True)
        chosen = many > (mixed(key, salt) % U(COUNT_ALL)).astype(np.int64)
        return key[chosen], np.maximum(many[chosen], COUNT_ALL)

    def contexts(self, shared: np.ndarray, hot: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, list[tuple], tuple, tuple]:
        """Distinct texts of the windows whose left or right key is shared.

        Bytes, place and least document of each; for each part of the chunk the
        texts in it, their documents, first windows and how many; and the shared
        keys and the hot anchors in use, each with places.  The place of a text
        is its anchor; of a hot anchor each window is a text, placed by its hash.
        """
        seen: dict[bytes, int] = {}
        places, least, of_part, used, used_hot = [], [], [], [(np.zeros(0, U), np.zeros(0, U))], [(np.zeros(0, U), np.zeros(0, U))]
        for _, data, _, key, window, count, docs, lefts, left, right in self.parts:
            raw = data.tobytes()
            in_left, in_right = (lefts > 0) & _among(left, shared), (lefts < count) & _among(right, shared)
            first = window + np.where(in_left, 0, lefts)
            many = np.where(in_left, lefts, 0) + np.where(in_right, count - lefts, 0)
            is_hot = _among(key, hot)
            for keys, some in ((left, in_left & ~is_hot), (right, in_right & ~is_hot)):
                used.append((keys[some], key[some]))
            at, split = np.flatnonzero((many > 0) & ~is_hot), np.flatnonzero((many > 0) & is_hot)
            place, first, many, doc = [key[at]], [first[at], first[split]], [many[at], many[split]], docs[at]
            anchor = np.repeat(split, many[1])
            single = np.repeat(first[1] - np.cumsum(many[1]) + many[1], many[1]) + np.arange(len(anchor))
            place.append(_run_keys(_words_at(data), single, self.length, U(3)))
            used.append((np.where(single < window[anchor] + lefts[anchor], left[anchor], right[anchor]), place[1]))
            used_hot.append((key[anchor], place[1]))
            place, first = np.concatenate(place), np.concatenate((first[0], single))
            many, doc = np.concatenate((many[0], np.ones(len(single), np.int64))), np.concatenate((doc, docs[anchor]))
            chosen = np.empty(len(first), np.int64)
            for i, (low, high, owner) in enumerate(zip(first.tolist(), (first + many - 1 + self.length).tolist(), doc.tolist())):
                piece = raw[low:high]
                number = seen.setdefault(piece, len(seen))
                if number == len(places):
                    places.append(place[i])
                    least.append(owner)
                elif owner < least[number]:
                    least[number] = owner
                chosen[i] = number
            of_part.append((chosen, doc, first, many))
        flat = [tuple(np.concatenate(x) for x in zip(*pairs)) for pairs in (used, used_hot)]
        return list(seen), np.array(places, U), np.array(least, np.int64), of_part, *flat


def _groups(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (keys % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    heads = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else []
    for low, high in zip(heads, [*heads[1:], len(held)]):
        yield int(held[low]), order[low:high]


def _rows(names: list[str], types: list, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _list_keys(length: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        number, rows = table.column("chunk")[0].as_py(), []
        chunk = _Chunk(table, length)
        keys, several = chunk.own_keys()
        anchor, many = chunk.counted_anchors(number)
        counted = {bucket: (pack_keys(anchor[at]), many[at].astype(np.int32).tobytes()) for bucket, at in _groups(anchor, buckets)}
        listed = {bucket: (pack_keys(keys[at[~several[at]]]), pack_keys(keys[at[several[at]]])) for bucket, at in _groups(keys, buckets)}
        for bucket in sorted({*listed, *counted}):
            rows.append((bucket, number, *listed.get(bucket, (b"", b"")), *counted.get(bucket, (b"", b""))))
        return _rows(["bucket", "chunk", "single", "several", "anchors", "counts"], [pa.int64(), pa.int64(), *[pa.binary()] * 4], rows)

    return run


def _hot_anchors(table: pa.Table, most: int) -> np.ndarray:
    keys = np.concatenate([unpack_keys(x.as_py()) for x in table.column("anchors")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("counts")])
    keys, which = np.unique(keys, return_inverse=True)
    return keys[np.bincount(which, counts, len(keys)) > most]


def _match_keys(chunks: int, most: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Tells each chunk which of its keys documents of other chunks have too, and all chunks the hot anchors."""
        single = [unpack_keys(x.as_py()) for x in table.column("single")]
        several = [unpack_keys(x.as_py()) for x in table.column("several")]
        every = np.concatenate([*single, *several])
        order = np.argsort(every)
        held = every[order]
        same = held[1:] == held[:-1]
        shared = np.zeros(len(every), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in single])))
        rows = [(c.as_py(), pack_keys(keys[shared[low:high]]), b"") for c, keys, low, high in zip(table.column("chunk"), single, bounds, bounds[1:])]
        rows, hot = [r for r in rows if r[1]], pack_keys(_hot_anchors(table, most))
        rows += [(chunk, b"", hot) for chunk in range(chunks if hot else 0)]
        return _rows(["chunk", "shared", "hot"], [pa.int64(), pa.binary(), pa.binary()], rows)

    return run


def _told(table: pa.Table, column: str) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, U), *[unpack_keys(x.as_py()) for x in table.column(column)]]))


def _send_contexts(length: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            chunk = _Chunk(_in_order(table), length)
            keys, several = chunk.own_keys()
            shared = np.union1d(keys[several], _told(told, "shared"))
            pieces, place, least, _, *used = chunk.contexts(shared, _told(told, "hot"))
            told_on, hot_on = ({bucket: pack_keys(np.unique(x[at])) for bucket, at in _groups(x_in, buckets)} for x, x_in in used)
            sizes = np.array([len(p) for p in pieces], np.int32)
            squeeze = zstandard.ZstdCompressor(level=1)
            for bucket, at in _groups(place, buckets):
                text = squeeze.compress(b"".join([pieces[i] for i in at]))
                rows.append((bucket, table.column("chunk")[0].as_py(), text, sizes[at].tobytes(), least[at].tobytes(), told_on[bucket], hot_on.get(bucket, b"")))
        return _rows(["bucket", "chunk", "pieces", "sizes", "owners", "keys", "hot"], [pa.int64(), pa.int64(), *[pa.binary()] * 5], rows)

    return run


def _numbered(texts: list[bytes], sizes: list[np.ndarray], numbers: dict[bytes, int]) -> list[int]:
    """A number for each piece of the texts, the same for equal pieces."""
    out = []
    for text, size in zip(texts, sizes):
        ends = np.cumsum(size).tolist()
        out += [numbers.setdefault(text[low:high], len(numbers)) for low, high in zip([0, *ends], ends)]
    return out


def _sort_bucket(length: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        open_up = zstandard.ZstdDecompressor()
        texts = [open_up.decompress(x.as_py()) for x in table.column("pieces")]
        sizes = [np.frombuffer(x.as_py(), np.int32) for x in table.column("sizes")]
        owners = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("owners")])
        # Equal texts of several chunks are sorted once, for the least document.
        numbers: dict[bytes, int] = {}
        which = np.array(_numbered(texts, sizes, numbers), np.int64)
        least = np.full(len(numbers), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owners)
        every = np.array([len(t) for t in numbers], np.int64)
        data = np.frombuffer(b"".join(numbers), np.uint8)
        del texts, numbers
        begin, windows = np.cumsum(every) - every, every - length + 1
        is_window = np.arange(len(data)) - np.repeat(begin, every) < np.repeat(windows, every)
        sorted_once = repeated_windows(data, is_window, np.repeat(least, windows), length)
        begin, many = np.cumsum(windows) - windows, windows[which]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        found = sorted_once[np.repeat(begin[which], many) + step] | np.repeat(owners > least[which], many)
        ends, rows = np.cumsum([int((s - length + 1).sum()) for s in sizes]), []
        for i, part in enumerate(np.split(found, ends[:-1])):
            rows.append((*[table.column(c)[i].as_py() for c in ("chunk", "bucket", "keys", "hot")], np.packbits(part).tobytes()))
        return _rows(["chunk", "bucket", "keys", "hot", "found"], [pa.int64(), pa.int64(), *[pa.binary()] * 3], rows)

    return run


def _cut(length: int, buckets: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        table, out, row = _in_order(table), [], 0
        carried = [table.column(n).combine_chunks() for n in names[4:]]
        chunk = _Chunk(table, length)
        pieces, place_of, least, of_part, *_ = chunk.contexts(_told(told, "keys"), _told(told, "hot"))
        windows = np.array([len(p) - length + 1 for p in pieces], np.int64)
        begin = np.cumsum(windows) - windows
        removed = np.zeros(int(windows.sum()), bool)
        bits = {b.as_py(): f.as_py() for b, f in zip(told.column("bucket"), told.column("found"))}
        for bucket, at in _groups(place_of, buckets):
            total = int(windows[at].sum())
            place = np.repeat(begin[at], windows[at]) + np.arange(total) - np.repeat(np.cumsum(windows[at]) - windows[at], windows[at])
            removed[place] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=total).astype(bool)
        for (ids, data, offsets, *_), (number, doc, first, many) in zip(chunk.parts, of_part):
            owner = np.repeat(np.arange(len(number)), many)
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            # The least document of equal texts here stands for them; the others repeat it.
            hit = removed[begin[number][owner] + step] | (doc > least[number])[owner]
            at = (first[owner] + step)[hit]
            change = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + length, minlength=len(data) + 1)
            covered = np.cumsum(change[:-1]) > 0
            starts, ends, rows = word_bounds(covered.astype(np.uint8), offsets, COVERED)
            keep, bounds = data[~covered].tobytes(), np.concatenate(([0], np.cumsum(~covered)))[offsets]
            heads = np.searchsorted(rows, np.arange(len(ids) + 1))
            in_row = offsets[rows]
            spans = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - in_row), pa.array(ends - in_row)], names=["start", "end"]))
            kept = pa.array([keep[bounds[i] : bounds[i + 1]] for i in range(len(ids))], pa.binary())
            out.append(pa.table([ids.cast(pa.int64()), pa.array(np.diff(offsets)), kept, spans.cast(spans_type), *[c.slice(row, len(ids)) for c in carried]], names=names))
            row += len(ids)
        return pa.concat_tables(out) if out else _rows(names, [pa.int64(), pa.int64(), pa.binary(), spans_type, *[c.type for c in carried]], [])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: Column | None = None, hot: int = HOT_PIECES) -> DataFrame:
    """Cut every byte that a string of ``length`` bytes covers which also starts in a document of smaller id.

    Texts are UTF-8 bytes; null is empty.  Strings are judged on the input.
    Returns one row per input row: ``doc_id``, ``n_bytes`` (of the input),
    ``kept`` (the remaining bytes) and ``spans`` (maximal removed runs as byte
    ranges).  A text shorter than ``length`` stays whole; so does a row with a
    null id, which removes nothing elsewhere either.  Rows that repeat an id
    don't remove from each other.  Ids are integers; other columns aren't read,
    but ``carry`` is one more column to bring along.

    Documents are dealt into chunks by a hash of the id and shuffled once; all
    three passes over the text read that shuffle.  What else moves is six bytes
    a distinct anchor and chunk, the compressed text around shared anchors, one
    bit per window, all by hash.  Equal texts within a chunk are sent once.
    Different texts on one anchor, as where a passage of many documents ends,
    are counted first; an anchor of more than about ``hot`` is split by the
    hash of the whole window, so equal windows still meet and a passage that a
    third of all documents have doesn't fill its bucket.
    """
    if length < 32:
        raise ValueError("length must be 32 or more")
    more = [] if carry is None else [carry.alias("carried")]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    chunks = max(LEAST_CHUNKS, total // CHUNK_BYTES)
    buckets = 4 * chunks
    dealt: Column = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks))
    held = docs.select(dealt.alias("chunk"), "*")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    schema = T.StructType([*schema.fields, *[docs.schema["carried"] for _ in more]])
    listed = held.groupBy("chunk").applyInArrow(_list_keys(length, chunks), "bucket long, chunk long, single binary, several binary, anchors binary, counts binary")
    told = listed.groupBy("bucket").applyInArrow(_match_keys(chunks, hot), "chunk long, shared binary, hot binary")
    sent = held.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _send_contexts(length, buckets), "bucket long, chunk long, pieces binary, sizes binary, owners binary, keys binary, hot binary")
    found = sent.groupBy("bucket").applyInArrow(_sort_bucket(length), "chunk long, bucket long, keys binary, hot binary, found binary")
    return held.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _cut(length, buckets, ["doc_id", "n_bytes", "kept", "spans", *(["carried"] if more else [])]), schema)
