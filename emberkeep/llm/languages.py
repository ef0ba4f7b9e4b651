"""Language of documents: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import U, mixed, slices

SAMPLE_PER_LANGUAGE = 2_000  # documents of a language that the model is counted over, as expected of a hash of the id
BUCKETS_LOG2 = 18
GRAMS = 4  # letters, the blank on either side of a word included
SMOOTHING = 0.5
LEAST_COUNT = 2  # subwords seen less often aren't learnt
LEAST_SHARE = 0.01  # of a language's words, for a script to be one of its own
WORD_LIMIT, SWITCH = 8.0, 12.0  # most that a word can say, and what a change of language costs
NOT_CANDIDATE = -1_000.0
SLICE, CHUNK = 1 << 20, 64  # bytes of text at a time, words between two entries of the search
UNDETERMINED = "und"
SPANS = "array<struct<start:int,end:int,lang:string>>"

# Blocks of the Unicode standard that hold the letters of a script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "gurmukhi": ((0xA00, 0xA7F),), "gujarati": ((0xA80, 0xAFF),), "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),), "kannada": ((0xC80, 0xCFF),), "malayalam": ((0xD00, 0xD7F),), "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),), "lao": ((0xE80, 0xEFF),), "tibetan": ((0xF00, 0xFFF),), "myanmar": ((0x1000, 0x109F),), "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "ethiopic": ((0x1200, 0x139F),), "khmer": ((0x1780, 0x17FF),), "mongolian": ((0x1800, 0x18AF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}
OTHER, MARK = len(SCRIPTS) + 1, len(SCRIPTS) + 2


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its script (0: no letter; ``MARK``: a sign that belongs to the letter before it) and its lower case."""
    import unicodedata

    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        sign = chr(c)
        if sign.isalpha():
            script[c] = OTHER
            small = sign.lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif c >= 0x300 and unicodedata.category(sign) in ("Mn", "Mc"):
            script[c] = MARK
    for number, blocks in enumerate(SCRIPTS.values(), 1):
        for low, high in blocks:
            block = script[low : high + 1]
            block[block == OTHER] = number
    return script, lower


@dataclass
class Words:
    """The words of some texts: places in code points from each text's start, rows, and the distinct ones with their subwords."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    distinct: np.ndarray  # number of each word among the distinct ones
    scripts: np.ndarray  # of the distinct ones
    grams: np.ndarray  # buckets of the subwords of the distinct ones
    gram_words: np.ndarray


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts in UTF-8, and where each text's begin; bytes that aren't UTF-8 become replacement signs."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(text.encode("utf-32-le"), "<u4"), heads[offsets]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of letters and their signs, in lower case; a run without a letter is none, and none crosses a text's end."""
    script_of, lower = letter_tables()
    points, offsets = code_points(data, offsets)
    scripts = script_of[points]
    inside = scripts > 0
    before = np.concatenate(([False], inside[:-1]))
    heads = offsets[:-1][offsets[:-1] < len(points)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(np.concatenate((~inside[1:], [True])) | np.isin(np.arange(1, len(points) + 1), heads)) if len(points) else np.zeros(0, np.int64)
    ends = stop[inside[stop]] + 1
    # A run's script is that of its first letter.
    letters = np.flatnonzero(inside & (scripts != MARK))
    first = np.searchsorted(letters, starts)
    real = (first < len(letters)) & (letters[np.minimum(first, max(len(letters) - 1, 0))] < ends) if len(letters) else np.zeros(len(starts), bool)
    starts, ends, first = starts[real], ends[real], first[real]
    rows = np.searchsorted(offsets, starts, "right") - 1
    places = starts - offsets[rows], ends - offsets[rows]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(*places, rows, none, none, none, none)
    points = lower[points].astype(U)
    hashes = _run_hashes(points, starts, ends)
    known, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    grams, owners = _subwords(points, starts[at], ends[at], known)
    return Words(*places, rows, number, scripts[letters[first[at]]].astype(np.int64), grams, owners)


def _run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base = 0x5851F42D4C957F2D
    powers = []
    for b in (base, pow(base, -1, 2**64)):
        column = np.full(len(points) + 1, U(b))
        column[0] = U(1)
        powers.append(np.cumprod(column))
    total = np.concatenate((np.zeros(1, U), np.cumsum(mixed(points, 3) * powers[0][:-1])))
    return mixed((total[ends] - total[starts]) * powers[1][starts] + (ends - starts).astype(U))


def _subwords(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's grams of 1 to ``GRAMS`` letters, between blanks, and of itself; and whose they are."""
    sizes = ends - starts
    begin = np.concatenate(([0], np.cumsum(sizes + 2)))
    padded = np.full(int(begin[-1]) + GRAMS, U(0x20))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[begin[owner] + 1 + inner] = points[starts[owner] + inner]
    of = np.repeat(np.arange(len(sizes)), sizes + 2)
    left = begin[1:][of] - np.arange(len(of))
    h, out, owners = np.zeros(len(of), U), [hashes], [np.arange(len(sizes))]
    for n in range(1, GRAMS + 1):
        h = mixed(h ^ padded[n - 1 : n - 1 + len(of)], n)
        there = left >= n
        out.append(h[there])
        owners.append(of[there])
    return (np.concatenate(out) >> U(64 - BUCKETS_LOG2)).astype(np.int64), np.concatenate(owners)


@dataclass
class LanguageModel:
    """``languages`` by name, ``place`` (bucket to row, 0: not learnt), ``scores`` (rows x languages) and ``scripts`` (script x language: whether it is used)."""

    languages: list[str]
    place: np.ndarray
    scores: np.ndarray
    scripts: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """What each distinct word says for each language; languages that don't use its script, if any does, are no candidates."""
        rows, n = self.place[words.grams], len(words.scripts)
        found = np.stack([np.bincount(words.gram_words, self.scores[rows, k], n) for k in range(len(self.languages))], axis=1)
        found = np.clip(found / 2, -WORD_LIMIT, WORD_LIMIT)  # grams of a word overlap
        used = self.scripts[words.scripts]
        return np.where(used.any(axis=1, keepdims=True) & ~used, NOT_CANDIDATE, found)


def most_likely_path(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi: for each run of rows the states that score most, a change of state costing ``switch``.

    Runs are cut into chunks of ``CHUNK`` rows.  All chunks at once find their
    best score from every state before to every state after them; these
    matrices are chained along each run; then all chunks at once trace the path
    between the states found.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    pieces = -(-sizes // CHUNK)
    first = np.concatenate(([0], np.cumsum(pieces)))
    run = np.repeat(np.arange(len(sizes)), pieces)
    start = bounds[run] + CHUNK * (np.arange(first[-1]) - first[run])
    length = np.minimum(CHUNK, bounds[run + 1] - start)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(CHUNK), "left")  # chunks longer than each step

    def forward(value: np.ndarray, seen) -> np.ndarray:
        for step in range(CHUNK):
            m = active[step]
            if not m:
                break
            now, at = value[:m], start[order[:m]] + step
            top = now.max(axis=-1, keepdims=True) - switch
            seen(step, m, now, top)
            value[:m] = np.maximum(now, top) + (scores[at][:, None, :] if value.ndim == 3 else scores[at])
        return value

    whole = np.empty((len(start), k, k))
    whole[order] = forward(np.where(np.eye(k, dtype=bool), 0.0, -1e15)[None].repeat(len(start), 0), lambda *_: None)
    # Along the runs, the one with most chunks first.
    by_count = np.argsort(-pieces, kind="stable")
    value, came = np.zeros((len(sizes), k)), np.zeros((len(start), k), np.int64)
    for step in range(int(pieces.max(initial=0))):
        held = by_count[: np.searchsorted(-pieces[by_count], -step, "left")]
        chain = value[held][:, :, None] + whole[first[held] + step]
        came[first[held] + step] = chain.argmax(axis=1)
        value[held] = chain.max(axis=1)
    enter, leave, state = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), value.argmax(axis=1)
    for step in range(int(pieces.max(initial=0)) - 1, -1, -1):
        held = by_count[: np.searchsorted(-pieces[by_count], -step, "left")]
        at = first[held] + step
        leave[at] = state[held]
        enter[at] = state[held] = came[at, state[held]]
    back = np.zeros((CHUNK, len(start), k), np.uint8 if k <= 256 else np.int64)

    def note(step: int, m: int, now: np.ndarray, top: np.ndarray) -> None:
        back[step, :m] = np.where(top > now, now.argmax(axis=-1)[:, None], np.arange(k)[None, :])

    forward(np.where(np.arange(k)[None, :] == enter[order][:, None], 0.0, -1e15), note)
    out, state = np.zeros(n, np.int64), leave[order].copy()
    for step in range(CHUNK - 1, -1, -1):
        m = active[step]
        out[start[order[:m]] + step] = state[:m]
        state[:m] = back[step, np.arange(m), state[:m]]
    return out


def label_texts(column: pa.Array, model: LanguageModel | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and spans of each text."""
    languages, scores, spans = [], [], []
    names = np.array([*(model.languages if model else []), UNDETERMINED], dtype=object)
    for first, last, data, offsets in slices(column, SLICE):
        n = last - first
        chosen, share, pieces = np.full(n, len(names) - 1), np.zeros(n), (np.zeros(n + 1, np.int32), *[np.zeros(0, np.int32)] * 3)
        words = find_words(data, offsets)
        if model is not None and len(words.starts):
            k = len(model.languages)
            said = model.word_scores(words)[words.distinct]
            bounds = np.searchsorted(words.rows, np.arange(n + 1))
            path = most_likely_path(said, bounds, SWITCH)
            letters = words.ends - words.starts
            held = np.bincount(words.rows * k + path, letters, n * k).reshape(n, k)
            total = held.sum(axis=1)
            some = total > 0
            chosen[some] = held[some].argmax(axis=1)
            share[some] = held[some].max(axis=1) / total[some]
            begins = np.flatnonzero(np.concatenate(([True], (np.diff(words.rows) != 0) | (np.diff(path) != 0))))
            ends = np.concatenate((begins[1:], [len(path)])) - 1
            counts = np.concatenate(([0], np.cumsum(np.bincount(words.rows[begins], minlength=n))))
            pieces = (counts.astype(np.int32), words.starts[begins].astype(np.int32), words.ends[ends].astype(np.int32), path[begins])
        languages.append(pa.array(names[chosen].tolist(), pa.string()))
        scores.append(pa.array(share))
        parts = [pa.array(pieces[1], pa.int32()), pa.array(pieces[2], pa.int32()), pa.array(names[pieces[3]].tolist(), pa.string())]
        spans.append(pa.ListArray.from_arrays(pa.array(pieces[0], pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "end", "lang"])))
    return pa.concat_arrays(languages), pa.concat_arrays(scores), pa.concat_arrays(spans)


def _label_kernel(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if shared is None else shared.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *label_texts(batch.column(1), model)], names=["doc_id", "lang", "score", "spans"])

    return run


def _count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the subwords of each slice, and as negative buckets the scripts of its words."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        for number, name in enumerate(names.dictionary.to_pylist()):
            mine = batch.column(1).filter(pa.array(names.indices.to_numpy() == number))
            for _, _, data, offsets in slices(mine, SLICE):
                words = find_words(data, offsets)
                often = np.bincount(words.distinct, minlength=len(words.scripts))
                counts = np.bincount(words.grams, often[words.gram_words], 1 << BUCKETS_LOG2) if len(often) else np.zeros(0)
                scripts = np.bincount(words.scripts, often) if len(often) else np.zeros(0)
                grams, kinds = np.flatnonzero(counts), np.flatnonzero(scripts)
                buckets, sums = np.concatenate((grams, -kinds)), np.concatenate((counts[grams], scripts[kinds])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(buckets), pa.string()), pa.array(buckets.astype(np.int32)), pa.array(sums)], names=["lang", "bucket", "n"])


def held_out(id_col: Column) -> Column:
    """The fold that no model sees: crc32 of the id as text leaves 2 when divided by four; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Counts subwords and scripts of a sample of each language's documents; None where there is nothing to learn from.

    Rows of the held-out fold and those with a null id, text or language are
    left out.  Of a language with more than ``per_language`` documents a hash
    of the id keeps about that many.  Counts are added up by Spark; the driver
    gets one number per bucket and language, 2^18 a language at most.  The
    number of languages is the width of the model.
    """
    held = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    held = held.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = held.groupBy("lang").agg(F.count("*").alias("size"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = held.join(F.broadcast(sizes), "lang").where(draw * F.col("size") < per_language).select("lang", "text")
    counts = picked.mapInArrow(_count_kernel, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return model_from_counts(counts.toArrow())


def model_from_counts(counts: pa.Table) -> LanguageModel | None:
    if counts.num_rows == 0:
        return None
    names, buckets, n = counts["lang"].combine_chunks().dictionary_encode(), counts["bucket"].to_numpy(), counts["n"].to_numpy().astype(np.float64)
    found = names.dictionary.to_pylist()
    languages = sorted(found)
    which = np.array([languages.index(x) for x in found])[names.indices.to_numpy()]
    scripts = np.zeros((MARK + 1, len(languages)))
    kinds = buckets < 0
    scripts[-buckets[kinds], which[kinds]] = n[kinds]
    used = scripts >= LEAST_SHARE * scripts.sum(axis=0)
    used[scripts == 0] = False
    buckets, which, n = buckets[~kinds], which[~kinds], n[~kinds]
    total = np.bincount(which, n, len(languages)) + SMOOTHING * (1 << BUCKETS_LOG2)
    kept = np.flatnonzero(np.bincount(buckets, n, 1 << BUCKETS_LOG2) >= LEAST_COUNT)
    place = np.zeros(1 << BUCKETS_LOG2, np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    table = np.zeros((len(kept) + 1, len(languages)))
    table[place[buckets], which] = n
    likely = np.log((table + SMOOTHING) / total)
    likely -= likely.mean(axis=1, keepdims=True)
    likely[0] = 0.0
    return LanguageModel(languages, place, likely, used)


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang``, ``score`` and ``spans`` of every row, from whole texts, without a shuffle.

    ``spans`` are (start, end, lang) in code points: runs of words of one
    language on the most likely path.  A document's language is the one whose
    spans hold most letters (ties: the first by name), its score their share.
    A text that is null, empty or without a letter is ``und`` with score 0 and
    no spans, as all are when there was no model to fit.  Words of a script
    that no learnt language uses say nothing for or against any.  Only the id
    and the text are read; repeated rows and null ids are labelled like any.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    return held.mapInArrow(_label_kernel(shared), f"doc_id {held.schema['doc_id'].dataType.simpleString()}, lang string, score double, spans {SPANS}")
