"""Toxicity scores from subword-bag embeddings and a linear softmax, trained together in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkeep.llm.common import ALNUM_OR_HIGH, LOWER, U, give_back, slices, word_bounds

BUCKETS_LOG2 = 18
GRAMS = (4, 5, 6)  # bytes, the blank on either side of a word included
DIM = 4
SEGMENT = 2  # words whose bags are averaged before the softmax
SAMPLE_PER_CLASS = 800  # labelled rows of each class that the model is fitted on, at most
CALIBRATE_EVERY, FALSE_ALARM = 4, 3.0
LEAST_DOCS = 3  # a subword that fewer sampled documents have isn't learnt
STEPS, AVERAGED_STEPS, RATE, MOMENTUM = 40, 10, 1.0, 0.7
HASH = U(0x9E3779B97F4A7C15)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the subwords of each word, and where each word's begin.

    A word between blanks gives its byte n-grams and itself as a whole, so words
    that differ in a letter or an ending share most of their subwords.
    """
    sizes = ends - starts
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = np.full(int(begin[-1]) + 16, 0x20, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[begin[:-1][owner] + 1 + inner] = data[starts[owner] + inner]
    words = np.ndarray((int(begin[-1]) + 8,), dtype="<u8", buffer=joined, strides=(1,))
    # Of each size: the grams that start at or after the leading blank and end at or before the next one.
    counts = [np.maximum(sizes + 3 - n, 0) for n in GRAMS]
    total = sum(counts) + 1
    first = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(int(first[-1]), np.int64)
    shift = U(64 - BUCKETS_LOG2)
    at = first[:-1].copy()
    for n, count in zip(GRAMS, counts):
        who = np.repeat(np.arange(len(sizes)), count)
        step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        h = ((words[begin[:-1][who] + step] & U((1 << 8 * n) - 1)) * HASH + U(n)) * HASH
        out[at[who] + step] = ((h ^ (h >> U(32))) * HASH >> shift).astype(np.int64)
        at += count
    # Whole words: sums of mixed eight-byte pieces tell them apart well enough.
    whole = np.zeros(len(sizes), U)
    for piece in range(0, int(sizes.max(initial=0)), 8):
        there = np.flatnonzero(sizes > piece)
        left = np.minimum(sizes[there] - piece, 8).astype(U)
        value = words[begin[:-1][there] + 1 + piece] & (~U(0) >> (U(64) - U(8) * left))
        h = (whole[there] + value + U(piece + 1)) * HASH
        whole[there] = h ^ (h >> U(32))
    out[at] = ((whole ^ (whole >> U(32))) * HASH >> shift).astype(np.int64)
    return out, first


@dataclass
class ToxicityModel:
    """``embedding`` (buckets x DIM), softmax ``weight`` (DIM x 2) and ``bias``."""

    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What each subword adds to the log-odds: averaging and the softmax are linear."""
        return (self.embedding @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float32)

    def log_odds_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Means of runs of rows; no run is empty."""
    sizes = np.diff(bounds)
    return np.add.reduceat(values, bounds[:-1], axis=0) / (sizes[:, None] if values.ndim > 1 else sizes)


def _scatter(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, d], n) for d in range(values.shape[1])], axis=1)


def _segments(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds of the segments, segment bounds of the rows that have words, and those rows."""
    counts = np.bincount(rows, minlength=n_rows)
    held = np.flatnonzero(counts)
    pieces = -(-counts[held] // SEGMENT)
    seg_bounds = np.concatenate(([0], np.cumsum(pieces)))
    first_word = np.cumsum(counts[held]) - counts[held]
    owner = np.repeat(np.arange(len(held)), pieces)
    starts = first_word[owner] + SEGMENT * (np.arange(seg_bounds[-1]) - seg_bounds[owner])
    return np.concatenate((starts, [len(rows)])), seg_bounds, held


def _texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    return LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets


def train(texts: list[str | None], toxic: list[int]) -> ToxicityModel | None:
    """Fit embeddings and softmax together by full-batch Adam; None unless both labels occur.

    First every segment of a document counts alike.  Then a document is its
    most toxic segment, so an insult in a long text isn't averaged away and
    the worst segment of a clean text becomes its counterexample.
    """
    data, offsets = _texts(texts)
    starts, ends, rows = word_bounds(data, offsets, ALNUM_OR_HIGH)
    seg_words, doc_segs, held = _segments(rows, len(texts))
    y = np.asarray(toxic, np.int64)[held]
    if len(set(y.tolist())) < 2:
        return None
    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    first_at, word_of = [], np.empty(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        number = numbers.setdefault(raw[s:e], len(numbers))
        if number == len(first_at):
            first_at.append(i)
        word_of[i] = number
    feats, feat_bounds = subwords(data, starts[first_at], ends[first_at])
    # Subwords of several documents are trained; the others stay at zero and say nothing.
    doc_of_word = np.repeat(np.arange(len(y)), np.bincount(rows, minlength=len(texts))[held])
    pairs = np.unique(np.stack((word_of, doc_of_word)), axis=1)
    docs_of = np.bincount(feats, np.repeat(np.bincount(pairs[0], minlength=len(first_at)), np.diff(feat_bounds)), minlength=1 << BUCKETS_LOG2)
    used = np.flatnonzero(docs_of >= LEAST_DOCS)
    place = np.zeros(1 << BUCKETS_LOG2, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    feats = place[feats]
    rng = np.random.default_rng(5)
    params = [rng.normal(0, 0.001, (len(used) + 1, DIM)), rng.normal(0, 1.0, (DIM, 2)), np.zeros(2)]
    speed = [np.zeros_like(p) for p in params]
    class_weight = len(y) / (2.0 * np.bincount(y, minlength=2))[y] / len(y)
    feat_sizes, seg_sizes, n_segs = np.diff(feat_bounds), np.diff(seg_words), np.diff(doc_segs)
    seg_doc, target = np.repeat(np.arange(len(y)), n_segs), np.eye(2)[y]
    for step in range(1, STEPS + 1):
        emb, weight, bias = params
        words = _means(emb[feats], feat_bounds)
        segs = _means(words[word_of], seg_words)
        logits = segs @ weight + bias
        if step <= AVERAGED_STEPS:
            share = 1.0 / n_segs[seg_doc]
            docs = np.add.reduceat(logits * share[:, None], doc_segs[:-1], axis=0)
        else:
            odds = logits[:, 1] - logits[:, 0]
            top = np.maximum.reduceat(odds, doc_segs[:-1])
            share = np.exp(4 * (odds - top[seg_doc]))
            share /= np.add.reduceat(share, doc_segs[:-1])[seg_doc]
            docs = np.add.reduceat(logits * share[:, None], doc_segs[:-1], axis=0)
        p = np.exp(docs - docs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d_logits = ((p - target) * class_weight[:, None])[seg_doc] * share[:, None]
        d_segs = d_logits @ weight.T
        d_words = _scatter(np.repeat(d_segs / seg_sizes[:, None], seg_sizes, axis=0), word_of, len(feat_sizes))
        grads = [_scatter(np.repeat(d_words / feat_sizes[:, None], feat_sizes, axis=0), feats, len(used) + 1), segs.T @ d_logits, d_logits.sum(axis=0)]
        grads[0][0] = 0
        # Steps are scaled per matrix, not per weight, so what many documents show moves furthest.
        for k, grad in enumerate(grads):
            speed[k] = MOMENTUM * speed[k] - (RATE if k == 0 else RATE / 20) * grad / (np.abs(grad).max() + 1e-12)
            params[k] = params[k] + speed[k]
    whole = np.zeros((1 << BUCKETS_LOG2, DIM))
    whole[used] = params[0][1:]
    return ToxicityModel(whole, params[1], params[2])


def calibrated(model: ToxicityModel, texts: list[str | None], toxic: list[int]) -> ToxicityModel:
    """Moves the bias to the cut that serves rows apart from the fit best, where a false alarm costs ``FALSE_ALARM`` misses."""
    y = np.asarray(toxic)
    if len(set(y.tolist())) < 2:
        return model
    scores = score_column(pa.array([t or "" for t in texts]), model.bucket_scores(), model.log_odds_bias())
    odds = np.log(np.maximum(scores, 1e-30)) - np.log1p(-np.minimum(scores, 1 - 1e-15))
    steps = np.unique(odds)
    cuts = np.concatenate(([0.0], (steps[1:] + steps[:-1]) / 2))
    gain = [(odds[y == 1] >= c).mean() - FALSE_ALARM * (odds[y == 0] >= c).mean() for c in cuts]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    middle = float(cuts[best[np.argsort(cuts[best])[len(best) // 2]]])
    return ToxicityModel(model.embedding, model.weight, model.bias - np.array([0.0, middle]))


def score_column(column: pa.Array, bucket_scores: np.ndarray, bias: float) -> np.ndarray:
    """Scores of whole texts: the probability of the most toxic segment; 0 without words."""
    out = np.zeros(len(column))
    for first, last, raw, offsets in slices(column):
        data = LOWER[raw]
        starts, ends, rows = word_bounds(data, offsets, ALNUM_OR_HIGH)
        if not len(starts):
            continue
        feats, bounds = subwords(data, starts, ends)
        words = _means(bucket_scores[feats].astype(np.float64), bounds)
        seg_words, doc_segs, held = _segments(rows, last - first)
        top = np.maximum.reduceat(_means(words, seg_words) + bias, doc_segs[:-1])
        out[first + held] = 1.0 / (1.0 + np.exp(-np.clip(top, -60, 60)))
    return out


def _scorer(bucket_scores, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bucket_scores is None else bucket_scores.value
        for batch in batches:
            scores = np.zeros(batch.num_rows) if table is None else score_column(batch.column(batch.num_columns - 1), table, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])
        give_back()

    return run


def held_out(id_col: Column) -> Column:
    """The fold that no model sees: crc32 of the id as text is a multiple of five."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel | None:
    """Fit on at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    Rows of the held-out fold, null ids and labels other than 0 and 1 are left out; of several labels for one id the largest counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    rows = sorted((r.id, r.text or "", r.y) for r in texts.collect())
    # The rows are in id order; every fourth of a class sets the cut and isn't fitted on.
    apart, seen = [], [0, 0]
    for row in rows:
        seen[row[2]] += 1
        apart.append(seen[row[2]] % CALIBRATE_EVERY == 0)
    fit, rest = ([r for r, a in zip(rows, apart) if a == side] for side in (False, True))
    model = train([r[1] for r in fit], [r[2] for r in fit])
    return None if model is None else calibrated(model, [r[1] for r in rest], [r[2] for r in rest])


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from whole texts, without a shuffle.

    A text without words (null, empty) scores 0, as everything does when there
    was no model to fit.  Only the id and the text are read, but ``carry`` is
    one more column to bring along; repeated rows and null ids score like any
    other.
    """
    more = [] if carry is None else [carry.alias("carried")]
    held = docs.select(F.col(id_col).alias("doc_id"), *more, F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    table = None if model is None else context.broadcast(model.bucket_scores())
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return held.mapInArrow(_scorer(table, 0.0 if model is None else model.log_odds_bias()), schema)
