"""License scan: exact phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import ALNUM_OR_HIGH, LOWER, slices

# The phrases that are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Notice:
    """A notice as lower-case words; ``edits`` is how many letters may be inserted, deleted or changed."""

    label: str
    words: str
    edits: int

    def seeds(self) -> list[tuple[int, str]]:
        """The words cut into edits + 1 pieces: whoever matches holds one of them unchanged."""
        bounds = np.linspace(0, len(self.words), self.edits + 2).astype(int).tolist()
        return [(low, self.words[low:high]) for low, high in zip(bounds, bounds[1:])]


NOTICES = (
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl", "mozilla public license version 2 0", 3),
    Notice("reserved", "all rights reserved", 2),
)

_SEPARATED = np.where(ALNUM_OR_HIGH[LOWER], LOWER, 0x20).astype(np.uint8)


class Scanner:
    """Finds seeds of all notices in one pass and verifies edits around them."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}") for n in notices]
        held: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, seed in notice.seeds():
                held.setdefault(seed, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for seed, places in held.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of verified matches in words between blanks; overlapping windows of one notice join."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for i, offset in places:
                notice = self.notices[i]
                low = max(0, end + 1 - size - offset - notice.edits)
                high = min(len(text), end + 1 - size - offset + len(notice.words) + notice.edits)
                spans = windows.setdefault(i, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], low), max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        out = []
        for i, spans in windows.items():
            for low, high in spans:
                for match in self.patterns[i].finditer(text, low, high, overlapped=False):
                    out.append((i, match.start(), match.end(), sum(match.fuzzy_counts)))
        return out


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words stand, as offsets of its first letter; overlaps count."""
    found, at = [], text.find(b" " + phrase + b" ")
    while at >= 0:
        found.append(at + 1)
        at = text.find(b" " + phrase + b" ", at + 1)
    return found


def scan_text(raw: bytes, notices: tuple[Notice, ...] = NOTICES) -> dict:
    """Counts, labels and spans of one text that already is lower-case words and blanks."""
    words = raw.split()
    text = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES:
        for at in _places(text, phrase.encode()):
            starts.append(text.count(b" ", 0, at) - 1)
            base.add(label)
    shown = text.decode("utf-8", "replace")
    spans, best = [], 1.0 if base else 0.0
    for i, low, high, edits in _scanner(notices).find(shown):
        notice = notices[i]
        best = max(best, 1 - edits / len(notice.words))
        first = shown.count(" ", 0, low + 1) - 1
        spans.append({"label": notice.label, "first_word": max(first, 0), "last_word": max(shown.count(" ", 0, high) - 1, 0), "edits": edits})
    spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"]))
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})), "score": best, "spans": spans,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
TYPES = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))),
]


def _kernel(notices: tuple[Notice, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, raw, offsets in slices(batch.column(1)):
                clean = _SEPARATED[raw].tobytes()
                found += [scan_text(clean[low:high], notices) for low, high in zip(offsets.tolist(), offsets[1:].tolist())]
            columns = [pa.array([f[name] for f in found], kind) for name, kind in TYPES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[name for name, _ in TYPES]])

    return run


def scan_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the fixed phrases, labels, score and verified spans of every whole text.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all bytes from
    0x80 on.  ``n_base`` counts the places of the phrases, ``first_word`` and
    ``last_word`` their least and greatest word; ``labels`` adds the notices
    that match with bounded edits, whose word ranges and edits are ``spans``;
    ``score`` is 1 with a phrase, else the closest notice's share of unchanged
    letters, else 0.  A notice matches wherever one of its seeds stands, so no
    match within its edits is missed.

    A null or empty text has no words, labels "" and score 0.  One row per
    input row, in place, without a shuffle; ids of any type pass through,
    repeated and null ones too, and other columns aren't read.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return held.mapInArrow(_kernel(tuple(notices)), f"doc_id {held.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
