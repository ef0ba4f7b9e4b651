"""Keyed state that built-in aggregates don't have: lives of entries with timers, and folds that idle keys leave.

Both processors emit rows that merge in any order, so the tables they feed are
a plain aggregate over the rows written so far, whatever was replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


NUMBER, TEXT = T.LongType(), T.StringType()
CHANGE = fields(
    key=TEXT, live=T.BooleanType(), value=TEXT, puts=NUMBER, first_put_ms=NUMBER, put_ms=NUMBER, expires_ms=NUMBER, changed_at=T.TimestampType())

Put = tuple[int, str, int]  # (time, value, time to live; none if not above 0)
Life = tuple[str, int, int, int, int]  # (value, puts, first put, last put, end; 0: none)


def lives_of(life: Life | None, puts: list[Put]) -> tuple[list[Life], Life | None]:
    """Lives that ended before a later put, and the one that goes on.

    A put within the life of the one before it, its last moment included,
    replaces value and end; a later one starts a new life.
    """
    ended = []
    for at, value, ttl in sorted(puts, key=lambda p: (p[0], p[1] is not None, p[1] or "", p[2])):
        end = at + ttl if ttl > 0 else 0
        if life is not None and life[4] and at > life[4]:
            ended.append(life)
            life = None
        life = (value, 1, at, at, end) if life is None else (value, life[1] + 1, life[2], at, end)
    return ended, life


class LiveEntries(StatefulProcessor):
    """Latest value of each key until its last put's time to live is over.

    Puts wait in the state until the watermark passes them, since one that is
    late but in time may join two lives; timers of event time then settle them
    and end lives.  With ``ends_only`` nothing but ended lives is emitted.
    """

    def __init__(self, ends_only: bool = False):
        self.ends_only = ends_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", fields(value=TEXT, puts=NUMBER, first_put_ms=NUMBER, put_ms=NUMBER, expires_ms=NUMBER))
        self.waiting = handle.getListState("waiting", fields(ts_ms=NUMBER, value=TEXT, ttl_ms=NUMBER))

    def _settled(self) -> Life | None:
        return tuple(self.life.get()) if self.life.exists() else None

    def _puts(self) -> list[Put]:
        return [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []

    @staticmethod
    def _rows(key: Any, lives: list[Life], live: bool) -> pd.DataFrame:
        at = [x[3] if live else x[4] for x in lives]
        return pd.DataFrame({
            "key": [key[0]] * len(lives), "live": live, **{name: [x[i] for x in lives] for i, name in enumerate(CHANGE.names[2:7])},
            "changed_at": pd.to_datetime(at, unit="ms")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: list[Put] = []
        for batch in rows:
            fresh += [(int(t), v, int(x)) for t, v, x in zip(batch["ts_ms"], batch["value"], batch["ttl_ms"])]
        if not fresh:
            return
        self.waiting.appendList(fresh)
        self.handle.registerTimer(min(p[0] for p in fresh))
        if not self.ends_only:
            _, now = lives_of(self._settled(), self._puts())
            yield self._rows(key, [now], True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        puts = self._puts()
        later = [p for p in puts if p[0] > passed]
        ended, life = lives_of(self._settled(), [p for p in puts if p[0] <= passed])
        if life is not None and 0 < life[4] <= passed:
            ended, life = [*ended, life], None
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(p[0] for p in later))
        else:
            self.waiting.clear()
        if life is None:
            self.life.clear()
        else:
            self.life.update(life)
            if life[4]:
                self.handle.registerTimer(life[4])
        if ended:
            yield self._rows(key, ended, False)


FOLD = fields(last_registered=NUMBER, last_committed=NUMBER, last_evicted=NUMBER, last_resident=NUMBER, size_at=NUMBER, size_bytes=NUMBER, updated_ms=NUMBER)


class LatestEvents(StatefulProcessor):
    """The greatest of each column per key, emitted whenever rows of the key come; ``size_bytes`` is that of the greatest ``size_at``.

    A key that is idle for ``idle_ms`` leaves the state.  Rows that come later
    start it anew, and what was emitted before still counts where the emitted
    rows are merged.  Keys have few rows each, so they come as rows; a data
    frame for each key would cost more than the fold.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", FOLD, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = [tuple(row[name] for name in FOLD.names) for row in rows]
        if not seen:
            return
        if self.fold.exists():
            seen.append(tuple(self.fold.get()))
        held = greatest(seen)
        self.fold.update(held)
        yield Row(key=key[0], **dict(zip(FOLD.names, held)))


def greatest(rows: list[tuple[int | None, ...]]) -> tuple[int | None, ...]:
    """Of rows of ``FOLD`` the greatest of each column, nulls aside; the size is that of the greatest (time, size)."""
    out = {name: max((x for x in column if x is not None), default=None) for name, column in zip(FOLD.names, zip(*rows))}
    at, size = FOLD.names.index("size_at"), FOLD.names.index("size_bytes")
    sized = max(((r[at], r[size] is not None, r[size] or 0) for r in rows if r[at] is not None), default=(None, False, 0))
    out["size_bytes"] = sized[2] if sized[1] else None
    return tuple(out[name] for name in FOLD.names)
