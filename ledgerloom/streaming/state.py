"""Keyed state of the streaming meter and of the daily admission."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH = dt.date(1970, 1, 1).toordinal()


class RollingMeter(StatefulProcessor):
    """Tokens of the last window per (pool, bucket), given out once no earlier request can come.

    Requests wait until the watermark has passed them, in any order of arrival. The
    state holds those that wait and those within a window before them; it ends with
    the bucket. Rows without a pool only move the watermark and are not held.
    """

    def __init__(self, window: int, budget: int) -> None:
        self.window, self.budget = window, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us bigint, tokens bigint, request_id bigint, home boolean, sent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows if key[0] is not None else ():
            self.held.appendList([(int(u), int(t), int(r), bool(h), False) for u, t, r, h in zip(part["us"], part["tokens"], part["request_id"], part["home"])])
            least = int(part["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get()) if self.held.exists() else []
        at = np.array([r[0] for r in rows], dtype="int64")
        running = np.concatenate([[0], np.cumsum(np.array([r[1] for r in rows], dtype="int64"))])
        due = [i for i, r in enumerate(rows) if not r[4] and r[0] // 1000 * 1000 < passed]
        us = at[due]
        used = running[np.searchsorted(at, us, "right")] - running[np.searchsorted(at, us - self.window, "right")]
        out = [(key[0], rows[i][2], int(u), int(n), bool(n > self.budget)) for i, u, n in zip(due, us, used) if rows[i][3]]
        sent = set(due)
        waiting = [r[0] for i, r in enumerate(rows) if not r[4] and i not in sent]
        # A request that may still come lies after the watermark and looks back one window.
        needed = min([passed, *waiting]) - self.window
        kept = [(*r[:4], r[4] or i in sent) for i, r in enumerate(rows) if r[0] > needed]
        if waiting:
            self.handle.registerTimer(min(waiting) // 1000)
        elif kept:
            # Nothing waits; look again when the last one has left every window.
            self.handle.registerTimer((kept[-1][0] + self.window) // 1000 + 1)
        if kept:
            self.held.put(kept)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["pool", "request_id", "us", "used", "over_budget"])

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Requests of a (day, salt) in the order of their time, the first ``cap`` of them, once no earlier one can come.

    The state holds those that wait, never more than may still be given out, and goes
    when the watermark has passed the day. Rows without a day only move the watermark.
    """

    DAY_MS = 86_400_000

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, request_id bigint")
        self.given = handle.getValueState("given", "n bigint")

    def _places(self) -> int:
        return self.cap - (int(self.given.get()[0]) if self.given.exists() else 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return iter([])
        held = [(int(u), int(r)) for u, r in self.waiting.get()] if self.waiting.exists() else []
        for part in rows:
            held += [(int(u), int(r)) for u, r in zip(part["us"], part["request_id"])]
            held = sorted(held)[: self._places()]
        if held:
            self.waiting.put(held)
            self.handle.registerTimer(held[0][0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(int(u), int(r)) for u, r in self.waiting.get()] if self.waiting.exists() else []
        out = [row for row in held if row[0] <= passed]
        held = held[len(out) :]
        places = self._places() - len(out)
        end = (key[0].toordinal() - EPOCH + 1) * self.DAY_MS
        if passed >= end * 1000:
            self.waiting.clear()
            self.given.clear()
        else:
            self.given.update((self.cap - places,))
            held = held[:places]
            if held:
                self.waiting.put(held)
                self.handle.registerTimer(held[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
                self.handle.registerTimer(end)
        yield pd.DataFrame([(key[0], r, u) for u, r in out], columns=["day", "request_id", "us"])

    def close(self) -> None:
        pass
