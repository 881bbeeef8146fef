"""Keyed state machines of the streaming jobs (small per-key helpers for Spark's state)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_MS = 1000


class Event(NamedTuple):
    seq: int
    kind: str
    at: int


def _in_order(rows: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    """All rows of one key in one micro-batch (bounded by the source's rate limit)."""
    return pd.concat(list(rows)).sort_values(column, kind="stable")


class BlockAssembler(StatefulProcessor):
    """Buffers the pages of one block of a bundle until all of them arrived.

    A block has at most ``size`` pages, so no key holds more. A block that stays
    incomplete for ``ttl`` seconds of event time is given up.
    """

    def __init__(self, size: int, ttl_seconds: int) -> None:
        self.size, self.ttl_ms = size, ttl_seconds * _MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_number int", "text string")
        self.meta = handle.getValueState("meta", "page_count long, seen long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues):
        bundle, block = int(key[0]), int(key[1])
        page_count, seen, done = self.meta.get() if self.meta.exists() else (None, 0, False)
        if done:
            return
        fresh = page_count is None
        for frame in rows:
            for row in frame.itertuples(index=False):
                page_count = int(row.page_count)
                if pd.isna(row.page_number):  # announced by a neighbouring block
                    continue
                page = (int(row.page_number),)
                if not self.pages.containsKey(page):
                    seen += 1
                self.pages.updateValue(page, (row.text or "",))
            if fresh:
                first = int(frame["ts"].min().timestamp() * _MS)
                self.handle.registerTimer(
                    max(first, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms
                )
                fresh = False
        if seen < self._expected(key, page_count):
            self.meta.update((page_count, seen, False))
            return
        found = sorted((k[0], v[0]) for k, v in self.pages.iterator())
        self.pages.clear()
        # remembered until the timer fires, so late copies do not start over
        self.meta.update((page_count, seen, True))
        yield pd.DataFrame(
            {
                "bundle_id": bundle, "block": block,
                "page_number": [p for p, _ in found], "text": [t for _, t in found],
                "page_count": page_count, "error": None,
            }
        )

    def _expected(self, key: Any, page_count: int) -> int:
        return min(self.size, page_count - int(key[1]) * self.size)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo):
        page_count, seen, done = self.meta.get()
        self.pages.clear()
        self.meta.clear()
        if not done:
            yield pd.DataFrame(
                {
                    "bundle_id": [int(key[0])], "block": [int(key[1])], "page_number": [None],
                    "text": [None], "page_count": [page_count],
                    "error": [f"block {int(key[1]) + 1}: {seen} of {self._expected(key, page_count)} pages arrived in time"],
                }
            )

    def close(self) -> None:
        pass


class ReorderBuffer(StatefulProcessor):
    """Keeps events until the watermark passes them, then follows them by ``seq``.

    Rows carry seq, kind and at (their time in milliseconds, rounded up). No event as old as
    the watermark can still arrive, so what is released is in its final order, whatever
    batches brought it. A key holds what arrived within the watermark's delay, and one timer:
    its oldest waiting event, or what ``follow`` asks for.
    """

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, kind string, at long")

    def follow(self, key: Any, due: list[Event], now_ms: int) -> tuple[list[tuple], int | None]:
        """Rows to emit, and when to be called again if nothing arrives."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues):
        new = [(int(r.seq), r.kind, int(r.at)) for part in rows for r in part.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            oldest, timers = min(at for _, _, at in new), list(self.handle.listTimers())
            if not timers or oldest < min(timers):
                for timer in timers:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(oldest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            event = Event(*row)
            (due if event.at <= now else later).append(event)
        if due:
            self.waiting.put([tuple(e) for e in later]) if later else self.waiting.clear()
        out, again = self.follow(key, sorted(due), now)
        wake = [e.at for e in later] + ([] if again is None else [again])
        if wake:
            self.handle.registerTimer(min(wake))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _submissions(state, element: int, events) -> list[tuple]:
    """(seq, element_id, duplicate, job_id) of the submissions among ordered events."""
    active = last = state.get()[0] if state.exists() else None
    out = []
    for row in events:
        if row.kind == "submit":
            duplicate = active is not None
            active = active if duplicate else int(row.seq)
            out.append((int(row.seq), element, duplicate, active))
        else:
            active = None
    if active is None:
        state.clear()
    elif active != last:
        state.update((active,))
    return out


class OrderedSubmissionDedup(ReorderBuffer):
    """``SubmissionDedup`` on events that may arrive out of order."""

    columns = ["seq", "element_id", "duplicate", "job_id"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.active = handle.getValueState("active", "job_id long")

    def follow(self, key: Any, due: list[Event], now_ms: int) -> tuple[list[tuple], int | None]:
        return _submissions(self.active, int(key[0]), due), None


class SubmissionDedup(StatefulProcessor):
    """Active job per element: a second submission maps to it until it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "job_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues):
        out = _submissions(self.active, int(key[0]), _in_order(rows, "seq").itertuples(index=False))
        if out:
            yield pd.DataFrame(out, columns=["seq", "element_id", "duplicate", "job_id"])

    def close(self) -> None:
        pass


class JobState(StatefulProcessor):
    """State after a job's last event by ``seq``; finished jobs expire ``ttl`` seconds after their end.

    Events that come late change nothing that a later one decided, and nothing brings a
    deleted job back: it is remembered for ``ttl`` seconds after its delete.
    """

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_ms = ttl_seconds * _MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, finished_ms long, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues):
        status, finished, last = self.state.get() if self.state.exists() else (None, None, None)
        before = status
        for row in _in_order(rows, "seq").itertuples(index=False):
            if status == "deleted":
                break
            if row.kind == "delete":
                status, finished = "deleted", int(row.ts.timestamp() * _MS)
            elif last is None or row.seq > last:
                last = int(row.seq)
                status = "queued" if row.kind == "submit" else row.kind
                if status in ("done", "failed"):
                    finished = int(row.ts.timestamp() * _MS)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((status, finished, last))
        if finished is not None:
            self.handle.registerTimer(
                max(finished + self.ttl_ms, timerValues.getCurrentWatermarkInMs()) + 1
            )
        if before == "deleted":
            return
        yield pd.DataFrame({"job_id": [int(key[0])], "status": [status]})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo):
        deleted = self.state.exists() and self.state.get()[0] == "deleted"
        self.state.clear()
        if not deleted:
            yield pd.DataFrame({"job_id": [int(key[0])], "status": ["expired"]})

    def close(self) -> None:
        pass


class AttemptsOutcome(StatefulProcessor):
    """Retries per element and stay; emits the outcome, or ``stalled`` after a limit."""

    def __init__(self, max_attempts: int, limit_seconds: int, done: str, error: str) -> None:
        self.max_attempts, self.limit_ms = max_attempts, limit_seconds * _MS
        self.done, self.error = done, error

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "epoch long, attempts long, outcome string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues):
        epoch, attempts, outcome = self.state.get() if self.state.exists() else (0, 0, None)
        out = []
        for row in _in_order(rows, "seq").itertuples(index=False):
            if row.kind == "enter":
                epoch, attempts, outcome = epoch + 1, 0, None
                self._restart_clock(int(row.ts.timestamp() * _MS), timerValues)
                continue
            if outcome is not None:
                continue
            if row.kind in ("lost", "failed"):
                attempts += 1
                outcome = self.error if attempts >= self.max_attempts else None
            elif row.kind == "done":
                outcome = self.done
            if outcome is not None:
                out.append((int(key[0]), epoch, outcome, attempts))
        self.state.update((epoch, attempts, outcome))
        if out:
            yield pd.DataFrame(out, columns=["element_id", "epoch", "outcome", "attempts"])

    def _restart_clock(self, entered_ms: int, timerValues) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(
            max(entered_ms + self.limit_ms, timerValues.getCurrentWatermarkInMs()) + 1
        )

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo):
        epoch, attempts, outcome = self.state.get()
        if outcome is None:
            yield pd.DataFrame(
                {"element_id": [int(key[0])], "epoch": [epoch], "outcome": ["stalled"],
                 "attempts": [attempts]}
            )

    def close(self) -> None:
        pass


class OrderedAttemptsOutcome(ReorderBuffer):
    """``AttemptsOutcome`` on events that may arrive out of order.

    A stay is stalled if it has no outcome by its deadline, also where a later event that
    is followed in the same batch gives it one (both rows are emitted then).
    """

    columns = ["element_id", "epoch", "outcome", "attempts"]

    def __init__(self, max_attempts: int, limit_seconds: int, done: str, error: str) -> None:
        self.max_attempts, self.limit_ms = max_attempts, limit_seconds * _MS
        self.done, self.error = done, error

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState(
            "state", "epoch long, attempts long, outcome string, deadline long"
        )

    def follow(self, key: Any, due: list[Event], now_ms: int) -> tuple[list[tuple], int | None]:
        epoch, attempts, outcome, deadline = (
            self.state.get() if self.state.exists() else (0, 0, None, None)
        )
        out = []
        for event in [*due, None]:
            if deadline is not None and deadline < (now_ms if event is None else event.at):
                out.append((int(key[0]), epoch, "stalled", attempts))
                deadline = None
            if event is None:
                break
            if event.kind == "enter":
                epoch, attempts, outcome, deadline = epoch + 1, 0, None, event.at + self.limit_ms
                continue
            if outcome is not None:
                continue
            if event.kind in ("lost", "failed"):
                attempts += 1
                outcome = self.error if attempts >= self.max_attempts else None
            elif event.kind == "done":
                outcome = self.done
            if outcome is not None:
                out.append((int(key[0]), epoch, outcome, attempts))
                deadline = None
        self.state.update((epoch, attempts, outcome, deadline))
        return out, deadline
