"""Keyed state of the session memory: the last lines of a session and when it is closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Keyed state with timers needs this store (public class name of Spark's).
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_SEQ = "CAST(-9223372036854775807 AS BIGINT)"  # in place of a null number
TAIL_ROW = "session_id string, seq long, line string, closed boolean"


def _by_place(line: tuple[int, str | None]) -> tuple[int, bool, str]:
    return line[0], line[1] is not None, line[1] or ""


def batch_tails(n: int):
    """Cut every batch of rows to the last ``n`` lines per session; they carry the session's newest time in the batch."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sessions = rows.groupby("session_id", dropna=False, sort=False)
            rows["at"] = sessions["at"].transform("max")
            yield rows.sort_values(["seq", "line"], na_position="first").groupby("session_id", dropna=False, sort=False).tail(n)
    return cut


class SessionTail(StatefulProcessor):
    """Holds the last ``n`` lines of a session; ``idle_ms`` after its newest line the session is closed."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "seqs array<bigint>, lines array<string>")
        self.due = handle.getValueState("due", "due long")

    def _stored(self) -> list[tuple[int, str | None]]:
        stored = self.tail.get() if self.tail.exists() else None
        return list(zip(stored[0], stored[1], strict=True)) if stored else []

    def _emit(self, key: tuple, tail: list, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": pd.Series([key[0]] * len(tail), dtype=object), "seq": pd.Series([q for q, _ in tail], dtype="int64"),
                             "line": pd.Series([t for _, t in tail], dtype=object), "closed": closed})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        tail, newest = self._stored(), 0
        for part in rows:
            lines = [t if isinstance(t, str) else None for t in part["line"].tolist()]
            tail = sorted([*tail, *zip(part["seq"].tolist(), lines, strict=True)], key=_by_place)[-self.n:]
            newest = max(newest, int(part["at"].max()))
        self.tail.update(([q for q, _ in tail], [t for _, t in tail]))
        old = self.due.get()[0] if self.due.exists() else None
        due = newest + self.idle_ms
        if old is None or due > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.due.update((due,))
            self.handle.registerTimer(due)
        yield self._emit(key, tail, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tail = self._stored()
        self.tail.clear()
        self.due.clear()
        yield self._emit(key, tail, True)

    def close(self) -> None:
        pass
