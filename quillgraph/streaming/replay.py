"""Replay of sessions as they arrive: a buffer in keyed state, folded when it holds enough."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillgraph.operators import fold

#: Where states with lists and timers are kept.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = fold.FOLD_SCHEMA + ", late boolean"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Replay(StatefulProcessor):
    """A session's state: ``buffer`` (messages since the last fold), ``waiting`` (messages behind a gap), ``place``.

    ``place`` is the next message's number in the session's order, the messages taken so far, and the timer.
    """

    def __init__(self, threshold: int, strategy: str, model: str, wait_ms: int, idle_ms: int | None, first: int, options: dict):
        self.threshold, self.strategy, self.model, self.wait_ms, self.idle_ms, self.first, self.options = threshold, strategy, model, wait_ms, idle_ms, first, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "role string, content string, tokens long")
        self.waiting = handle.getListState("waiting", "idx long, role string, content string, tokens long")
        self.place = handle.getValueState("place", "next long, taken long, timer long")

    def _place(self) -> tuple[int, int, int]:
        return self.place.get() if self.place.exists() else (self.first, 0, 0)

    def _timer(self, old: int, now: int, waits: bool) -> int:
        """The time at which a gap is given up, or an idle session forgotten; 0 for never."""
        if old:
            self.handle.deleteTimer(old)
        delay = self.wait_ms if waits else self.idle_ms
        if not delay:
            return 0
        self.handle.registerTimer(now + delay)
        return now + delay

    def _take(self, session: Any, rows: list[tuple], place: tuple[int, int]) -> list[tuple]:
        """Put messages ``(idx, role, content, tokens)`` into the buffer, in order, and fold; what the buffer had is read only for that."""
        new = [dict(zip(("role", "content", "tokens"), r[1:], strict=True)) for r in rows]
        held = [dict(zip(("role", "content", "tokens"), (r[0], r[1], int(r[2])), strict=True)) for r in self.buffer.get()] if self.buffer.exists() else []
        points = list(fold.replay_session(new, self.threshold, fold.STRATEGIES[self.strategy], fold.MODELS[self.model], (held, place[1]), **self.options))
        if points:
            self.buffer.put([(m["role"], m["content"], int(m["tokens"])) for m in held])
        elif new:  # nothing was folded: what is there stays as it is
            self.buffer.appendList([(m["role"], m["content"], int(m["tokens"])) for m in new])
        return [(session, *p, False) for p in points]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        session, (following, taken, timer) = key[0], self._place()
        frame = pd.concat(list(rows)).sort_values(["idx", "content"], kind="stable")
        waiting = {int(r[0]): (int(r[0]), r[1], r[2], int(r[3])) for r in self.waiting.get()} if self.waiting.exists() else {}
        before, late = len(waiting), []
        for idx, role, content, tokens in frame[["idx", "role", "content", "tokens"]].itertuples(index=False):
            if idx < following or idx in waiting:
                late.append((session, int(idx), None, None, None, None, True))
            else:
                waiting[int(idx)] = (int(idx), role, content, int(tokens))
        ready = []
        while following in waiting:
            ready.append(waiting.pop(following))
            following += 1
        if not self.wait_ms:  # gaps are not waited for
            ready += [waiting[i] for i in sorted(waiting)]
            following, waiting = (ready[-1][0] + 1 if ready else following), {}
        out = self._take(session, ready, (following, taken)) + late
        if waiting:
            self.waiting.put(list(waiting.values()))
        elif before:
            self.waiting.clear()
        self.place.update((following, taken + len(ready), self._timer(timer, timerValues.getCurrentProcessingTimeInMs(), bool(waiting))))
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, taken, _ = self._place()
        if not self.waiting.exists():  # idle
            self.buffer.clear()
            self.place.clear()
            return
        ready = sorted((int(r[0]), r[1], r[2], int(r[3])) for r in self.waiting.get())
        out = self._take(key[0], ready, (following, taken))
        self.waiting.clear()
        self.place.update((ready[-1][0] + 1, taken + len(ready), self._timer(0, timerValues.getCurrentProcessingTimeInMs(), False)))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({c: "Int64" for c in ("turn", "before", "after", "tokens_in", "tokens_out")} | {"late": "bool"})


def replay_stream(
    messages: DataFrame, threshold: int, strategy: str = "s5", model: str = "extractive", wait_ms: int = 0, idle_ms: int | None = None, first: int = 0, **options
) -> DataFrame:
    """Fold points as messages ``(session_id, idx, role, content, tokens)`` arrive, as ``fold.replay`` gives them, and ``late``.

    Messages are taken by ``idx``, from ``first`` on. One behind a gap waits up to ``wait_ms`` for the missing
    ones (0: not at all); then the gap is given up. A message whose place is past, or taken already, is
    late: it is a row with its ``idx`` as ``turn`` and null sizes, and is not folded. A session without
    messages for ``idle_ms`` (None: never) is forgotten, and starts anew with what comes next.

    The buffer never holds more than ``threshold`` tokens and one message, save where a strategy leaves it
    unfolded; messages are appended to it, and it is written again only when it was folded. State is kept
    in RocksDB, for which the session's provider is set, as lists with timers need it.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor = Replay(threshold, strategy, model, wait_ms, idle_ms, first, options)
    timed = "ProcessingTime" if wait_ms or idle_ms else "None"
    return messages.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode=timed)
