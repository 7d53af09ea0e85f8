"""Test sessions of a stream of probe events: the streaming twin of operators.trace.sessions.

State is one open session for each (case_id, test_id): its number, start, hits, and a timer in event time at its limit. A start closes an
open session as replaced; a finish or reset closes it; an event beyond the limit, or the watermark passing it, closes it as timed out. Events
without an open session, such as those after its end, are dropped; a second finish changes nothing. A session that is open when the
stream ends closes once the watermark passes its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "number int, open boolean, started long, hits long"
SCHEMA = "case_id string, test_id string, session int, outcome string, reason string, hits long"


class Sessions(StatefulProcessor):
    def __init__(self, limit_s: float) -> None:
        self.limit = int(limit_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)

    def _close(self, key, state: list, outcome: str, reason: str) -> tuple:
        self.handle.deleteTimer(state[2] + self.limit)
        state[1] = False
        return (*key, state[0], outcome, reason, state[3])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = list(self.state.get()) if self.state.exists() else [0, False, 0, 0]
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for r in events.itertuples():
            at = int(r.ts.value // 1_000_000)
            if state[1] and at > state[2] + self.limit and r.kind in ("start", "finish", "reset"):
                out.append(self._close(key, state, "ERROR", "timed out"))
            if r.kind == "start":
                if state[1]:
                    out.append(self._close(key, state, "ERROR", "replaced"))
                state = [state[0] + 1, True, at, 0]
                self.handle.registerTimer(at + self.limit)
            elif not state[1]:
                continue
            elif r.kind == "enter" and at <= state[2] + self.limit:
                state[3] += 1
            elif r.kind == "finish":
                out.append(self._close(key, state, "FAIL" if r.failed else "PASS", "finished"))
            elif r.kind == "reset":
                out.append(self._close(key, state, "ERROR", "reset"))
        self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=["case_id", "test_id", "session", "outcome", "reason", "hits"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = list(self.state.get()) if self.state.exists() else [0, False, 0, 0], []
        if state[1] and expiredTimerInfo.getExpiryTimeInMs() >= state[2] + self.limit:
            out.append((*key, state[0], "ERROR", "timed out", state[3]))
            state[1] = False
            self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=["case_id", "test_id", "session", "outcome", "reason", "hits"])

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, limit_s: float = 300.0, delay: str = "10 minutes") -> DataFrame:
    """Closed sessions of a streaming log (case_id, test_id, seq, ts, kind, failed). Needs the RocksDB state store."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay).groupBy("case_id", "test_id").transformWithStateInPandas(Sessions(limit_s), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def stream_hits(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hit counts of each (case, test, method) of a stream, updated as events come."""
    return events.withWatermark("ts", delay).where("kind = 'enter'").groupBy("case_id", "test_id", "method_id").count()
