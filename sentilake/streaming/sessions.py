"""Analysis sessions as a state machine over a stream of requested steps.

A session is idle until it starts, then goes through its phases one by one, may wait for an
answer on the way, and ends completed or in error; it starts again from either. What a
session doesn't allow at that moment is rejected and changes nothing. A session that hears
nothing for ``timeout`` while it runs or waits ends in error: a timer in event time sees to
that, and a step that comes later than that finds it so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as V
from ..functions.plan import shared_folder

STEPS = "session string, at timestamp, seq long, action string, before string, after string, accepted boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def step(status: str, resume: str, action: str) -> tuple[str, str] | None:
    """The status after an action, and the phase to resume after an answer; None if the session doesn't allow it."""
    running, waiting = status in V.PHASES, status == V.WAITING
    if action == "start" and status in V.STARTS_FROM:
        return V.PHASES[0], ""
    if action == "advance" and running:
        return ([*V.PHASES, V.COMPLETED][V.PHASES.index(status) + 1], "")
    if action == "ask" and running:
        return V.WAITING, status
    if action == "answer" and waiting:
        return resume, ""
    if action == "fail" and (running or waiting):
        return V.FAILED, ""
    return None


class Sessions(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "status string, resume string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, resume, at = self.session.get() if self.session.exists() else (V.IDLE, "", 0)
        old, out = self._due(status, at), []
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")  # a session's steps of one micro-batch
        for ms, seq, action in zip(batch["ms"].tolist(), batch["seq"].tolist(), batch["action"].tolist(), strict=True):
            due = self._due(status, at)
            if due is not None and due < ms:
                out.append((key[0], due, None, "timeout", status, V.FAILED, True))
                status, resume, at = V.FAILED, "", due
            found = step(status, resume, action)
            out.append((key[0], ms, seq, action, status, status if found is None else found[0], found is not None))
            if found is not None:
                status, resume, at = *found, ms
        new = self._due(status, at)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.session.update((status, resume, at))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, _, at = self.session.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self._due(status, at) == due:
            self.session.update((V.FAILED, "", due))
            yield self._frame([(key[0], due, None, "timeout", status, V.FAILED, True)])

    def close(self) -> None:
        pass

    def _due(self, status: str, at: int) -> int | None:
        return at + self.timeout if status in (*V.PHASES, V.WAITING) else None

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["session", "at", "seq", "action", "before", "after", "accepted"])
        return out.assign(at=pd.to_datetime(out["at"], unit="ms"), seq=out["seq"].astype("Int64"))


def transitions(stream: DataFrame, *, timeout: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """The steps of sessions (session, at, seq, action), each with the status before and after and whether it was accepted, and the timeouts. Steps of a micro-batch are taken in order of time and seq."""
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    timed = stream.where("session is not null and at is not null").select("session", "at", "seq", "action", F.unix_millis("at").alias("ms")).withWatermark("at", lateness)
    return timed.groupBy("session").transformWithStateInPandas(statefulProcessor=Sessions(ms), outputStructType=STEPS, outputMode="Append", timeMode="EventTime")


def replayed(spark: SparkSession, stream: DataFrame, **how: str) -> DataFrame:
    """All transitions of what a stream has now. State needs the RocksDB provider, which is set for this run."""
    answer, before = shared_folder(spark), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = transitions(stream, **how)
        out.writeStream.format("parquet").option("path", f"{answer}/steps").option("checkpointLocation", f"{answer}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{answer}/steps")
