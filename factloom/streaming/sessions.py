"""Ordinals of commands within their session over an arriving stream: a counter for each session, kept as state, which ends a while after the session's last command."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

WATERMARK = "1 day"
EXPIRY_MS = 86_400_000
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordinals(StatefulProcessor):
    """A session's state is the number of its commands so far, and one timer that drops it."""

    def __init__(self, expiry_ms: int = EXPIRY_MS):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = pd.concat([batch["at"] for batch in rows]).sort_values()
        n = self.count.get()[0] if self.count.exists() else 0
        self.count.update((n + len(at),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = int(at.iloc[-1].timestamp() * 1000)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.expiry_ms)
        yield pd.DataFrame({"session": [key[0]] * len(at), "ordinal": range(n + 1, n + 1 + len(at)), "at": at.to_numpy()})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_ordinals(commands: DataFrame, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """(session, ordinal, at) of a stream of commands (session string, at timestamp): counted on from batch to batch, in a batch by time.

    A session's state goes once the watermark (a day behind the newest command) has passed ``expiry_ms`` after its last command; one that comes again later counts from 1.
    A trigger's rows of one session are sorted in memory: the source's rate (``maxFilesPerTrigger``) bounds them. State lies in RocksDB, beyond the heap.
    """
    commands.sparkSession.conf.set(*STORE)
    keyed = commands.select("session", "at").where("session IS NOT NULL AND at IS NOT NULL").withWatermark("at", WATERMARK).groupBy("session")
    return keyed.transformWithStateInPandas(Ordinals(expiry_ms), "session string, ordinal long, at timestamp", "append", "eventTime")


def stream_log(commands: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the ordinals as Parquet, exactly once, until the source has nothing more; started again with the same checkpoint, it counts on."""
    return with_ordinals(commands).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
