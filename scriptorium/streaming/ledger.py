"""The ledger of a stream: a row of state for each path, and a timer for each claim.

Nothing is rewritten for a micro-batch but the state of the paths that it names. What a scan sees is planned against the path's row as
``operators.planner`` does against a whole ledger; renames are for imports to find, as they need all paths.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.config import ImportConfig

#: seen: a scan found the document; ready, failed: its import ended; gone: the scan no longer finds the path.
EVENT = "path string, doc_id string, kind string, at timestamp"
ACTION = "path string, doc_id string, action string, previous_doc_id string, at timestamp"
#: A path's state, and what is planned; times in milliseconds of the epoch.
ROW = "doc_id string, status string, started long, previous_doc_id string"
_PLANNED = "path string, doc_id string, action string, previous_doc_id string, ms long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PathLedger(StatefulProcessor):
    """Plans the events of a path in the order of their times."""

    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", ROW)

    def _claim(self, doc_id: str, ms: int, previous: str | None) -> None:
        self._forget_timers()
        self.row.update((doc_id, "processing", ms, previous))
        self.handle.registerTimer(ms + self.timeout * 1000)

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (path,) = key
        for event in sorted(rows, key=lambda r: (r.ms, r.kind, r.doc_id or "")):
            known = self.row.get() if self.row.exists() else None
            doc_id, status, started, previous = known if known is not None else (None, None, None, None)
            live = status == "processing" and event.ms - started <= self.timeout * 1000
            out = lambda action, was=None: Row(path=path, doc_id=event.doc_id, action=action, previous_doc_id=was, ms=event.ms)  # noqa: B023, E731
            if event.kind == "seen":
                if live:
                    yield out("locked", doc_id)
                elif doc_id == event.doc_id and status == "ready":
                    yield out("unchanged", doc_id)
                elif known is None:
                    self._claim(event.doc_id, event.ms, None)
                    yield out("added")
                elif doc_id == event.doc_id:
                    self._claim(event.doc_id, event.ms, previous)
                    yield out("resumed", doc_id)
                else:
                    self._claim(event.doc_id, event.ms, doc_id)
                    yield out("updated", doc_id)
            elif event.kind == "gone":
                if known is not None and not live:
                    self._forget_timers()
                    self.row.clear()
                    yield out("removed", doc_id)
            elif known is not None and status in ("processing", "expired") and doc_id == event.doc_id:
                self._forget_timers()
                self.row.update((doc_id, event.kind, started, previous))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.row.exists():
            doc_id, status, started, previous = self.row.get()
            if status == "processing":
                self.row.update((doc_id, "expired", started, previous))
                yield Row(path=key[0], doc_id=doc_id, action="expired", previous_doc_id=previous, ms=started)

    def close(self) -> None:
        pass


def plan_stream(events: DataFrame, config: ImportConfig | None = None, late: str = "0 seconds") -> DataFrame:
    """ACTION rows for a stream of EVENT rows: added, updated, resumed, unchanged, locked, removed, and expired when the time of a claim is
    over, by the times of events (those that come later than ``late`` are lost). Rows without path have no part."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    config = config or ImportConfig()
    keyed = events.filter("path is not null and at is not null").withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("path")
    planned = keyed.transformWithState(PathLedger(config.processing_timeout_seconds), outputStructType=_PLANNED, outputMode="Append", timeMode="EventTime")
    return planned.select("path", "doc_id", "action", "previous_doc_id", F.timestamp_millis("ms").alias("at"))
