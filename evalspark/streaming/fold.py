"""Event logs folded as they arrive: a row per id with the last data of each type."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalspark.sources.events import ORDER, TERMINAL, fold
from evalspark.streaming.events import run_updates

#: State of many ids needs a store that isn't the executors' heap.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Fold(StatefulProcessor):
    """Keeps, of one id, the data of the greatest seq of each type; puts the row out at a terminal event, again at each
    event after it, and at the timer, which fires when no event has come for `patience_ms` of event time."""

    def __init__(self, types: tuple[str, ...], patience_ms: int):
        self.types, self.patience_ms = types, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "type string", "seq long, data string")
        self.seen = handle.getValueState("seen", "revision int, timer long")

    def _row(self, key: tuple, revision: int, closed: str) -> pd.DataFrame:
        held = {k[0]: v[1] for k, v in self.last.iterator()}
        return pd.DataFrame([{"id": key[0], **{t: held.get(t) for t in self.types}, "revision": revision, "closed_by": closed}])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            for kind, seq, data, ms in zip(batch["type"], batch["seq"], batch["data"], batch["ms"], strict=True):
                latest = max(latest, int(ms))
                if kind in self.types and (not self.last.containsKey((kind,)) or self.last.getValue((kind,))[0] < seq):
                    self.last.updateValue((kind,), (int(seq), data))
        revision, timer = self.seen.get() if self.seen.exists() else (0, 0)
        due = max(timer, latest + self.patience_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        done = any(self.last.containsKey((t,)) for t in TERMINAL)
        self.seen.update((revision + done, due))
        if done:
            yield self._row(key, revision + 1, "terminal")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        revision, _ = self.seen.get()
        if not any(self.last.containsKey((t,)) for t in TERMINAL):
            yield self._row(key, revision + 1, "timer")
        self.last.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, types: tuple[str, ...] = ORDER, late: str = "1 hour", patience_ms: int = 3_600_000) -> DataFrame:
    """(id, types, revision, closed_by) of a stream of events (id, type, seq, data, ts), in append mode.

    A row comes out when an id's terminal event arrives (closed_by terminal), and again, as the next revision, at each
    later event of that id; an id without a terminal event comes out when event time has passed its last event by
    patience_ms (closed_by timer). Then its state goes: an event that comes later yet begins a row of its own. Needs the
    settings STORE. Python is called for every id of a batch; a log of millions of ids without a need for timers is
    folded by fold_available.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("id", "type", F.col("seq").cast("long").alias("seq"), F.col("data").cast("string").alias("data"), F.unix_millis("ts").alias("ms"), "ts")
    kind = events.schema["id"].dataType.simpleString()
    out = f"id {kind}, " + ", ".join(f"{t} string" for t in types) + ", revision int, closed_by string"
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=_Fold(types, patience_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


def settled(rows: DataFrame) -> DataFrame:
    """The last revision of each id."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "revision")
    return rows.groupBy("id").agg(last.alias("last")).select("id", "last.*")


def fold_available(stream: DataFrame, folder: str, checkpoint: str, types: tuple[str, ...] = ORDER) -> DataFrame:
    """All ids of a stream of events (id, type, seq, data) with the last data of each type. What came before is the state
    of Spark's own aggregation, kept for every id; each batch puts out the ids that it changed, and the last batch of an
    id counts. Wants the settings STORE."""
    rows = run_updates(fold(stream, types), folder, checkpoint)
    last = F.max_by(F.struct(*types), "batch")
    return rows.groupBy("id").agg(last.alias("last")).select("id", "last.*")


def folded_view(rows: DataFrame, log: DataFrame, types: tuple[str, ...] = ORDER) -> DataFrame:
    """All ids of a log: the settled rows of its stream, and the fold of those that the stream still waits for."""
    done = settled(rows).drop("revision", "closed_by")
    return done.unionByName(fold(log.join(done.select("id"), "id", "left_anti"), types))
