"""Streams of results: resumable, idempotent, keyed. Event time goes beyond what batch evaluation needs and is optional."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.cells import cell


def records(spark: SparkSession, folder: str, schema: str, files: int = 200) -> DataFrame:
    """New JSON Lines files of a folder, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def first_seen(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """One row a key. With an event time the state is dropped after ``late``; without, it grows with the keys."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def saved(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Runs ``work`` on each micro-batch and writes its result once, whatever fails: a batch overwrites its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).trigger(availableNow=True).start()


def running_cells(stream: DataFrame, pk: str, ck: str, name: str, checkpoint: str) -> StreamingQuery:
    """Counters of the cells so far, in the memory table ``name`` (four rows)."""
    counts = stream.groupBy(cell(pk, ck).alias("cell")).agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, event_time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window of the event time; rows later than ``late`` are left out."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


#: What arbitrary state needs; ``ordered`` says so if another store is set.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Ordinals of a key whose early rows are one entry of the state.
BLOCK = 64
ORDERED = "ordinal long, value string, state string"


class Prefix(StatefulProcessor):
    """Commits the rows of a key by ordinal: what arrives early is kept until everything before it is there.

    State of a key: the next ordinal, and the early rows in blocks of BLOCK ordinals, each a JSON object, so that a call to the state store
    moves a block and not a row. Ordinals below the next one were committed and are left out, of
    repeated ones the first counts. When a hole has stayed for ``patience_ms`` of processing time, a row with the state "hole" names
    the ordinal that is missing, once; nothing is skipped."""

    def __init__(self, key: str, key_type: str, first: int, patience_ms: int | None):
        self.key, self.key_type, self.start, self.patience_ms = key, key_type, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at long")
        self.early = handle.getMapState("early", "block long", "rows string")
        self.waits = handle.getValueState("waits", "due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.next.get()
        at = before = self.start if kept is None else kept[0]
        new: dict[int, dict[int, str]] = {}
        for r in rows:
            if r.ordinal >= at:
                new.setdefault(r.ordinal // BLOCK, {}).setdefault(r.ordinal, r.value)
        waiting, done = self.early.exists(), []

        def block(b: int) -> dict[int, str]:
            """The rows of a block: those that came earlier count before the new ones."""
            there = self.early.getValue((b,)) if waiting else None
            return new.pop(b, {}) | ({int(i): v for i, v in json.loads(there[0]).items()} if there else {})

        def put(b: int, held: dict[int, str]) -> None:
            if held:
                self.early.updateValue((b,), (json.dumps(held),))
            elif waiting:
                self.early.removeKey((b,))

        while held := block(b := at // BLOCK):
            moved = at
            while at in held:
                done.append((at, held.pop(at), "committed"))
                at += 1
            if at != moved or held:
                put(b, held)
            if at // BLOCK == b:
                break
        for b in list(new):
            put(b, block(b))
        if at != before or kept is None:
            self.next.update((at,))
        if self.patience_ms is not None:
            self.watch(at != before, timerValues)
        yield from self.rows(key, done)

    def watch(self, moved: bool, timerValues) -> None:
        """A timer while early rows wait, begun anew when the prefix has grown; 0: the hole was named."""
        waiting = next(iter(self.early.keys()), None) is not None
        if self.waits.exists() and (moved or not waiting):
            if due := self.waits.get()[0]:
                self.handle.deleteTimer(due)
            self.waits.clear()
        if waiting and not self.waits.exists():
            due = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(due)
            self.waits.update((due,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.waits.update((0,))
        yield from self.rows(key, [(self.next.get()[0], None, "hole")])

    def rows(self, key: tuple, done: list[tuple]) -> Iterator[Row]:
        return (Row(**{self.key: key[0], "ordinal": i, "value": v, "state": s}) for i, v, s in done)

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, key: str, ordinal: str, first: int = 0, patience_ms: int | None = None) -> DataFrame:
    """(key, ordinal, the other columns, state) of a stream whose rows come in any order: of each key the contiguous run of ordinals from ``first`` on,
    each row once, as soon as all before it have come. The rows of one key are one task's state, on disk (RocksDB)."""
    spark = stream.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise RuntimeError(f"set {STORE[0]} to {STORE[1]} before a stream is ordered")
    rest = [c for c in stream.columns if c not in (key, ordinal)]
    kind = stream.schema[key].dataType.simpleString()
    own = stream.select(F.col(key), F.col(ordinal).cast("long").alias("ordinal"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value"))
    timed = "ProcessingTime" if patience_ms is not None else "None"
    out = own.where(F.col("ordinal").isNotNull()).groupBy(key).transformWithState(Prefix(key, kind, first, patience_ms), f"`{key}` {kind}, {ORDERED}", "Append", timed)
    back = F.from_json("value", StructType([stream.schema[c] for c in rest])).alias("v")
    return out.select(key, F.col("ordinal").alias(ordinal), back, "state").select(key, ordinal, *(F.col("v")[c].alias(c) for c in rest), "state")


DELTAS = "cell string, delta long"


class Corrections(StatefulProcessor):
    """Of each key the value with the greatest ``at`` counts; when a later one comes, the former is taken back."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, cell string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, cell_ = max((r.at, r.cell) for r in rows)
        before = self.last.get()
        if before is not None and (before[0], before[1]) >= (at, cell_):
            return
        self.last.update((at, cell_))
        if before is None or before[1] != cell_:
            for c, delta in ([] if before is None else [(before[1], -1)]) + [(cell_, 1)]:
                yield Row(**{self.key: key[0], "cell": c, "delta": delta})

    def close(self) -> None:
        pass


def corrected(stream: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """(key, cell, delta): 1 for a key's value by the latest ``at`` so far, and -1 for the one that it replaces, so that sums of delta by cell are the counts of
    the batch at any time, whatever the order of arrival. Of equal times the greater value counts. The state is a row a key, on disk (RocksDB)."""
    spark = stream.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise RuntimeError(f"set {STORE[0]} to {STORE[1]} before a stream is corrected")
    own = stream.select(F.col(key), F.col(at).cast("long").alias("at"), value.alias("cell")).where("at is not null and cell is not null")
    kind = stream.schema[key].dataType.simpleString()
    return own.groupBy(key).transformWithState(Corrections(key), f"`{key}` {kind}, {DELTAS}", "Append", "None")
