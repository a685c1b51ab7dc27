"""The runtime as Structured Streaming: refinement memory for each tile, load scheduling for each runtime, sinks.

State is keyed by (runtime, tile) where tiles do not depend on one another (hysteresis, delays), so a runtime's tiles spread over the
cluster; only the load queue is keyed by runtime, which holds a bounded number of requests.  Clocks are columns of the input, so a
stream that is replayed gives the same rows; delays also register timers, so a runtime in which nothing moves wakes up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_COLUMNS = "runtime string, tile_id string, frame long, clock_ms long, sse double, required boolean"
REFINEMENT = "runtime string, tile_id string, frame long, refining boolean, delayed boolean, changed boolean, wake_ms long"
LOADS = "runtime string, resource string, event string, priority double, attempts int"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of these operators needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Refinement(StatefulProcessor):
    """Whether a tile refines in each frame that sees it: hysteresis, then a delay before it coarsens."""

    def __init__(self, threshold: float, hysteresis: float, scale: float, delay_ms: int, timers: bool) -> None:
        self.threshold, self.hysteresis, self.scale, self.delay, self.timers = threshold, hysteresis, max(1.0, scale), max(0, delay_ms), timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("refinement", "refining boolean, since long, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        refining, since, last = self.state.get() if self.state.exists() else (False, None, None)
        out = []
        for r in pd.concat(rows).sort_values("frame").itertuples():
            limit = self.threshold * (1 - self.hysteresis) if refining else self.threshold * self.scale
            required = bool(r.required) or r.sse > limit
            delayed, wake = False, None
            if required or not refining or not self.delay:
                since = None
            else:
                # the delay runs over frames in a row; one that was not seen starts it anew
                since = since if since is not None and last is not None and last >= r.frame - 1 else r.clock_ms
                wake = since + self.delay
                delayed = r.clock_ms < wake
            now = required or delayed
            out.append((*key, r.frame, now, delayed, now != refining, wake if delayed else None))
            # a delay that is over stays recorded as long as the tile is shown refined
            refining, last = now, r.frame
        self.state.update((refining, since, last))
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if out[-1][-1] is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay)
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in REFINEMENT.split(", ")])
        frame["wake_ms"] = frame["wake_ms"].astype("Int64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A runtime that asked for no frame meanwhile is told that its delay is over: a row that changes nothing but asks for one."""
        refining, _, last = self.state.get()
        frame = pd.DataFrame([(*key, last, refining, False, False, None)], columns=[c.split(" ")[0] for c in REFINEMENT.split(", ")])
        frame["wake_ms"] = frame["wake_ms"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def refinement_stream(frames: DataFrame, *, threshold: float = 16.0, hysteresis: float = 0.1, scale: float = 1.0, delay_ms: int = 300, timers: bool = False) -> DataFrame:
    """REFINEMENT rows for a stream of FRAME_COLUMNS: one for each frame in which a tile is seen."""
    if not 0 <= hysteresis < 1:
        raise ValueError("hysteresis must be in [0, 1)")
    use_rocksdb(frames.sparkSession)
    processor = Refinement(threshold, hysteresis, scale, delay_ms, timers)
    return frames.groupBy("runtime", "tile_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=REFINEMENT, outputMode="Update", timeMode="ProcessingTime" if timers else "None")


class Loads(StatefulProcessor):
    """A runtime's load queue: so many at a time, the highest priority first, first come first on ties."""

    def __init__(self, slots: int, most_attempts: int) -> None:
        self.slots, self.most = max(1, int(slots)), max(1, int(most_attempts))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getMapState("queue", "resource string", "priority double, ord long, attempts int")
        self.running = handle.getMapState("running", "resource string", "activation long, attempts int")
        self.counts = handle.getValueState("counts", "ord long, activation long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        order, activation = self.counts.get() if self.counts.exists() else (0, 0)
        out = []
        for r in pd.concat(rows).sort_values("ord", kind="stable").itertuples():
            name = (r.resource,)
            if r.event == "request":
                if self.running.containsKey(name):
                    continue
                if self.queue.containsKey(name):  # follows the priority that is asked now
                    _, at, tries = self.queue.getValue(name)
                    self.queue.updateValue(name, (r.priority, at, tries))
                else:
                    order += 1
                    self.queue.updateValue(name, (r.priority, order, int(r.attempts or 0)))
            elif r.event == "cancel":
                if self.queue.containsKey(name):
                    self.queue.removeKey(name)
                    out.append((*key, r.resource, "cancelled", 0.0, 0))
                if self.running.containsKey(name):  # its result will be late, and its slot is free
                    self.running.removeKey(name)
                    out.append((*key, r.resource, "aborted", 0.0, 0))
            elif self.running.containsKey(name):
                _, tries = self.running.getValue(name)
                self.running.removeKey(name)
                again = r.event == "failed" and tries < self.most
                out.append((*key, r.resource, "retry" if again else r.event, 0.0, tries))
                if again:
                    order += 1
                    self.queue.updateValue(name, (r.priority, order, tries))
            # results of loads that are not under way any more are late: dropped
            free = self.slots - sum(1 for _ in self.running.keys())
            while free > 0 and (waiting := list(self.queue.iterator())):
                (resource,), (priority, _, tries) = min(waiting, key=lambda kv: (-kv[1][0], kv[1][1]))
                self.queue.removeKey((resource,))
                activation += 1
                self.running.updateValue((resource,), (activation, tries + 1))
                out.append((*key, resource, "start", priority, tries + 1))
                free -= 1
        self.counts.update((order, activation))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in LOADS.split(", ")])

    def close(self) -> None:
        pass


def load_stream(events: DataFrame, *, slots: int = 4, most_attempts: int = 3) -> DataFrame:
    """LOADS rows for a stream of (runtime, resource, event, priority, attempts, ord): what starts, ends, is tried again or cancelled.

    event is request, ready, failed or cancel.  A free slot is taken as soon as something is asked for.
    """
    use_rocksdb(events.sparkSession)
    return events.groupBy("runtime").transformWithStateInPandas(statefulProcessor=Loads(slots, most_attempts), outputStructType=LOADS, outputMode="Update", timeMode="None")


def metric_stream(metrics: DataFrame, *, watermark: str = "1 minute", every: str = "10 seconds") -> DataFrame:
    """Aggregates of metrics (name, value, ts) in windows; late rows count until the watermark."""
    windows = metrics.withWatermark("ts", watermark).groupBy(F.window("ts", every), "name")
    return windows.agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "ts").alias("latest"))


def camera_source(spark: SparkSession, path: str, schema: str, *, files: int = 1) -> DataFrame:
    """A stream of the camera rows written below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_cameras(batch: DataFrame, *, key: str = "runtime", order: str = "clock_ms") -> DataFrame:
    """One frame for each runtime of a micro-batch: the latest camera, with all its change flags together."""
    rest = [c for c in batch.columns if c not in (key, "change_flags")]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("c"), F.bit_or("change_flags").alias("change_flags")).select(key, "c.*", "change_flags")


def present(selections: DataFrame, checkpoint: str, *, show: Callable[[DataFrame], None], hide: Callable[[DataFrame], None], release: Callable[[DataFrame], None] | None = None):
    """Start a sink for a stream of (view, tile_id, change): entering tiles go to show, leaving ones to hide, evicted ones to release.

    A batch that is tried again shows the same tiles again: the callbacks must be idempotent by (view, tile_id).
    """

    def apply(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            show(batch.where("change = 'enter'"))
            hide(batch.where("change = 'leave'"))
            if release:
                release(batch.where("change = 'evict'"))
        finally:
            batch.unpersist()

    return selections.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_log(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to Parquet files, a folder for each name."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("name").trigger(availableNow=True).start()
