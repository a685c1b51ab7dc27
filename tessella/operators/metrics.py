"""Figures of runtimes: metric aggregates, statistics by state, error events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of a runtime's metrics.
NAMES = (
    "frame", "frame.duration", "frame.selected", "tileset.load", "subtree.load", "subtree.load.duration", "subtree.load.bytes", "subtree.cache.evict", "content.load", "content.load.duration",
    "content.load.network-bytes", "content.error", "content.cache.evict", "tile.attach", "tile.detach", "tile.refine", "tile.coarsen", "tile.refine.attempt", "tile.coarsen.attempt", "cut.entered", "content.cancelled",
    "cut.left", "tile.node.prune", "cache.sweep.duration", "cache.content.entries", "cache.content.cpu-bytes", "cache.content.gpu-bytes", "cache.subtree.entries", "cache.subtree.bytes", "runtime.error", "metadata.diagnostic",
)
STATES = ("idle", "queued", "preparing", "ready", "failed", "cancelled")


def metric_aggregate(metrics: DataFrame, *, key: list[str] = ["name"], value: str = "value", order: str = "seq") -> DataFrame:  # noqa: B006
    """count, sum, min, max and latest of each metric."""
    v = F.col(value)
    return metrics.groupBy(*key).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.max_by(v, F.col(order)).alias("latest"))


def statistics(rows: DataFrame, *, key: list[str], status: str = "status", amount: str | None = None) -> DataFrame:
    """The number of rows in each state, in all, and what they weigh."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in STATES]
    weigh = [F.sum(F.coalesce(amount, F.lit(0))).alias("total")] if amount else []
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *counts, *weigh)


def error_events(errors: DataFrame) -> DataFrame:
    """(key, name, phase, message): an error is counted, and once more as a content's if it befell one; hooks' own failures are told apart.

    errors: (key, phase, message).  Columns are those, name and for_hooks.
    """
    names = F.array_compact(F.array(F.lit("runtime.error"), F.when(F.col("phase").startswith("content."), "content.error")))
    return errors.select("key", "phase", "message", (~F.col("phase").startswith("hook")).alias("for_hooks"), F.explode(names).alias("name"))


def unit_of(name: Column) -> Column:
    """What a metric is counted in, by the end of its name; null for names that are none."""
    unit = F.when(name.endswith(".duration"), "millisecond").when(name.endswith("bytes"), "byte").otherwise("count")
    return F.when(name.isin(*NAMES), unit)


def durations(spans: DataFrame, *, started: str = "started_ms", ended: str = "ended_ms") -> DataFrame:
    """(name, value, unit, tags) of spans (name, started, ended, tags): what was never started, or has not ended, gives no row."""
    took = spans.where(F.col(started).isNotNull() & F.col(ended).isNotNull())
    return took.select("name", (F.col(ended) - F.col(started)).cast("double").alias("value"), F.lit("millisecond").alias("unit"), "tags")


def telemetry(metrics: DataFrame) -> DataFrame:
    """(name, value, unit, tags): the rows that a monitoring product gets, names that are no metric left out."""
    return metrics.select("name", F.col("value").cast("double").alias("value"), unit_of(F.col("name")).alias("unit"), "tags").where("unit IS NOT NULL")


def glyph_changes(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """(view, tile_id, action, label): labels (tile_id, label) to publish for tiles that enter a cut and to revoke for those that leave it."""
    moved = changes.where("change IN ('enter', 'leave')").withColumn("action", F.when(F.col("change") == "enter", "publish").otherwise("revoke"))
    return moved.join(labels, "tile_id").select("view", "tile_id", "action", "label")
