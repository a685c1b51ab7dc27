"""What happens between frames: refinement memory, delays, loads, late results, camera frames; as windows over event rows.

Everything is per runtime (`key`), which is what partitions; no key's frames are collected into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.prefix import sums_before
from tessella.operators.selection import PRELOAD_SCALE


def hysteresis(frames: DataFrame, *, key: list[str], order: list[str], sse: str = "sse", threshold: float = 16.0, ratio: float = 0.1, scale: float = 1.0) -> DataFrame:
    """Adds refining: whether the tile refines in each frame, remembering the frame before.

    A tile refines above threshold*scale and stays refined above threshold*(1-ratio).  Between the two the state is the last
    one that a frame outside decided, so a window over what was decided last needs no fold.
    """
    up, down = threshold * max(1.0, scale), threshold * (1 - ratio)
    decided = F.when(F.col(sse) > up, True).when(~(F.col(sse) > down), False)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("refining", F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(False)))


def coarsening_delay(frames: DataFrame, *, key: list[str], frame: str = "frame", clock: str = "clock_ms", required: str = "required", delay_ms: int = 300) -> DataFrame:
    """Adds refining, delayed and wake_ms: a refined tile that nothing requires any more stays refined up to delay_ms.

    The delay runs over consecutive frames: one that is not seen starts it anew, one that requires the tile ends it.  Rows are
    the frames in which the tile is seen.  Frames in a row that do not require the tile share the clock of the first; the
    first frame beyond the delay ends refining until the tile is required again, so what was decided last needs no fold.
    """
    w = Window.partitionBy(*key).orderBy(F.col(frame).cast("long"), F.col(clock).cast("long"), F.col(required).cast("boolean"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q, f, c = F.coalesce(F.col(required).cast("boolean"), F.lit(False)), F.col(frame).cast("long"), F.col(clock).cast("long")
    goes_on = ~F.lag(q).over(w) & (F.lag(f).over(w) >= f - 1)
    begins = frames.withColumn("__begins", ~q & ~F.coalesce(goes_on, F.lit(False)))
    since = F.last(F.when(F.col("__begins"), F.struct(c.alias("c"))), ignorenulls=True).over(upto)["c"]
    inside = begins.withColumn("__until", since + delay_ms)
    late = ~F.coalesce(c < F.col("__until"), F.lit(False))
    decided = F.last(F.when(q, True).when(late, False), ignorenulls=True).over(upto)
    out = inside.withColumn("refining", F.coalesce(decided, F.lit(False))).withColumn("delayed", F.col("refining") & ~q)
    rest = [n for n in frames.columns if n not in (*key, frame)]
    return out.select(*key, frame, *rest, "refining", "delayed", F.when(F.col("delayed"), F.col("__until")).alias("wake_ms"))


def coalesce_frames(cameras: DataFrame, *, key: list[str], batch: str, order: str, flags: str = "change_flags") -> DataFrame:
    """One frame of each batch: the latest camera, with all change flags together."""
    rest = [c for c in cameras.columns if c not in (*key, batch, flags)]
    latest = F.max_by(F.struct(*rest), F.col(order)).alias("latest")
    return cameras.groupBy(*key, batch).agg(latest, F.bit_or(flags).alias(flags), F.count(F.lit(1)).alias("pushed")).select(*key, batch, "latest.*", flags, "pushed")


def load_priority(visible: Column, sse: Column) -> Column:
    return F.when(visible, sse).otherwise(sse * PRELOAD_SCALE)


def follow_priority(requests: DataFrame, *, key: list[str]) -> DataFrame:
    """Each key once, at the greatest priority it is asked at, in the order it was first asked."""
    return requests.groupBy(*key).agg(F.max("priority").alias("priority"), F.min("ord").alias("ord"))


def schedule(requests: DataFrame, *, key: list[str], slots: Column | int, running: DataFrame | None = None, attempts: Column | None = None, most_attempts: int = 3) -> DataFrame:
    """The requests that start: per runtime the highest priorities in the free slots, first come first on ties.

    requests: (*key, resource, priority, ord); the same resource is one request, at its greatest priority.  running: (*key, resource)
    of loads under way, which hold slots and are not asked for again.
    """
    if attempts is not None:
        requests = requests.where(attempts < most_attempts)
    asked = follow_priority(requests, key=[*key, "resource"])
    free = slots if isinstance(slots, Column) else F.lit(int(max(1, slots)))
    if running is not None:
        asked = asked.join(running.select(*key, "resource"), [*key, "resource"], "left_anti")
        asked = asked.join(running.groupBy(*key).agg(F.count(F.lit(1)).alias("__busy")), key, "left")
        free = free - F.coalesce("__busy", F.lit(0))
    ranked = sums_before(asked.withColumn("__free", free), key=key, order=[F.desc("priority"), "ord", "resource"], sums={"rank": F.lit(1)})
    free = F.col("__free")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).where(F.col("rank") <= free).select(*key, "resource", "priority", "ord", "rank")


def activation_generations(changes: DataFrame, *, key: list[str], order: str) -> DataFrame:
    """Adds activation_id: how often the tile entered or left up to each change."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumn("activation_id", F.count(F.lit(1)).over(w))


def drop_late(results: DataFrame, current: DataFrame, *, key: list[str]) -> DataFrame:
    """Results whose activation is still the current one of their tile; aborted ones go."""
    live = results.join(current.select(*key, "activation_id"), [*key, "activation_id"], "left_semi")
    return live.where(~F.coalesce("aborted", F.lit(False))) if "aborted" in results.columns else live


def cancelled_outside(active: DataFrame, touched: DataFrame, *, key: list[str]) -> DataFrame:
    """Active tiles that the frame did not touch: to be taken out of the pipeline."""
    return active.join(touched.select(*key).distinct(), key, "left_anti")


def counted_attempts(loads: DataFrame, *, key: list[str], most: int = 3) -> DataFrame:
    """(key, attempts, may_retry) of load rows (kind content or subtree, outcome ready, failed or cancelled); cancelled contents are refunded, eviction starts anew.

    Rows of outcome `evicted` reset what came before; rows have ord.
    """
    w = Window.partitionBy(*key)
    since = loads.withColumn("__reset", F.max(F.when(F.col("outcome") == "evicted", F.col("ord"))).over(w))
    alive = since.where(F.col("__reset").isNull() | (F.col("ord") > F.col("__reset")))
    n = F.count_if(~((F.col("kind") == "content") & (F.col("outcome") == "cancelled")))
    return alive.groupBy(*key).agg(n.alias("attempts"), (n < most).alias("may_retry"))
