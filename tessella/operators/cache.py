"""Cache sweeps: least recently used entries go until budgets hold, as running sums.

Going through the candidates from the least recently used on, totals only shrink and staleness only ends; so what goes is a prefix
of that order, and running sums in two levels find it, however large a key is.  Ties keep the order in which entries came (seq).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.prefix import sums_before, with_totals

#: From the least recently used on.
USED = ["touched", "seq"]


@dataclass(frozen=True)
class Budgets:
    max_tiles: float = 4096
    max_contents: float = 4096
    working_set_factor: float = 0.0
    max_cpu_bytes: float = 512 << 20
    max_gpu_bytes: float = 1 << 30
    max_subtrees: float = 128
    max_subtree_bytes: float = 64 << 20
    retention_ms: float = 60_000
    frame_retention: int | None = None

    def __post_init__(self) -> None:
        for name in ("max_tiles", "max_contents", "max_cpu_bytes", "max_gpu_bytes", "max_subtrees", "max_subtree_bytes", "retention_ms"):
            value = getattr(self, name)
            if math.isnan(value) or value < 0:
                raise ValueError(f"{name} must be zero or more")
            object.__setattr__(self, name, value if math.isinf(value) else math.floor(value))


def adaptive_budget(limit: Column | float, in_use: Column, factor: float) -> Column:
    """A budget that grows with what is in use; factors of zero or less leave it."""
    limit = F.lit(float(limit)) if isinstance(limit, (int, float)) else limit
    return F.greatest(limit, in_use * factor) if factor > 0 else limit


def is_stale(touched_frame: Column, touched_ms: Column, now_frame: Column, now_ms: Column, budgets: Budgets) -> Column:
    """Unused for longer than the retention: so many frames if that is set, else so long; frames no longer known are older than that."""
    if budgets.frame_retention is not None:
        return now_frame - touched_frame > budgets.frame_retention
    return touched_ms.isNull() | (now_ms - touched_ms > budgets.retention_ms)


def evict_contents(contents: DataFrame, *, key: list[str], budgets: Budgets = Budgets(), selected: DataFrame | None = None, force: bool = False) -> DataFrame:  # noqa: B008
    """(key, content_id, reason, released_cpu, released_gpu): what leaves the cache.

    contents: (key, content_id, touched, seq, stale, cpu, gpu, protected): ready ones.  Protected are those that are shown, attached, on a
    front or just loaded; they count in the totals but never go.  selected: (key, n) tiles shown, for budgets that adapt.
    """
    cpu, gpu = F.coalesce("cpu", F.lit(0)), F.coalesce("gpu", F.lit(0))
    rows = contents.withColumns({"cpu": cpu, "gpu": gpu})
    rows = with_totals(rows, key=key, totals={"n_all": F.count(F.lit(1)), "cpu_all": F.sum("cpu"), "gpu_all": F.sum("gpu")})
    budget = F.lit(float(budgets.max_contents))
    if selected is not None:
        rows = rows.join(selected.select(*key, F.col("n").alias("__shown")), key, "left")
        budget = adaptive_budget(budget, F.coalesce("__shown", F.lit(0)), budgets.working_set_factor)
    gone = {"n_gone": F.lit(1), "cpu_gone": F.col("cpu"), "gpu_gone": F.col("gpu")}
    rows = sums_before(rows.where(~F.col("protected")), key=key, order=USED, sums=gone)
    reason = (
        F.when(F.lit(force) | F.col("stale"), "stale")
        .when(F.col("n_all") - F.col("n_gone") > budget, "entry-budget")
        .when(F.col("cpu_all") - F.col("cpu_gone") > budgets.max_cpu_bytes, "cpu-budget")
        .when(F.col("gpu_all") - F.col("gpu_gone") > budgets.max_gpu_bytes, "gpu-budget")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*key, "content_id", "reason", F.col("cpu").alias("released_cpu"), F.col("gpu").alias("released_gpu"))


def evict_subtrees(subtrees: DataFrame, *, key: list[str], budgets: Budgets = Budgets(), force: bool = False) -> DataFrame:  # noqa: B008
    """(key, subtree_id, reason, released_bytes): loaded subtrees that leave; subtrees: (key, subtree_id, touched, seq, stale, bytes, protected)."""
    rows = with_totals(subtrees, key=key, totals={"n_all": F.count(F.lit(1)), "bytes_all": F.sum("bytes")}).where(~F.col("protected"))
    rows = sums_before(rows, key=key, order=USED, sums={"n_gone": F.lit(1), "bytes_gone": F.col("bytes")})
    reason = (
        F.when(F.lit(force) | F.col("stale"), "stale")
        .when(F.col("n_all") - F.col("n_gone") > budgets.max_subtrees, "entry-budget")
        .when(F.col("bytes_all") - F.col("bytes_gone") > budgets.max_subtree_bytes, "byte-budget")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*key, "subtree_id", "reason", F.col("bytes").alias("released_bytes"))


def prune_branches(tiles: DataFrame, *, budgets: Budgets = Budgets(), force: bool = False) -> DataFrame:  # noqa: B008
    """(key, tile_id, reason): branches of implicit tiles that are pruned, named by the tile that keeps its place.

    tiles: (key, tile_id, parent_id, depth, touched, stale, protected).  Candidates are the parents, those with the oldest child first, deeper
    ones first on ties.  A branch goes if nothing in it is protected and all of it is stale, or if too many tiles are there.  A branch
    inside one that is gone is gone with it, and what each removes counts for the next: a runtime's branches are judged in order, by a
    task of its own (a runtime holds a bounded number of tiles, its budget); runtimes are spread over the cluster.
    """
    import pandas as pd

    limit, everything = budgets.max_tiles, force

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(rows.tile_id, rows.parent_id))
        children: dict = {}
        for tile, above in parent.items():
            children.setdefault(above, []).append(tile)
        touched, depth, stale, shielded = (dict(zip(rows.tile_id, rows[c])) for c in ("touched", "depth", "stale", "protected"))
        there, out = set(parent), []
        order = sorted((t for t in there if t in children), key=lambda t: (min(touched[c] for c in children[t]), -depth[t]))
        for root in order:
            if root not in there:
                continue
            below, pending = [], [c for c in children[root] if c in there]
            while pending:
                tile = pending.pop()
                below.append(tile)
                pending += [c for c in children.get(tile, ()) if c in there]
            if not below or any(shielded[t] for t in below):
                continue
            reason = "stale" if everything or all(stale[t] for t in below) else "node-budget" if len(there) > limit else None
            if reason:
                there.difference_update(below)
                out.append((rows.key.iloc[0], root, reason))
        return pd.DataFrame(out, columns=["key", "tile_id", "reason"])

    kind = tiles.schema["key"].dataType.simpleString()
    return tiles.groupBy("key").applyInPandas(judged, f"key {kind}, tile_id string, reason string")


def subtree_users(tiles: DataFrame, *, key: list[str]) -> DataFrame:
    """(key, subtree_id, users, protected): of the tiles (key, subtree_id, tile_id, protected) that stand on each subtree."""
    return tiles.groupBy(*key, "subtree_id").agg(F.count(F.lit(1)).alias("users"), F.bool_or("protected").alias("protected"))


def content_totals(contents: DataFrame, *, key: list[str]) -> DataFrame:
    """(key, entries, cpu, gpu) of ready renderable contents."""
    ready = contents.where("kind = 'renderable' AND status = 'ready'")
    return ready.groupBy(*key).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce("cpu", F.lit(0))).alias("cpu"), F.sum(F.coalesce("gpu", F.lit(0))).alias("gpu"))


def evict_effects(contents: DataFrame, evicted: DataFrame, *, key: list[str]) -> DataFrame:
    """Contents after a sweep: what left is idle again, without cost and with no attempts counted."""
    gone = evicted.select(*key, "content_id").withColumn("__gone", F.lit(True))
    rows = contents.join(gone, [*key, "content_id"], "left")
    reset = {"status": F.when(F.col("__gone"), "idle").otherwise(F.col("status"))} | {c: F.when(F.col("__gone"), 0).otherwise(F.col(c)) for c in ("cpu", "gpu", "attempts") if c in contents.columns}
    return rows.withColumns(reset).drop("__gone")
