"""Streams of cameras and of timed events, with state that outlives a restart.

A camera's tiles are sought near it alone: a tile refines only within a distance that shrinks with its level, so on each level the tiles that
may be in its cut are a few numbered cells, joined with the static table of tiles.  Which tiles each view shows is keyed state, one entry for
each (view, tile); what enters, stays and leaves is told once for each frame, also after a restart.  Frames are put in order one row each: a
batch's first frame of a view meets the state, each later one the camera before it, so all but the order of frames is found apart for each frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.functions.implicit import ancestor
from tessella.operators.culling import APART
from tessella.plans.lod import grid_error
from tessella.streaming.runtime import use_rocksdb

CHANGES = "view string, frame long, level int, x long, y long, change string"
#: A frame, the camera before it (px, py), or instead what is shown before it.
NOW, BEFORE = ("cx", "cy"), ("px", "py")
ORDERED = "view string, frame long, cx double, cy double, px double, py double, shown array<string>"


def _cells(depth: int, threshold: float, error: float, pixels: float, x: str, y: str) -> Column:
    """Structs (level, x, y) of all tiles of a full quadtree that may be in the cut of a camera at (x, y); none where it is null."""
    side = float(1 << depth)

    def cells(level: int) -> Column:
        """Children of the tiles that may refine on the level above: those whose middle is no farther than the distance at which their error is tolerable."""
        size = side / (1 << (level - 1))
        reach = error / (1 << (level - 1)) * pixels / threshold
        if reach <= 0.5:  # no tile is nearer than that
            return F.array().cast("array<struct<level: int, x: bigint, y: bigint>>")
        ends = lambda at: (F.greatest(F.floor((F.col(at) - reach - size / 2) / size), F.lit(0)) * 2, F.least(F.floor((F.col(at) + reach + size / 2) / size), F.lit((1 << (level - 1)) - 1)) * 2 + 1)
        span = lambda at: F.when(ends(at)[0] <= ends(at)[1], F.sequence(ends(at)[0].cast("long"), ends(at)[1].cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.flatten(F.transform(span(x), lambda a: F.transform(span(y), lambda b: F.struct(F.lit(level).alias("level"), a.alias("x"), b.alias("y")))))

    top = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    return F.concat(F.array(top), *[cells(level) for level in range(1, depth + 1)])


def _refines(depth: int, threshold: float, error: float, pixels: float, at: tuple[str, str], level: Column, x: Column, y: Column) -> Column:
    return F.coalesce((level < depth) & (grid_error(level, x, y, depth=depth, camera=(F.col(at[0]), F.col(at[1])), error=error, pixels=pixels) > threshold), F.lit(False))


def _known(at: tuple[str, str]) -> Column:
    return F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()


def _in_cut(depth: int, threshold: float, error: float, pixels: float, at: tuple[str, str]) -> Column:
    """Whether the row's tile is in the cut of a camera: plans.lod.lod_cut with the levels above written out."""
    level, x, y = (F.col(c) for c in ("level", "x", "y"))
    refines = lambda k: _refines(depth, threshold, error, pixels, at, level - k, ancestor(x, k), ancestor(y, k))
    return reduce(lambda s, t: s & t, [_known(at), ~refines(0)] + [(level < k) | refines(k) for k in range(1, depth + 1)])


def newest_marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames (view, frame, cx, cy) with newest: those of each view's last frame among the task's rows; a batch's last frame of a view is among them."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows])
        last = rows["frame"] == rows.groupby("view", dropna=False)["frame"].transform("max")
        held = rows[last]
        yield rows[~last].assign(newest=False)
    if held is not None:
        yield held.assign(newest=True)


class ShownTiles(StatefulProcessor):
    """The tiles that a view shows, and its last frame; frames come in order, those not later than the last one are ignored, of equal ones the first camera counts.

    Told are frames, each with the camera before it; the first one of a batch instead has the tiles that the state says are shown.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame long")
        self.shown = handle.getMapState("shown", "level int, x long, y long", "frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat(rows)
        frames = rows.loc[rows["level"] < 0, ["frame", "cx", "cy"]].sort_values(["frame", "cx", "cy"]).drop_duplicates("frame")
        if self.last.exists():
            frames = frames[frames["frame"] > self.last.get()[0]]
        if frames.empty:
            return
        newest = frames.iloc[-1]
        last = int(frames["frame"].iloc[-1])
        before = {tuple(map(int, k)) for k, _ in self.shown.iterator()}
        own = rows[(rows["level"] >= 0) & (rows["frame"] == last) & (rows["cx"] == newest["cx"]) & (rows["cy"] == newest["cy"])]
        now = set(zip(own["level"].tolist(), own["x"].tolist(), own["y"].tolist()))
        told = frames.assign(view=key[0], px=frames["cx"].shift(), py=frames["cy"].shift())
        shown = ["/".join(map(str, t)) for t in sorted(before)]
        told["shown"] = pd.Series([shown, *[None] * (len(told) - 1)], index=told.index, dtype=object)
        yield told[["view", "frame", "cx", "cy", "px", "py", "shown"]]
        for t in before - now:
            self.shown.removeKey(t)
        for t in now - before:
            self.shown.updateValue(t, (last,))
        self.last.update((last,))

    def close(self) -> None:
        pass


def cut_stream(cameras: DataFrame, tiles: DataFrame, *, depth: int, threshold: float = 16.0, error: float = 64.0, pixels: float = 4.0) -> DataFrame:
    """CHANGES rows for a stream of cameras (view, frame, cx, cy) over a static table of tiles (level, x, y): what each frame shows, and what it no longer does."""
    use_rocksdb(cameras.sparkSession)
    rules = (depth, threshold, error, pixels)
    static = tiles.select("level", "x", "y", F.lit(True).alias("there")).dropDuplicates(["level", "x", "y"])
    frames = cameras.select("view", "frame", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).where("frame IS NOT NULL")
    marked = frames.mapInPandas(newest_marked, "view string, frame long, cx double, cy double, newest boolean")
    # of all but the last frames the state needs no tiles: they are found again below, beside those of the frame after
    itself = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    tile = F.explode(F.when(F.col("newest"), F.concat(itself, _cells(*rules, "cx", "cy"))).otherwise(itself)).alias("tile")
    near = marked.select("view", "frame", "cx", "cy", tile).select("view", "frame", "cx", "cy", "tile.*").where((F.col("level") < 0) | _in_cut(*rules, NOW))
    seen = near.join(static, ["level", "x", "y"], "left").where("there OR level < 0").select("view", "frame", "cx", "cy", "level", "x", "y")
    ordered = seen.groupBy("view").transformWithStateInPandas(statefulProcessor=ShownTiles(), outputStructType=ORDERED, outputMode="Update", timeMode="None")
    return _changes(ordered.repartition("view", "frame"), static, *rules)


def _cuts(rows: DataFrame, *rules) -> DataFrame:
    """rows (.., level, x, y, now, was) go down: each tile that is in the cut of the camera (now) or of the one before (was), from those that both have to look at."""
    kept = [c for c in rows.columns if c not in ("level", "x", "y", "now", "was")]
    level, x, y, now, was = (F.col(c) for c in ("level", "x", "y", "now", "was"))
    tile = lambda lod, a, b, n, w: F.struct(lod.alias("level"), a.alias("x"), b.alias("y"), n.alias("now"), w.alias("was"))
    for k in range(rules[0]):
        here = F.coalesce(level == k, F.lit(False)) & ~F.col("gone")
        rows = rows.withColumns({"__now": here & now & _refines(*rules, NOW, F.lit(k), x, y), "__was": here & was & _refines(*rules, BEFORE, F.lit(k), x, y)})
        own = tile(level, x, y, now & ~F.col("__now"), was & ~F.col("__was"))
        children = [tile(F.lit(k + 1), x * 2 + i, y * 2 + j, F.col("__now"), F.col("__was")) for i in (0, 1) for j in (0, 1)]
        stays = (now & ~F.col("__now")) | (was & ~F.col("__was"))
        below = F.when(~(F.col("__now") | F.col("__was")), F.array(own)).when(stays, F.array(own, *children)).otherwise(F.array(*children))
        rows = rows.select(*kept, F.explode(below).alias("tile")).select(*kept, "tile.*").coalesce(APART)
    return rows


def _changes(ordered: DataFrame, static: DataFrame, *rules) -> DataFrame:
    """CHANGES rows of ORDERED frames: tiles in the cut of the camera or the one before, and for a frame without one before what the state says is shown."""
    first = F.col("shown").isNotNull()
    part = lambda s, i: F.element_at(F.split(s, "/"), i)
    tile = lambda lod, a, b, now, was, gone: F.struct(lod.cast("int").alias("level"), a.cast("long").alias("x"), b.cast("long").alias("y"), now.alias("now"), was.alias("was"), F.lit(gone).alias("gone"))
    top = F.array(tile(F.lit(0), F.lit(0), F.lit(0), _known(NOW), ~first & _known(BEFORE), False))
    told = F.transform("shown", lambda s: tile(part(s, 1), part(s, 2), part(s, 3), F.lit(False), F.lit(True), True))
    columns = ["view", "frame", "cx", "cy", "px", "py", "shown"]
    begun = ordered.select(*columns, F.explode(F.when(first, F.concat(top, told)).otherwise(top)).alias("tile")).select(*columns, "tile.*")
    near = _cuts(begun, *rules).where("now OR was").join(static, ["level", "x", "y"], "left")
    there = F.coalesce("there", F.lit(False))
    # what was shown before the batch may have no tile in the table any more
    now = there & F.when(F.col("gone"), _in_cut(*rules, NOW)).otherwise(F.col("now"))
    was = F.when(F.col("gone"), True).when(first, F.array_contains("shown", F.concat_ws("/", "level", "x", "y"))).otherwise(there & F.col("was"))
    change = F.when(now & ~F.col("gone"), F.when(was, "stay").otherwise("enter")).when(was & ~now & (F.col("gone") | ~first), "leave")
    return near.select("view", "frame", "level", "x", "y", change.alias("change")).where("change IS NOT NULL")


def duration_stream(starts: DataFrame, ends: DataFrame, *, late: str = "1 minute", longest: str = "1 hour") -> DataFrame:
    """(name, key, ts, seconds) of streams (name, key, ts) of starts and ends: one row for each start.

    A start or end that is told again counts once, one that comes later than `late` behind the newest is lost.  seconds is null for a start
    that has no end within `longest`; it is told once none can come any more.  State is kept that long and no longer.
    """
    once = lambda df: df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["name", "key"])
    s = once(starts).select("name", "key", "ts")
    e = once(ends).select(F.col("name").alias("end_name"), F.col("key").alias("end_key"), F.col("ts").alias("end_ts"))
    met = F.expr(f"name = end_name AND key = end_key AND end_ts >= ts AND end_ts <= ts + INTERVAL {longest}")
    return s.join(e, met, "leftOuter").select("name", "key", "ts", ((F.unix_micros("end_ts") - F.unix_micros("ts")) / 1e6).alias("seconds"))
