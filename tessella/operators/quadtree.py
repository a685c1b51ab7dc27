"""Neighbourhood and 2:1 balance of quadtree cuts, as joins on ancestors.

A cut is rows (ns, lod, x, y, ...): ns parts quadtrees, which are independent unless seams say how their edges meet.  A tile's neighbours
lie at its own level; those coarser are found by looking up the neighbours' ancestors, so every join here is an equi-join on (ns, lod, x, y) and
a tile makes at most eight times its level many rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.implicit import ancestor
from tessella.storage import settled

EDGES = ((0, -1), (-1, 0), (1, 0), (0, 1))
CORNERS = ((-1, -1), (1, -1), (-1, 1), (1, 1))
KEY = ("ns", "lod", "x", "y")
MOST_PASSES = 32


def neighbors(cut: DataFrame, *, corners: bool = False, wrap_x: bool = False, topology: Callable[[Column, Column, Column, int, int], Column] | None = None, seams: DataFrame | None = None) -> DataFrame:
    """A row for each neighbour (edge, nns, nx, ny) across an edge, or a corner too; off the pyramid there is none.

    wrap_x joins the first and last column.  topology(lod, x, y, dx, dy) gives a struct (x, y), null for none, in place of both.  seams: (ns, edge,
    other, other_edge, flipped), how the trees' edges meet (edges by their place in EDGES): tiles at an edge then have neighbours in other trees.
    """
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lod").cast("int"))
    steps = [*EDGES, *(CORNERS if corners else ())]
    if seams is not None:
        return _across(cut, steps, seams, side)

    def one(i: int, dx: int, dy: int) -> Column:
        if topology:
            at = topology(F.col("lod"), F.col("x"), F.col("y"), dx, dy)
            return F.when(at.isNotNull(), F.struct(F.lit(i).alias("edge"), F.col("ns").alias("nns"), at["x"].cast("long").alias("nx"), at["y"].cast("long").alias("ny")))
        x, y = (F.col("x") + dx).cast("long"), (F.col("y") + dy).cast("long")
        x = F.pmod(x, side) if wrap_x else x
        inside = (x >= 0) & (x < side) & (y >= 0) & (y < side)
        return F.when(inside, F.struct(F.lit(i).alias("edge"), F.col("ns").alias("nns"), x.alias("nx"), y.alias("ny")))

    rows = cut.select("*", F.array_compact(F.array(*[one(i, *s) for i, s in enumerate(steps)])).alias("__n"))
    return rows.select(*cut.columns, F.inline("__n"))


def _across(cut: DataFrame, steps, seams: DataFrame, side: Column) -> DataFrame:
    """neighbors() over seams.  A step that leaves a tree crosses the seam of that edge; one past a corner crosses the seam in x and goes on along the edge it came
    out at, over a second seam.  Where three trees meet at a corner that is the neighbour across the other edge, where four do, the one that only the corner touches."""
    step = F.array(*[F.struct(F.lit(i).alias("edge"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(steps)])
    rows = cut.withColumn("s", F.explode(step)).withColumns({"side": side, "nx": (F.col("x") + F.col("s.dx")).cast("long"), "ny": (F.col("y") + F.col("s.dy")).cast("long")})
    off_x, off_y = (F.col("nx") < 0) | (F.col("nx") >= F.col("side")), (F.col("ny") < 0) | (F.col("ny") >= F.col("side"))
    out = [*cut.columns, "edge", "nns", "nx", "ny"]
    inside = rows.where(~off_x & ~off_y).withColumns({"edge": F.col("s.edge"), "nns": F.col("ns")}).select(*out)
    # the edge crossed, where on it, and which way along it one goes on after that
    crossing = rows.where(off_x | off_y).withColumns({
        "exit": F.when(off_x, F.when(F.col("nx") < 0, 1).otherwise(2)).otherwise(F.when(F.col("ny") < 0, 0).otherwise(3)),
        "along": F.when(off_x & off_y, F.col("y")).when(off_x, F.col("ny")).otherwise(F.col("nx")).cast("long"), "on": F.when(off_x & off_y, F.col("s.dy")).otherwise(0),
    })
    seam = seams.select(F.col("ns").alias("from"), F.col("edge").alias("exit"), "other", F.col("other_edge").alias("entry"), "flipped")
    landed = crossing.withColumn("from", F.col("ns")).join(seam, ["from", "exit"])
    turned = F.when(F.col("flipped"), F.col("side") - 1 - F.col("along")).otherwise(F.col("along"))
    landed = landed.withColumns({"along": turned, "on": F.when(F.col("flipped"), -F.col("on")).otherwise(F.col("on"))})
    # at a corner: the end of the entry edge that one goes on to, and how far from it along the next one
    again = landed.where("on <> 0").select(*cut.columns, "s", "side", F.col("other").alias("from"), F.when(F.col("entry").isin(0, 3), F.when(F.col("on") < 0, 1).otherwise(2)).otherwise(F.when(F.col("on") < 0, 0).otherwise(3)).alias("exit"), F.when(F.col("entry").isin(2, 3), F.col("side") - 1).otherwise(0).cast("long").alias("along"))
    again = again.join(seam, ["from", "exit"]).withColumn("along", turned)
    x = F.when(F.col("entry").isin(0, 3), F.col("along")).when(F.col("entry") == 1, 0).otherwise(F.col("side") - 1).cast("long")
    y = F.when(F.col("entry").isin(1, 2), F.col("along")).when(F.col("entry") == 0, 0).otherwise(F.col("side") - 1).cast("long")
    found = lambda df: df.withColumns({"edge": F.col("s.edge"), "nns": F.col("other"), "nx": x, "ny": y}).select(*out)
    return inside.unionByName(found(landed.where("on = 0"))).unionByName(found(again))


def cube_seams(spark: SparkSession) -> DataFrame:
    """The seams of a cube's faces +x, -x, +y, -y, +z, -z: found from where the faces' edges lie in space."""
    edges: dict = {}
    for axis in range(3):
        for sign in (1, -1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            corner = lambda a, b, axis=axis, sign=sign, u=u, v=v: tuple({axis: sign, u: 2 * a - 1, v: 2 * b - 1}[i] for i in range(3))
            for edge, ends in enumerate((((0, 0), (1, 0)), ((0, 0), (0, 1)), ((1, 0), (1, 1)), ((0, 1), (1, 1)))):
                first, last = (corner(*e) for e in ends)
                edges.setdefault(frozenset((first, last)), []).append(("+-"[sign < 0] + "xyz"[axis], edge, first))
    rows = [(*a[:2], *b[:2], a[2] != b[2]) for pair in edges.values() for a, b in (pair, pair[::-1])]
    return spark.createDataFrame(rows, "ns string, edge int, other string, other_edge int, flipped boolean")


def _climbed(rows: DataFrame, least: int) -> DataFrame:
    """Rows for the neighbour's ancestors from `least` levels up (0: itself): a_ns, a_lod, a_x, a_y."""
    up = F.when(F.col("lod") >= least, F.sequence(F.lit(least), F.col("lod").cast("int")))
    out = rows.withColumn("up", F.explode(up))
    return out.withColumns({"a_ns": F.col("nns"), "a_lod": F.col("lod") - F.col("up"), "a_x": ancestor(F.col("nx"), F.col("up")), "a_y": ancestor(F.col("ny"), F.col("up"))})


AT = ["a_ns", "a_lod", "a_x", "a_y"]


def _named_at(tiles: DataFrame) -> DataFrame:
    return tiles.select(*[F.col(k).alias(a) for k, a in zip(KEY, AT)])


def _named_key(tiles: DataFrame) -> DataFrame:
    return tiles.select(*[F.col(a).alias(k) for k, a in zip(KEY, AT)])


def _keys(tiles: DataFrame) -> DataFrame:
    return _named_at(tiles).distinct()


def touching(tiles: DataFrame, others: DataFrame, **edges) -> DataFrame:
    """The tiles that touch, by an edge or a corner, one of others at their level or coarser."""
    found = _climbed(neighbors(tiles.select(*KEY).distinct(), corners=True, **edges), 0).join(_keys(others), AT, "left_semi")
    return tiles.join(found.select(*KEY).distinct(), list(KEY), "left_semi")


def imbalances(cut: DataFrame, **edges) -> DataFrame:
    """(ns, lod, x, y, coarse_lod): tiles with an edge neighbour two or more levels coarser.

    Across each edge the finest such neighbour counts, and of the edges the coarsest.
    """
    found = _climbed(neighbors(cut.select(*KEY), **edges), 2).join(_keys(cut), AT, "left_semi")
    per_edge = found.groupBy(*KEY, "edge").agg(F.max("a_lod").alias("a_lod"))
    return per_edge.groupBy(*KEY).agg(F.min("a_lod").alias("coarse_lod"))


def balance_refinements(cut: DataFrame, **edges) -> DataFrame:
    """(ns, lod, x, y): tiles that must refine for the cut to be balanced, shown or not."""
    found = _climbed(neighbors(cut.select(*KEY), **edges), 2)
    return _named_key(found).distinct()


def refine_cut(cut: DataFrame, ready: DataFrame | None = None, *, most_passes: int | None = None, **edges) -> tuple[DataFrame, DataFrame]:
    """(balanced, blocked): the cut with coarse neighbours split until levels across edges differ by one at most.

    ready: (ns, lod, x, y) of tiles whose four children may be shown; null for all.  Rounds over the whole set reach
    the same cut as splitting one tile at a time.  blocked has (ns, lod, x, y) of the cut's tiles that led to a split which is
    not ready: both sides, or the tiles they were split from.  It is empty if and only if the result is balanced; a cut with blocked
    tiles must not be shown as a whole.  Both have the columns ns, lod, x, y.
    """
    first = now = settled(cut.select("ns", "lod", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct())
    can = None if ready is None else settled(_keys(ready).withColumn("can", F.lit(True)))
    causes, stuck = [], None  # of each round, (a_*: the tile split, ns, lod, x, y: a finer one that it stands beside)
    for _ in range(most_passes or 64):
        beside = _climbed(neighbors(now, **edges), 2).join(_keys(now), AT, "left_semi").select(*AT, *KEY).distinct()
        if can is None:
            split = settled(beside.select(*AT).distinct())
        else:
            pairs = settled(beside.join(can, AT, "left"))
            stuck, causes = pairs.where("can IS NULL"), [*causes, pairs.where("can").select(*AT, *KEY)]
            split = pairs.where("can").select(*AT).distinct()
        if split.isEmpty():
            break
        gone = _named_key(split)
        child = F.array(*[F.struct((F.col("lod") + 1).alias("lod"), (F.col("x") * 2 + (i & 1)).alias("x"), (F.col("y") * 2 + (i >> 1)).alias("y")) for i in range(4)])
        fresh = gone.select("ns", F.explode(child).alias("c")).select("ns", "c.*")
        now = settled(now.join(gone, list(KEY), "left_anti").unionByName(fresh))
    return now, first.limit(0) if stuck is None else _traced(stuck, causes, first)


def _traced(stuck: DataFrame, causes: list[DataFrame], first: DataFrame) -> DataFrame:
    """The tiles of the first cut from which both sides of what is stuck came: a tile that was split off came from its parent and from what the parent was split for."""
    seen = frontier = settled(stuck.select(*KEY).unionByName(_named_key(stuck.select(*AT))).distinct())
    every = reduce(DataFrame.unionByName, causes)
    while True:
        made = settled(frontier.join(first, list(KEY), "left_anti").select("ns", (F.col("lod") - 1).alias("lod"), ancestor(F.col("x"), 1).alias("x"), ancestor(F.col("y"), 1).alias("y")).distinct())
        if made.isEmpty():
            return settled(first.join(seen, list(KEY), "left_semi"))
        behind = made.unionByName(every.join(_named_at(made), AT, "left_semi").select(*KEY)).distinct()
        frontier = settled(behind.join(seen, list(KEY), "left_anti"))
        seen = settled(seen.unionByName(frontier))


def held_refinements(unbalanced: DataFrame, tiles: DataFrame, refined_before: DataFrame) -> DataFrame:
    """(ns, lod, x, y): ancestors to hold so that a tile does not stand beside one two or more levels coarser.

    unbalanced: imbalances(); tiles: (ns, lod, x, y, ready).  Of the ancestors one level above the coarse neighbour or at its
    level, the finest that is ready holds, unless it was refined (refined_before) when the frame began.
    """
    up = unbalanced.where("lod > coarse_lod").withColumn("a_lod", F.explode(F.array("coarse_lod", F.col("coarse_lod") + 1))).where("a_lod < lod")
    up = up.withColumns({"a_x": ancestor(F.col("x"), F.col("lod") - F.col("a_lod")), "a_y": ancestor(F.col("y"), F.col("lod") - F.col("a_lod"))})
    able = tiles.where("ready").select("ns", F.col("lod").alias("a_lod"), F.col("x").alias("a_x"), F.col("y").alias("a_y")).distinct()
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("a_lod")))
    pick = up.join(able, ["ns", *AT[1:]]).withColumn("n", first).where("n = 1").select("ns", F.col("a_lod").alias("lod"), F.col("a_x").alias("x"), F.col("a_y").alias("y")).distinct()
    return pick.join(refined_before.select(*KEY).distinct(), list(KEY), "left_anti")
