"""Joins of boxes that meet, on cells of their own size.

A box has a level: the least power of two that is no less than its longest side.  In a grid of that spacing it lies in at most two cells along each
axis, and so does every smaller box.  So two boxes are sought at the level of the larger one alone, on cells that both lie in: every join is an
equi-join, and each box makes at most eight rows for each level of the other side that is no lower than its own, most of them one.
A pair is told in one cell only, that of the lower corner of what the boxes share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "xyz"
#: Levels lie at most so far below the largest coordinate: numbers of cells then fit 64 bits.
FINEST = 48


def _corner(box: str, axis: str) -> Column:
    """A corner's coordinate, kept within what doubles can be divided by."""
    return F.greatest(F.lit(-1e300), F.least(F.lit(1e300), F.col(f"{box}.{axis}")))


def _sound(boxes: DataFrame, low: str, high: str) -> DataFrame:
    """Without boxes that lack a corner or are inside out."""
    for a in AXES:
        boxes = boxes.where((F.col(f"{low}.{a}") <= F.col(f"{high}.{a}")) & ~F.isnan(F.col(f"{low}.{a}")) & ~F.isnan(F.col(f"{high}.{a}")))
    return boxes


def _levelled(boxes: DataFrame, low: str, high: str, finest: float) -> DataFrame:
    longest = F.greatest(*[_corner(high, a) - _corner(low, a) for a in AXES])
    return boxes.withColumn("__level", F.greatest(F.lit(finest), F.when(longest > 0, F.ceil(F.log2(longest))).otherwise(finest)).cast("int"))


def _celled(boxes: DataFrame, low: str, high: str, level: Column) -> DataFrame:
    """A row for each cell (__x, __y, __z) of the level that a box lies in."""
    out = boxes.withColumn("__at", level)
    for a in AXES:
        cell = lambda box, a=a: F.floor(_corner(box, a) / F.pow(F.lit(2.0), F.col("__at"))).cast("long")
        out = out.withColumn(f"__{a}", F.explode(F.sequence(cell(low), cell(high))))
    return out


def _levels(boxes: DataFrame) -> list[int]:
    """The levels there are: a number for each power of two at most."""
    return sorted(r[0] for r in boxes.select("__level").distinct().collect())


def _upward(boxes: DataFrame, low: str, high: str, levels: list[int], *, own: bool) -> DataFrame:
    """Boxes in the cells of each of the levels above their own, or their own too."""
    above = F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: (v >= F.col("__level")) if own else (v > F.col("__level")))
    return _celled(boxes.withColumn("__up", F.explode(above)), low, high, F.col("__up")).drop("__up")


def candidates(left: DataFrame, right: DataFrame, *, low: str = "low", high: str = "high") -> DataFrame:
    """Structs (left, right) of boxes that share a cell at the level of the larger one; each pair that meets is among them once."""
    left, right = (_sound(d, low, high) for d in (left, right))
    edge = lambda d: d.agg(F.max(F.greatest(*[F.abs(_corner(b, a)) for a in AXES for b in (low, high)]))).first()[0] or 0.0
    most = max(edge(left), edge(right), 1e-250)
    finest = float(math.ceil(math.log2(most)) - FINEST)
    columns = {"left": left.columns, "right": right.columns}
    left, right = (_levelled(d, low, high, finest) for d in (left, right))
    shared = lambda a: F.floor(F.greatest(*[_corner(f"{side}.{low}", a) for side in columns]) / F.pow(F.lit(2.0), F.col("__at"))) == F.col(f"__{a}")
    cell = ["__at", "__x", "__y", "__z"]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pack = lambda d, side: d.select(*cell, F.struct(*columns[side]).alias(side))
        both = pack(a, "left").join(pack(b, "right"), cell)
        return both.where(shared("x") & shared("y") & shared("z")).select("left", "right")

    # the right box is the larger one, or of equal size; then the left one
    larger = met(_upward(left, low, high, _levels(right), own=True), _celled(right, low, high, F.col("__level")))
    return larger.unionAll(met(_celled(left, low, high, F.col("__level")), _upward(right, low, high, _levels(left), own=False)))


def box_join(left: DataFrame, right: DataFrame, *, low: str = "low", high: str = "high") -> DataFrame:
    """Structs (left, right) of all boxes that meet; touching counts.  low and high name corner structs (x, y, z).

    Boxes without corners, with NaN or inside out meet nothing; boxes may be unbounded and points, and repeated rows are boxes each.
    """
    found = candidates(left, right, low=low, high=high)
    for a in AXES:
        found = found.where((F.col(f"left.{high}.{a}") >= F.col(f"right.{low}.{a}")) & (F.col(f"left.{low}.{a}") <= F.col(f"right.{high}.{a}")))
    return found
