"""Level-of-detail cuts over gridded rows: the smallest useful query of the library.

Rows fall into the cells of a square grid of 2**depth cells a side, which are the leaves of a quadtree.  Cells are counted first; from
then on all is done on at most 4**depth rows, whatever the size of the data.  Whether a tile is reached is asked of its ancestors'
addresses, which are computed and not looked up, so there is no recursion and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.implicit import ancestor


def rolled_up(rows: DataFrame, x: Column, y: Column, depth: int) -> DataFrame:
    """(level, x, y, n): rows in each occupied tile of every level."""
    cells = rows.groupBy(x.cast("long").alias("cx"), y.cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = F.lit(depth) - F.col("level")
    return up.groupBy(F.col("level"), ancestor(F.col("cx"), shift).alias("x"), ancestor(F.col("cy"), shift).alias("y")).agg(F.sum("n").alias("n"))


def grid_error(level: Column, x: Column, y: Column, *, depth: int, camera: tuple[float, float], error: float, pixels: float) -> Column:
    """Pixels that a tile's error spans for a camera in the plane of the grid, in units of cells."""
    fold = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int")).cast("double")
    size = float(1 << depth) / fold
    dx, dy = (x + 0.5) * size - camera[0], (y + 0.5) * size - camera[1]
    gap = F.greatest(F.sqrt(dx * dx + dy * dy) - size / 2, F.lit(0.5))
    return error / fold * pixels / gap


def lod_cut(tiles: DataFrame, *, depth: int, camera: tuple[float, float], threshold: float = 16.0, error: float = 64.0, pixels: float = 4.0) -> DataFrame:
    """(level, x, y, n): the tiles that are reached and not refined: they cover every row once."""
    refines = lambda level, x, y: (level < depth) & (grid_error(level, x, y, depth=depth, camera=camera, error=error, pixels=pixels) > threshold)
    level, x, y = (F.col(c) for c in ("level", "x", "y"))
    above = F.when(level > 0, F.sequence(F.lit(1), level)).otherwise(F.array().cast("array<int>"))
    reached = F.forall(above, lambda k: refines(level - k, ancestor(x, k), ancestor(y, k)))
    return tiles.where(~refines(level, x, y)).where(reached)
