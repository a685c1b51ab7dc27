"""Implicit hierarchies: children from availability, overrides, grafts, ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.implicit import ancestor, child_coordinates, child_subtree_available, content_available, expand_template, implicit_error, local_coordinate, tile_available
from tessella.storage import settled


def children_of(tiles: DataFrame, *, octree: bool = False) -> DataFrame:
    """A row for each child of each tile (level, x, y[, z]): other columns stay, parent_* name the parent."""
    z = F.col("z") if octree else None
    names = ["level", "x", "y"] + (["z"] if octree else [])
    rest = [c for c in tiles.columns if c not in names]
    rows = tiles.select(*rest, *[F.col(c).alias(f"parent_{c}") for c in names], F.inline(child_coordinates(F.col("level"), F.col("x"), F.col("y"), z)))
    return rows


def next_level(tiles: DataFrame, subtrees: DataFrame, *, subtree_levels: int, available_levels: int, octree: bool = False) -> DataFrame:
    """The available children of tiles (level, x, y[, z], root_level, root_x, root_y[, root_z]).

    subtrees: (level, x, y[, z], subtree) of loaded subtrees.  A child inside its parent's subtree exists if its bit says so;
    one below it exists, as root of a further subtree, if the child-subtree bit says so.
    """
    axes = ["x", "y"] + (["z"] if octree else [])
    made = children_of(tiles.where(F.col("level") + 1 < available_levels).drop("child"), octree=octree)
    keys = ["root_level", *[f"root_{a}" for a in axes]]
    own = subtrees.select(F.col("level").alias("root_level"), *[F.col(a).alias(f"root_{a}") for a in axes], "subtree")
    joined = made.join(own, keys)
    local_level = F.col("level") - F.col("root_level")
    local = [local_coordinate(F.col(a), F.col("level"), F.col(f"root_{a}"), F.col("root_level")) for a in axes]
    crossing = local_level >= subtree_levels
    exists = F.when(crossing, child_subtree_available(F.col("subtree"), local_level, *local)).otherwise(tile_available(F.col("subtree"), F.when(crossing, 0).otherwise(local_level), *local))
    kept = joined.where(exists)
    moved = {"root_level": F.when(crossing, F.col("level")).otherwise(F.col("root_level"))} | {f"root_{a}": F.when(crossing, F.col(a)).otherwise(F.col(f"root_{a}")) for a in axes}
    return kept.withColumns(moved).select("level", *axes, *keys, "child")


def materialize(subtrees: DataFrame, *, subtree_levels: int, available_levels: int, octree: bool = False) -> DataFrame:
    """(level, x, y[, z], root_*, child): every available tile of an implicit tileset; a pass for each level."""
    axes = ["x", "y"] + (["z"] if octree else [])
    subtrees = settled(subtrees)  # looked up on every level
    roots = subtrees.where("level = 0")
    zero = [F.lit(0).cast("long").alias(a) for a in axes]
    level = roots.where(tile_available(F.col("subtree"), F.lit(0), *[F.lit(0).cast("long") for _ in axes])).select(F.lit(0).alias("level"), *zero, F.lit(0).alias("root_level"), *[F.lit(0).cast("long").alias(f"root_{a}") for a in axes], F.lit(0).alias("child"))
    out, level = [], settled(level)
    for _ in range(available_levels):
        out.append(level)
        level = settled(next_level(level, subtrees, subtree_levels=subtree_levels, available_levels=available_levels, octree=octree))
    return reduce(DataFrame.unionByName, out)


def implicit_contents(tiles: DataFrame, subtrees: DataFrame, templates: list[str], *, octree: bool = False) -> DataFrame:
    """(tile columns, content_index, uri) of the contents that are available."""
    axes = ["x", "y"] + (["z"] if octree else [])
    own = subtrees.select(F.col("level").alias("root_level"), *[F.col(a).alias(f"root_{a}") for a in axes], "subtree")
    rows = tiles.join(own, ["root_level", *[f"root_{a}" for a in axes]]).select("*", F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("content_index", "template"))
    local = [local_coordinate(F.col(a), F.col("level"), F.col(f"root_{a}"), F.col("root_level")) for a in axes]
    kept = rows.where(content_available(F.col("subtree"), F.col("content_index"), F.col("level") - F.col("root_level"), *local))
    return kept.withColumn("uri", expand_template(F.col("template"), F.col("level"), *[F.col(a) for a in axes])).drop("subtree", "template")


def implicit_tiles(tiles: DataFrame, volume: Column, root_error: Column) -> DataFrame:
    """Adds bounding_volume (an expression of level, x, y[, z]) and geometric_error."""
    return tiles.withColumns({"bounding_volume": volume, "geometric_error": implicit_error(root_error, F.col("level"))})


def overridden(tiles: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of overrides win over those of tiles of the same name where they are not null."""
    names = [c for c in overrides.columns if c not in keys]
    joined = tiles.join(overrides.select(*keys, *[F.col(c).alias(f"__{c}") for c in names]), keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", F.col(c)) if c in tiles.columns else F.col(f"__{c}") for c in names}).drop(*[f"__{c}" for c in names])


def grafted(tiles: DataFrame, grafts: DataFrame, graft_levels: int) -> DataFrame:
    """A quadtree (level, x, y) in which the subtrees below the tiles of grafts are replaced by full ones.

    grafts: (level, x, y).  At such a tile another tileset of graft_levels levels begins, whose coordinates count from 0; the tiles it
    replaces go.  Returns (context, level, x, y): context is null for the base and names the graft otherwise.
    """
    own = grafts.select(F.col("level").alias("g_level"), F.col("x").alias("g_x"), F.col("y").alias("g_y"))
    # only ancestors-or-self are looked up, so this is an equi-join on (level, x, y) of the ancestor
    rows = tiles.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level"))))
    rows = rows.withColumns({"g_level": F.col("level") - F.col("up"), "g_x": ancestor(F.col("x"), F.col("up")), "g_y": ancestor(F.col("y"), F.col("up"))})
    covered = rows.join(own, ["g_level", "g_x", "g_y"], "left_semi").select("level", "x", "y").distinct()
    base = tiles.join(covered, ["level", "x", "y"], "left_anti").select(F.lit(None).cast("string").alias("context"), "level", "x", "y")
    side = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c)) - 1))
    deep = grafts.select(F.concat_ws("/", F.lit("graft"), "level", "x", "y").alias("context"), F.explode(F.sequence(F.lit(0), F.lit(graft_levels - 1))).alias("level"))
    custom = deep.withColumn("x", side("level")).withColumn("y", side("level")).select("context", "level", "x", "y")
    return base.unionByName(custom)


def missing_subtrees(tiles: DataFrame, subtrees: DataFrame, attempts: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(level, x, y): subtree roots that tiles need and that are not loaded, unless they were tried `most` times."""
    need = tiles.select(F.col("root_level").alias("level"), F.col("root_x").alias("x"), F.col("root_y").alias("y")).distinct()
    out = need.join(subtrees.select("level", "x", "y"), ["level", "x", "y"], "left_anti")
    if attempts is not None:
        out = out.join(attempts.where(F.col("attempts") >= most).select("level", "x", "y"), ["level", "x", "y"], "left_anti")
    return out


def ancestors(tiles: DataFrame, id_col: str = "tile_id") -> DataFrame:
    """(id, ancestor, distance): a row for each proper ancestor, from the path that an id is."""
    parts = F.split(F.col(id_col), "/")
    up = tiles.select(id_col, parts.alias("p")).where(F.size("p") > 1).select(id_col, "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("distance"))
    return up.select(id_col, F.array_join(F.slice("p", F.lit(1), F.size("p") - F.col("distance")), "/").alias("ancestor"), "distance")


def is_descendant(tile: Column, above: Column) -> Column:
    return tile.startswith(F.concat(above, F.lit("/")))


def world_transforms(tiles: DataFrame) -> DataFrame:
    """(tile_id, world): the product of transforms from the root down; tiles have tile_id, parent_id, depth, transform.

    Each depth multiplies its parents' products once, so a tree of n tiles costs n products.
    """
    from tessella.functions.spatial import matrix_of, multiply

    local = settled(tiles.select("tile_id", "parent_id", "depth", F.array(*matrix_of(F.col("transform"))).alias("local")))
    deepest = local.agg(F.max("depth")).first()[0]
    level = settled(local.where("depth = 0").select("tile_id", F.col("local").alias("world")))
    out = [level]
    for depth in range(1, (deepest or 0) + 1):
        own = local.where(F.col("depth") == depth).join(level.select(F.col("tile_id").alias("parent_id"), F.col("world").alias("above")), "parent_id")
        level = settled(own.select("tile_id", F.array(*multiply([F.col("above")[i] for i in range(16)], [F.col("local")[i] for i in range(16)])).alias("world")))
        out.append(level)
    return reduce(DataFrame.unionAll, out)


def vertical_objects(worlds: DataFrame) -> DataFrame:
    """(tile_id, vertical_object): the first position from the root down to each tile, for tiles that have one; worlds: (tile_id, world)."""
    at = F.struct(F.col("world")[12].alias("x"), F.col("world")[13].alias("y"), F.col("world")[14].alias("z"))
    moved = worlds.select("tile_id", at.alias("p")).where("p.x <> 0 OR p.y <> 0 OR p.z <> 0")
    own = moved.select("tile_id", F.lit(0).alias("distance"), "p")
    above = ancestors(worlds.select("tile_id")).join(moved.select(F.col("tile_id").alias("ancestor"), "p"), "ancestor").select("tile_id", "distance", "p")
    return own.unionAll(above).groupBy("tile_id").agg(F.max_by("p", "distance").alias("vertical_object"))
