"""Numbers for names: unique, without gaps, kept when names come and go.

Rows are numbered in two levels, the parts of a range sort and the rows in them, so no task sees them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import settled

_IN_PART = (1 << 33) - 1


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0 without gaps; rows of equal order are placed as they come."""
    kept = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    parts = kept.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each part of the sort
    parts = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    found = kept.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(parts), "__part")
    return found.select(*rows.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit(_IN_PART))).alias(name))


def with_names(known: DataFrame | None, names: DataFrame) -> DataFrame:
    """(name, handle): the handles of known names, and of further ones; a row without a name is a free handle.

    Names that are known keep theirs.  New ones, in their order, take the free handles, least first, and then those that follow the largest.
    Null names have no handle; a name that stands in names twice has one.
    """
    fresh = names.select("name").where("name IS NOT NULL").distinct()
    if known is None:
        return settled(placed(fresh, "name", name="handle"))
    held = known.where("name IS NOT NULL").select("name", "handle")
    free = placed(known.where("name IS NULL").select("handle"), "handle")
    fresh = placed(fresh.join(held, "name", "left_anti"), "name")
    size, n_free = known.count(), free.count()
    joined = fresh.join(free, "place", "full")
    handle = F.coalesce("handle", F.lit(size - n_free) + F.col("place"))
    return settled(held.unionByName(joined.select("name", handle.alias("handle"))))


def without_names(known: DataFrame, gone: DataFrame) -> DataFrame:
    """known with the handles of the names in gone set free."""
    names = gone.select("name").where("name IS NOT NULL").distinct().withColumn("gone", F.lit(True))
    joined = known.join(names, "name", "left")
    return settled(joined.select(F.when(F.col("gone").isNull(), F.col("name")).alias("name"), "handle"))
