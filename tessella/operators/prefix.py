"""Running sums of keys of any size: rows sorted by range into stretches, sums of stretches, sums within them.

No task holds a whole key: a stretch is a part of a range sort by key and order, and of a key only its stretches' sums meet in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import settled


def _beside(rows: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    """rows with the further columns of facts, whose rows are told apart by names; nulls are equal."""
    named = facts.withColumnsRenamed({n: f"__of_{n}" for n in names})
    same = reduce(lambda s, t: s & t, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names])
    return rows.join(named, same).drop(*[f"__of_{n}" for n in names])


def with_totals(rows: DataFrame, *, key: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds aggregates of the row's key, counted in parts before they meet."""
    sums = rows.groupBy(*key).agg(*[c.alias(n) for n, c in totals.items()])
    return _beside(rows, sums, key)


def sums_before(rows: DataFrame, *, key: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum over the rows that stand before in the key's order, 0 for the first; nulls count as 0.

    Rows that tie in the order stand in any order among themselves, so an order that must be repeatable tells all rows apart.
    """
    values = {f"__{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    sorted_ = settled(rows.withColumns(values).repartitionByRange(*key, *order).withColumn("__stretch", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy(*key, "__stretch").agg(*[F.sum(v).alias(v) for v in values])
    offsets = parts.select(*key, "__stretch", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy(*key, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = _beside(sorted_, offsets, [*key, "__stretch"])
    return told.select(*rows.columns, *[(F.col(f"__{n}_before") + F.coalesce(F.sum(f"__{n}").over(within), F.lit(0))).alias(n) for n in sums])
