"""Handles of names that come and go."""

from pyspark.sql import functions as F

from tessella.operators import handles as H
from tessella.operators.metadata import with_handles


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def got(df):
    return {(r["name"], r["handle"]) for r in df.collect()}


def test_handles_come_and_go(spark):
    first = H.with_names(None, named(spark, "c", "a", None, "b", "a"))
    assert got(first) == {("a", 0), ("b", 1), ("c", 2)}
    less = H.without_names(first, named(spark, "a", "b", "x", None))
    assert got(less) == {(None, 0), (None, 1), ("c", 2)}
    again = H.with_names(less, named(spark, "c", "z"))
    assert got(again) == {("z", 0), (None, 1), ("c", 2)}
    more = H.with_names(again, named(spark, "d", "e", "f", "z"))
    assert got(more) == {("z", 0), ("d", 1), ("c", 2), ("e", 3), ("f", 4)}
    assert H.with_names(None, named(spark)).count() == 0 and got(H.with_names(more, named(spark))) == got(more)


def test_handles_of_many_names_have_no_gaps(spark):
    names = spark.range(5000).select((F.col("id") * 7919 % 100_003).cast("string").alias("name"))
    first = H.with_names(None, names)
    assert sorted(r["handle"] for r in first.collect()) == list(range(5000))
    both = H.with_names(first, spark.range(3000).select((-F.col("id") - 1).cast("string").alias("name")))
    assert sorted(r["handle"] for r in both.collect()) == list(range(8000)) and first.join(both, ["name", "handle"], "left_anti").isEmpty()
    placed = H.placed(spark.range(1000).select((F.col("id") % 10).alias("v")), "v").collect()
    assert [r["v"] for r in sorted(placed, key=lambda r: r["place"])] == sorted(i % 10 for i in range(1000))


def test_handles_of_snapshots(spark):
    rows = spark.createDataFrame([("s2", 1), ("s1", 2), ("s2", 3), (None, 4)], "snapshot string, v int")
    with_them, table = with_handles(rows)
    assert {(r["v"], r["handle"]) for r in with_them.collect()} == {(1, 1), (2, 0), (3, 1), (4, None)}
    later, _ = with_handles(spark.createDataFrame([("s0", 5), ("s2", 6)], rows.schema), table)
    assert {(r["v"], r["handle"]) for r in later.collect()} == {(5, 2), (6, 1)}
