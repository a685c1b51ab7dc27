"""Running sums against a loop, with one key that holds most rows."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.operators.prefix import sums_before, with_totals


def test_sums_before_of_a_large_key(spark):
    n = 20_000
    key = F.when(F.col("id") % 5 > 0, "large").when(F.col("id") % 50 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    rows = spark.range(n).select(key.alias("key"), (F.col("id") * 7919 % n).alias("at"), F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("v"))
    got = sums_before(rows, key=["key"], order=[F.desc("at")], sums={"n": F.lit(1), "total": F.col("v")})
    by_key = defaultdict(list)
    for r in got.collect():
        by_key[r["key"]].append((r["at"], r["v"] or 0, r["n"], r["total"]))
    assert sum(map(len, by_key.values())) == n and len(by_key["large"]) == n * 4 // 5 and None in by_key
    for found in by_key.values():
        total = 0
        for i, (_, v, before, sum_) in enumerate(sorted(found, reverse=True)):
            assert (before, sum_) == (i, total)
            total += v


def test_no_task_holds_the_large_key(spark):
    rows = spark.range(40_000).select(F.lit("one").alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sums_before(rows, key=["key"], order=[F.col("id")], sums={"n": F.lit(1)})
        sizes = Counter(r[0] for r in got.select(F.spark_partition_id()).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes.values()) == 40_000 and len(sizes) > 1 and max(sizes.values()) < 30_000


def test_totals_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, None)], "key string, v long")
    got = {(r["key"], r["v"], r["t"]) for r in with_totals(rows, key=["key"], totals={"t": F.sum("v")}).collect()}
    assert got == {("a", 1, 3), ("a", 2, 3), (None, 5, 5), (None, None, 5)}
    assert sums_before(rows.limit(0), key=["key"], order=[F.col("v")], sums={"n": F.lit(1)}).isEmpty()
