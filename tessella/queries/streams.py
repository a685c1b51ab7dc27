"""Streams over the driver's tables, in several micro-batches each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.queries.common import Registry, long, table
from tessella.queries.grids import DEPTH, _grid
from tessella.storage import settled, shared_folder
from tessella.streaming.cuts import CHANGES, cut_stream, duration_stream

R = Registry()


def _streamed(batches: list[DataFrame], stream_of: Callable[[DataFrame], DataFrame], *, mode: str, schema: str | None = None) -> DataFrame:
    """What a stream writes for the batches, one micro-batch each."""
    spark = batches[0].sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = stream_of(source)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{n}")

    found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema or found.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


THRESHOLD = 64.0


def _refines(level: str, x: str, y: str) -> str:
    size = f"(32.0::double / power(2.0::double, ({level})::double))"
    gap = f"greatest(sqrt((({x} + 0.5::double) * {size} - cx) * (({x} + 0.5::double) * {size} - cx) + (({y} + 0.5::double) * {size} - cy) * (({y} + 0.5::double) * {size} - cy)) - {size} / 2::double, 0.5::double)"
    return f"(({level}) < {DEPTH} AND (64.0::double / power(2.0::double, ({level})::double) * 4.0::double / {gap}) > {THRESHOLD}::double)"


_REACHED = " AND ".join(f"(t.level < {k} OR {_refines(f't.level - {k}', f'(t.x >> {k})', f'(t.y >> {k})')})" for k in range(1, DEPTH + 1))


@R.query(f"""WITH c AS (SELECT concat('v', user_id % 5) AS view, event_id AS frame, (event_id * 3 % 320)::double / 8 AS cx, (event_id // 7 % 320)::double / 8 AS cy, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i FROM events),
t AS (SELECT DISTINCT level, cx >> (5 - level) AS x, cy >> (5 - level) AS y FROM (SELECT o_custkey % 32 AS cx, (o_orderkey // 4) % 32 AS cy FROM orders), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS level)),
s AS (SELECT view, i, level, x, y FROM c, t WHERE NOT {_refines('t.level', 't.x', 't.y')} AND {_REACHED}),
d AS (SELECT coalesce(a.view, b.view) AS view, coalesce(a.i, b.i + 1) AS i, a.view IS NULL AS gone, b.view IS NULL AS fresh FROM s a FULL JOIN s b ON a.view = b.view AND a.i = b.i + 1 AND a.level = b.level AND a.x = b.x AND a.y = b.y)
SELECT view, frame, count(*) FILTER (fresh) AS entered, count(*) FILTER (NOT fresh AND NOT gone) AS stayed, count(*) FILTER (gone) AS "left" FROM d JOIN c USING (view, i) GROUP BY ALL""")
def shown_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of moving cameras as a stream over the grid of orders: how many tiles enter, stay and leave."""
    e = F.col("event_id")
    cameras = table(spark, sf_dir, "events").select(F.concat(F.lit("v"), (F.col("user_id") % 5).cast("string")).alias("view"), e.alias("frame"), ((e * 3 % 320).cast("double") / 8).alias("cx"), (F.expr("event_id div 7 % 320").cast("double") / 8).alias("cy"))
    grid = settled(_grid(spark, sf_dir))
    newest = cameras.agg(F.max("frame")).first()[0] or 0
    batches = [cameras.where((F.col("frame") > newest * i // 4 - (i == 0)) & (F.col("frame") <= newest * (i + 1) // 4)) for i in range(4)]
    found = _streamed(batches, lambda s: cut_stream(s, grid, depth=DEPTH, threshold=THRESHOLD), mode="update", schema=CHANGES)
    n = lambda change: F.count_if(F.col("change") == change)
    return found.groupBy("view", "frame").agg(n("enter").alias("entered"), n("stay").alias("stayed"), n("leave").alias("left"))


# events in pairs: the first starts something, the second ends it; some of the oldest third come last and are lost
@R.query("""WITH e AS (SELECT event_id, event_id // 2 AS key, event_id % 2 = 0 AS starts, ts, (SELECT max(event_id) FROM events) AS newest FROM events),
b AS (SELECT * FROM e WHERE NOT (event_id % 97 < 8 AND event_id <= newest // 3)),
s AS (SELECT key, ts FROM b WHERE starts), f AS (SELECT key, ts FROM b WHERE NOT starts)
SELECT concat('load-', s.key % 3) AS name, s.key, CASE WHEN epoch_us(f.ts) - epoch_us(s.ts) BETWEEN 0 AND 300000000 THEN (epoch_us(f.ts) - epoch_us(s.ts)) / 1e6::double END AS seconds FROM s LEFT JOIN f USING (key)""")
def stream_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends as streams: the seconds from one to the other, with some told twice, some too late and some without an end."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("load-"), (F.expr("event_id div 2") % 3).cast("string")).alias("name"), F.expr("event_id div 2").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (e % 2 == 0).alias("starts"))
    newest = rows.agg(F.max("event_id"), F.max("ts")).first()
    third = (newest[0] or 0) // 3
    late = (e % 97 < 8) & (e <= third)
    first, second = rows.where((e <= third) & ~late), rows.where((e > third) & (e <= 2 * third))
    again = first.where(e % 10 == 3).unionAll(first.where((e % 10 == 4) & (e > third - 40)))
    closing = spark.range(2).select(F.lit(-1).cast("long").alias("event_id"), F.lit("closing").alias("name"), F.col("id").alias("key"), (F.lit(newest[1]).cast("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("ts"), (F.col("id") == 0).alias("starts"))
    # a batch is held against what was the newest two batches before
    batches = [first.unionAll(again), second, rows.where(e > 2 * third), rows.where(late), closing]
    found = _streamed(batches, lambda s: duration_stream(s.where("starts"), s.where("NOT starts"), late="2 hours", longest="5 minutes"), mode="append")
    return found.where("name <> 'closing'").select("name", long("key").alias("key"), "seconds")


QUERIES, ORACLES = R.queries, R.oracles
