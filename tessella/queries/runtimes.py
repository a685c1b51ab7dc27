"""What happens between frames, on the events table: each user is a runtime (or a tile of one), each event a frame, load or metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cache as C
from tessella.operators import metrics as M
from tessella.operators import runtime as O
from tessella.queries.common import Registry, long, table
from tessella.storage import settled

R = Registry()


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("clock_ms"))


@R.query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, value > 60 AS refining FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, e.value > CASE WHEN f.refining THEN 60 * (1 - 0.5) ELSE 60 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, refining FROM f""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.hysteresis(_frames(spark, sf_dir), key=["user_id"], order=["event_id"], sse="value", threshold=60.0, ratio=0.5)
    return out.select("event_id", "refining")


@R.query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value > 100 AS q, epoch_us(ts) // 1000 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, q AS refining, NULL::bigint AS since, false AS delayed FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, e.q OR (f.refining AND e.c < coalesce(f.since, e.c) + 100000000), CASE WHEN e.q OR NOT f.refining THEN NULL ELSE coalesce(f.since, e.c) END, NOT e.q AND f.refining AND e.c < coalesce(f.since, e.c) + 100000000
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, refining, delayed FROM f""")
def coarsening_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    frames = _frames(spark, sf_dir).withColumns({"frame": F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"), "required": F.col("value") > 100})
    return O.coarsening_delay(frames, key=["user_id"], delay_ms=100_000_000).select("event_id", "refining", "delayed")


@R.query("""WITH b AS (SELECT user_id, count(*) FILTER (event_id % 40 = 0) AS busy FROM events GROUP BY 1), r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE event_id % 40 > 0)
SELECT user_id, event_id AS resource, value AS priority, n AS rank FROM r JOIN b USING (user_id) WHERE n <= 4 - busy""")
def priority_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four loads at a time for each user: every fortieth event is under way, the others are asked for at their value."""
    events = _frames(spark, sf_dir)
    asked = events.where("event_id % 40 > 0").select("user_id", F.col("event_id").alias("resource"), F.col("value").alias("priority"), F.col("event_id").alias("ord"))
    running = events.where("event_id % 40 = 0").select("user_id", F.col("event_id").alias("resource"))
    return O.schedule(asked, key=["user_id"], slots=4, running=running).select("user_id", "resource", "priority", long("rank").alias("rank"))


@R.query("SELECT user_id, epoch_us(ts) // 3600000000 AS hour, max(event_id) AS event_id, arg_max(value, event_id) AS value, bit_or(1 << (event_id % 5)::int)::bigint AS change_flags, count(*) AS pushed FROM events GROUP BY ALL")
def frame_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = _frames(spark, sf_dir).select("user_id", F.expr("clock_ms div 3600000").alias("hour"), "event_id", "value", F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("event_id") % 5).cast("int")).alias("change_flags"))
    return O.coalesce_frames(cameras, key=["user_id"], batch="hour", order="event_id").select("user_id", "hour", "event_id", "value", "change_flags", "pushed")


CACHE = """c AS (SELECT user_id, event_id, event_id % 7 = 0 AS protected, event_id < 40 AS stale, (value * 100)::bigint AS cpu, (event_id % 50)::bigint AS gpu FROM events),
t AS (SELECT *, count(*) OVER w AS n_all, sum(cpu) OVER w AS cpu_all, sum(gpu) OVER w AS gpu_all FROM c WINDOW w AS (PARTITION BY user_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n_gone, coalesce(sum(cpu) OVER w, 0) AS cpu_gone, coalesce(sum(gpu) OVER w, 0) AS gpu_gone FROM t WHERE NOT protected WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@R.query(f"WITH {CACHE} SELECT event_id, CASE WHEN stale THEN 'stale' WHEN n_all - n_gone > 50 THEN 'entry-budget' WHEN cpu_all - cpu_gone > 150000 THEN 'cpu-budget' WHEN gpu_all - gpu_gone > 600 THEN 'gpu-budget' END AS reason FROM g WHERE reason IS NOT NULL")
def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evict_contents(_contents(spark, sf_dir), key=["user_id"], budgets=C.Budgets(max_contents=50, max_cpu_bytes=150_000, max_gpu_bytes=600)).select(F.col("content_id").alias("event_id"), "reason")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    return _frames(spark, sf_dir).select("user_id", id_.alias("content_id"), id_.alias("touched"), id_.alias("seq"), (id_ < 40).alias("stale"), F.round(F.col("value") * 100).cast("long").alias("cpu"), (id_ % 50).alias("gpu"), (id_ % 7 == 0).alias("protected"))


@R.query("SELECT user_id, greatest(20, count(*) FILTER (event_id % 7 = 0) * 1.5)::double AS budget, count(*) AS contents FROM events GROUP BY user_id")
def adaptive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_user = _contents(spark, sf_dir).groupBy("user_id").agg(F.count_if("protected").alias("shown"), F.count(F.lit(1)).alias("contents"))
    return per_user.select("user_id", C.adaptive_budget(20.0, F.col("shown"), 1.5).alias("budget"), "contents")


@R.query("WITH s AS (SELECT user_id, event_type, max(event_id) AS touched, count(*) * 100 AS bytes FROM events GROUP BY ALL), t AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id) AS all_bytes, count(*) OVER (PARTITION BY user_id) AS n FROM s), g AS (SELECT *, coalesce(sum(bytes) OVER w, 0) AS gone, count(*) OVER w AS k FROM t WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY touched ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_type AS subtree_id, CASE WHEN n - k > 4 THEN 'entry-budget' ELSE 'byte-budget' END AS reason, bytes AS released_bytes FROM g WHERE n - k > 4 OR all_bytes - gone > 5000")
def subtree_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    subtrees = _frames(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("subtree_id")).agg(F.max("event_id").alias("touched"), (F.count(F.lit(1)) * 100).alias("bytes"))
    rows = subtrees.withColumns({"seq": F.col("touched"), "stale": F.lit(False), "protected": F.col("subtree_id") == "error"})
    return C.evict_subtrees(rows, key=["user_id"], budgets=C.Budgets(max_subtrees=4, max_subtree_bytes=5000))


@R.query("SELECT event_type AS name, count(value) AS count, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max, arg_max(value, event_id) AS latest FROM events GROUP BY 1")
def metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.metric_aggregate(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), order="event_id")
    return rows.withColumn("sum", F.round("sum", 2))


@R.query("SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 6 = 0) AS idle, count(*) FILTER (event_id % 6 = 3) AS ready, count(*) FILTER (event_id % 6 = 4) AS failed, count(*) FILTER (event_id % 6 = 5) AS cancelled, sum(event_id)::bigint AS total FROM events GROUP BY 1")
def statistics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in M.STATES]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("status", status)
    return M.statistics(rows, key=["user_id"], amount="event_id").select("user_id", "n", "idle", "ready", "failed", "cancelled", "total")


@R.query("WITH g AS (SELECT user_id, count(*) AS current FROM events WHERE event_type = 'signup' GROUP BY 1), r AS (SELECT event_id, user_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS a, event_type FROM events) SELECT r.event_id FROM r JOIN g USING (user_id) WHERE r.a = g.current AND r.event_type = 'view'")
def late_result_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are results of the activation that was current then (the signups so far); only those of the last one still count."""
    from pyspark.sql import Window

    events = _frames(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    results = events.withColumn("activation_id", F.count_if(F.col("event_type") == "signup").over(w)).where("event_type = 'view'")
    changes = O.activation_generations(events.where("event_type = 'signup'"), key=["user_id"], order="event_id")
    current = changes.groupBy("user_id").agg(F.max("activation_id").alias("activation_id"))
    return O.drop_late(results, current, key=["user_id"]).select("event_id")


def branch_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of each user's tiles (types below the user, hours below types) that are pruned."""
    e = _frames(spark, sf_dir).withColumn("hour", F.expr("clock_ms div 21600000"))
    leaf = e.groupBy("user_id", F.concat_ws("/", F.lit("r"), "event_type", F.col("hour").cast("string")).alias("tile_id"), F.concat(F.lit("r/"), F.col("event_type")).alias("parent_id")).agg(F.max("event_id").alias("touched"))
    kind = e.groupBy("user_id", F.concat(F.lit("r/"), F.col("event_type")).alias("tile_id"), F.lit("r").alias("parent_id")).agg(F.max("event_id").alias("touched"))
    rows = leaf.withColumn("depth", F.lit(2)).unionByName(kind.withColumn("depth", F.lit(1))).withColumns({"key": F.col("user_id"), "stale": F.col("touched") % 3 == 0, "protected": F.col("touched") % 5 == 0})
    return C.prune_branches(rows.select("key", "tile_id", "parent_id", "depth", "touched", "stale", "protected"), budgets=C.Budgets(max_tiles=8))


def stream_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of frames through the stateful refinement; what it wrote."""
    import uuid

    from tessella.streaming.runtime import REFINEMENT, refinement_stream

    frames = _frames(spark, sf_dir).select(F.lit("r").alias("runtime"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tile_id"), F.col("event_id").alias("frame"), "clock_ms", F.col("value").alias("sse"), F.lit(False).alias("required"))
    settled(frames.limit(0))  # sets the shared folder where it is unset
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    frames.write.parquet(f"{folder}/in")
    stream = refinement_stream(spark.readStream.schema(frames.schema).parquet(f"{folder}/in"), threshold=60.0, hysteresis=0.5, delay_ms=0)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{n}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(REFINEMENT).option("recursiveFileLookup", "true").parquet(f"{folder}/out").select(F.col("frame").alias("event_id"), "refining")


STREAM_SQL = R.oracles["hysteresis"]
R.query()(branch_pruning)
R.query(STREAM_SQL)(stream_runtime)
QUERIES, ORACLES = R.queries, R.oracles
