"""Trees made of regions, nations, customers and orders: products of transforms, scopes, grafts, holds, and what sweeps leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cache as C
from tessella.operators import handles as N
from tessella.operators import hierarchy as H
from tessella.operators import metadata as M
from tessella.operators import metrics as X
from tessella.operators import quadtree as Q
from tessella.operators import runtime as O
from tessella.operators import selection as S
from tessella.plans.metric import refined_heights
from tessella.queries.common import Registry, long, table
from tessella.queries.grids import DEPTH, SHARP_SQL, _grid, _sharp_cut, subtrees_of

R = Registry()
CUSTOMERS = "(SELECT c_custkey, n_nationkey, n_regionkey, concat('r', n_regionkey, '/', n_nationkey, '/', c_custkey) AS tile_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, c_custkey, n_nationkey, n_regionkey): the leaves of a tree of regions, nations and customers."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat(F.lit("r"), F.concat_ws("/", "n_regionkey", "n_nationkey", "c_custkey")).alias("tile_id"), "c_custkey", "n_nationkey", "n_regionkey")


def _matrix(scale: Column, *move: Column) -> Column:
    zero, s = F.lit(0.0), scale.cast("double")
    return F.array(s, zero, zero, zero, zero, s, zero, zero, zero, zero, s, zero, *[m.cast("double") for m in move], F.lit(1.0))


@R.query(f"""SELECT tile_id, (2 * (1 + n_nationkey % 2) * (1 + c_custkey % 3))::double AS scale, (n_regionkey + 2 * (n_nationkey + (1 + n_nationkey % 2) * (c_custkey % 10)))::double AS x, (2 * (1 + n_nationkey % 2) * (c_custkey % 7))::double AS z FROM {CUSTOMERS}""")
def world_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of transforms from regions down to customers."""
    leaf = _customers(spark, sf_dir)
    zero = F.lit(0)
    top = F.concat(F.lit("r"), "n_regionkey")
    mid = F.concat(top, F.lit("/"), F.col("n_nationkey").cast("string"))
    none = F.lit(None).cast("string")
    tiles = leaf.select(top.alias("tile_id"), none.alias("parent_id"), F.lit(0).alias("depth"), _matrix(F.lit(2), F.col("n_regionkey"), zero, zero).alias("transform")).distinct()
    tiles = tiles.unionAll(leaf.select(mid, top, F.lit(1), _matrix(1 + F.col("n_nationkey") % 2, F.col("n_nationkey"), zero, zero)).distinct())
    tiles = tiles.unionAll(leaf.select("tile_id", mid, F.lit(2), _matrix(1 + F.col("c_custkey") % 3, F.col("c_custkey") % 10, zero, F.col("c_custkey") % 7)))
    w = H.world_transforms(tiles).where(F.size(F.split("tile_id", "/")) == 3)
    return w.select("tile_id", F.col("world")[0].alias("scale"), F.col("world")[12].alias("x"), F.col("world")[14].alias("z"))


@R.query(f"SELECT tile_id, concat('r', n_regionkey, '/', n_nationkey) AS ancestor, 1::bigint AS distance, n_regionkey = 1 AND n_nationkey < 10 AS below FROM {CUSTOMERS} UNION ALL SELECT tile_id, concat('r', n_regionkey), 2, n_regionkey = 1 FROM {CUSTOMERS}")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proper ancestor, and whether it is region 1 or one of its one-digit nations."""
    rows = H.ancestors(_customers(spark, sf_dir).select("tile_id"))
    below = (F.col("ancestor") == "r1") | (H.is_descendant(F.col("ancestor"), F.lit("r1")) & (F.length("ancestor") == 4))
    return rows.select("tile_id", "ancestor", long("distance").alias("distance"), below.alias("below"))


TILES = f"(SELECT DISTINCT l AS level, (o_custkey % 32) >> ({DEPTH} - l) AS x, ((o_orderkey // 4) % 32) >> ({DEPTH} - l) AS y FROM orders, (SELECT unnest(range({DEPTH + 1}))::bigint AS l))"


@R.query(f"""WITH t AS {TILES}, g AS (SELECT * FROM t WHERE level = 2 AND (x + y) % 3 = 0)
SELECT NULL AS context, level, x, y FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE t.level >= g.level AND t.x >> (t.level - g.level) = g.x AND t.y >> (t.level - g.level) = g.y)
UNION ALL SELECT concat('graft/', g.level, '/', g.x, '/', g.y), l, ox, oy FROM g, (SELECT l, unnest(range(1 << l)) AS ox, k AS oy FROM (SELECT l, unnest(range(1 << l)) AS k FROM (SELECT unnest(range(3)) AS l)))""")
def grafted_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders grid with other quadtrees of three levels in place of a third of its tiles of level 2."""
    tiles = _grid(spark, sf_dir).select("level", "x", "y")
    made = H.grafted(tiles, tiles.where("level = 2 AND (x + y) % 3 = 0"), 3)
    return made.select("context", long("level").alias("level"), "x", "y")


@R.query(f"""WITH t AS {TILES} SELECT level, x, y, i AS content_index, concat('c', i, '/', level, '/', x, '/', y) AS uri FROM t, (SELECT unnest([0, 1])::bigint AS i) WHERE i = 0""")
def implicit_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of implicit tiles by their bitstreams: of two templates one has availability."""
    tiles = _grid(spark, sf_dir).select(long("level").alias("level"), "x", "y")
    subtrees = subtrees_of(tiles, 2)
    up = F.col("level") % 2
    rooted = tiles.select("level", "x", "y", (F.col("level") - up).cast("int").alias("root_level"), F.shiftright("x", 1).alias("hx"), F.shiftright("y", 1).alias("hy"), up.alias("up"))
    rooted = rooted.select("level", "x", "y", "root_level", F.when(F.col("up") == 1, F.col("hx")).otherwise(F.col("x")).alias("root_x"), F.when(F.col("up") == 1, F.col("hy")).otherwise(F.col("y")).alias("root_y"))
    made = H.implicit_contents(rooted, subtrees, ["c0/{level}/{x}/{y}", "c1/{level}/{x}/{y}"])
    return made.select("level", "x", "y", long("content_index").alias("content_index"), "uri")


@R.query(f"WITH t AS {TILES}, n AS (SELECT DISTINCT level // 2 * 2 AS level, x >> (level % 2) AS x, y >> (level % 2) AS y FROM t) SELECT * FROM n WHERE (x + 2 * y + level) % 3 > 0 AND (x + y) % 4 > 0")
def missing_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees that tiles need and that are neither loaded nor tried too often."""
    tiles = _grid(spark, sf_dir).select(long("level").alias("level"), "x", "y")
    up = F.col("level") % 2
    half = lambda c: F.when(up == 1, F.shiftright(c, 1)).otherwise(F.col(c))
    needed = tiles.select((F.col("level") - up).alias("root_level"), half("x").alias("root_x"), half("y").alias("root_y"))
    roots = needed.selectExpr("root_level AS level", "root_x AS x", "root_y AS y").distinct()
    return H.missing_subtrees(needed, roots.where("(x + 2 * y + level) % 3 = 0"), roots.withColumn("attempts", F.when(F.expr("(x + y) % 4 = 0"), 3).otherwise(2)))


@R.query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1.5::double ELSE c_acctbal END AS error, CASE WHEN c_custkey % 6 = 0 THEN 'own' ELSE c_mktsegment END AS kind, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS extra FROM customer")
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounding file says of a tile wins over what follows from the root, member by member."""
    c = table(spark, sf_dir, "customer")
    says = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, 1.5).alias("error"), F.when(F.col("c_custkey") % 6 == 0, "own").alias("kind"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("extra"))
    return H.overridden(c.select("c_custkey", F.col("c_acctbal").alias("error"), F.col("c_mktsegment").alias("kind")), says, ["c_custkey"]).select("c_custkey", "error", "kind", "extra")


@R.query(f"""WITH c AS {SHARP_SQL}, u AS (SELECT n.lod, n.x, n.y, n.edge, max(a.lod) AS a FROM (SELECT *, 0 AS edge, x AS nx, y - 1 AS ny FROM c UNION ALL SELECT *, 1, x - 1, y FROM c UNION ALL SELECT *, 2, x + 1, y FROM c UNION ALL SELECT *, 3, x, y + 1 FROM c) n
  JOIN c a ON n.nx >= 0 AND n.ny >= 0 AND n.nx < (1 << n.lod) AND n.ny < (1 << n.lod) AND a.lod <= n.lod - 2 AND a.x = n.nx >> (n.lod - a.lod) AND a.y = n.ny >> (n.lod - a.lod) GROUP BY ALL),
i AS (SELECT lod, x, y, min(a) AS coarse FROM u GROUP BY ALL), p AS (SELECT i.lod, i.x, i.y, coarse + d AS hl, i.x >> (i.lod - coarse - d) AS hx, i.y >> (i.lod - coarse - d) AS hy FROM i, (SELECT unnest([0, 1]) AS d)),
b AS (SELECT lod, x, y, max(hl) AS hl FROM p WHERE (hx + hy) % 3 > 0 GROUP BY ALL)
SELECT DISTINCT p.hl AS lod, hx AS x, hy AS y FROM p JOIN b USING (lod, x, y, hl) WHERE hx % 5 <> 1""")
def held_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors that hold so that a tile does not stand beside one two or more levels coarser; some are not ready, some were refined before."""
    cut = _sharp_cut(spark, sf_dir)
    grid = _grid(spark, sf_dir).select(F.lit("").alias("ns"), long("level").alias("lod"), "x", "y")
    return Q.held_refinements(Q.imbalances(cut), grid.withColumn("ready", F.expr("(x + y) % 3 > 0")), grid.where("x % 5 = 1")).select("lod", "x", "y")


# metadata --------------------------------------------------------------------------------------------------------


@R.query(f"""WITH t AS {CUSTOMERS}, s AS (
  SELECT tile_id, 0 AS p, 0 AS a, 'tileset' AS scope, concat('d', n_regionkey) AS owner FROM t UNION ALL SELECT tile_id, 2, -2, 'ancestor-tile', concat('r', n_regionkey) FROM t WHERE n_regionkey % 2 = 0
  UNION ALL SELECT tile_id, 2, -1, 'ancestor-tile', concat('r', n_regionkey, '/', n_nationkey) FROM t UNION ALL SELECT tile_id, 3, 0, 'tile', tile_id FROM t WHERE c_custkey % 3 = 0
  UNION ALL SELECT tile_id, 4, 0, 'group', concat('g', c_custkey % 4) FROM t WHERE c_custkey % 4 > 0 UNION ALL SELECT tile_id, 6, 0, 'feature', tile_id FROM t WHERE c_custkey % 5 = 0)
SELECT tile_id AS snapshot, row_number() OVER (PARTITION BY tile_id ORDER BY p, a) - 1 AS scope_ord, scope, owner FROM s""")
def metadata_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that apply to each customer's tile, from its tileset down to its features."""
    leaf = _customers(spark, sf_dir)
    none = F.lit(None).cast("string")
    tiles = leaf.select("tile_id", F.concat(F.lit("d"), "n_regionkey").alias("doc_id"), none.alias("subtree_id"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("g"), F.col("c_custkey") % 4)).alias("group_key"), none.alias("content_id"))
    said = lambda scope, owner, rows: rows.select(F.lit(scope).alias("scope"), owner.cast("string").alias("owner"), F.lit("s").alias("schema_id"), F.lit("c").alias("class")).distinct()
    region = F.concat(F.lit("r"), "n_regionkey")
    entities = said("tileset", F.concat(F.lit("d"), "n_regionkey"), leaf).unionAll(said("tile", region, leaf.where("n_regionkey % 2 = 0"))).unionAll(said("tile", F.concat(region, F.lit("/"), F.col("n_nationkey").cast("string")), leaf))
    entities = entities.unionAll(said("tile", F.col("tile_id"), leaf.where("c_custkey % 3 = 0"))).unionAll(said("group", F.concat(F.lit("g"), F.col("c_custkey") % 4), leaf)).unionAll(said("feature", F.col("tile_id"), leaf.where("c_custkey % 5 = 0")))
    return M.collect_scopes(tiles, entities).select("snapshot", long("scope_ord").alias("scope_ord"), "scope", "owner")


@R.query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'METADATA_SCHEMA_UNAVAILABLE' ELSE 'METADATA_CLASS_UNKNOWN' END AS code, CASE WHEN o_custkey % 5 = 0 THEN 'warning' ELSE 'error' END AS severity FROM orders WHERE o_custkey % 5 = 0 OR o_orderpriority NOT LIKE '1-%'")
def scope_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities whose schema is missing, or does not have their class."""
    scopes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot"), F.lit(0).alias("scope_ord"), (F.col("o_custkey") % 5).alias("schema_id"), F.substring("o_orderpriority", 1, 1).alias("class"))
    definitions = spark.range(1, 5).select(F.col("id").alias("schema_id"), F.lit("1").alias("class"))
    return M.scope_issues(scopes, definitions, definitions).select(F.col("snapshot").alias("o_orderkey"), "code", "severity")


@R.query("SELECT l_orderkey, l_linenumber::bigint AS content_index, 'METADATA_GROUP_OUT_OF_RANGE' AS code FROM lineitem WHERE l_linenumber % 2 = 0 AND l_suppkey % 7 >= l_orderkey % 4")
def group_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that name a group which their document does not have: an order has as many groups as its key modulo 4."""
    line = table(spark, sf_dir, "lineitem")
    named = line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("tile_id"), F.col("l_linenumber").alias("content_index"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 7).alias("group"))
    groups = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 4 - 1)).alias("group_index"))
    return M.group_issues(named, groups).select(F.col("doc_id").alias("l_orderkey"), long("content_index").alias("content_index"), "code")


@R.query("SELECT o_orderkey, o_orderstatus IN ('O', 'F') AS valid FROM orders")
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as values of an enum that knows two of them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).alias("v"))
    none = F.lit(None).cast("string")
    return rows.select("o_orderkey", M.value_valid(F.col("v"), F.lit("ENUM"), none, F.lit(False), F.lit(None).cast("int"), F.array(F.lit("O"), F.lit("F"))).alias("valid"))


# heights, sweeps, loads ------------------------------------------------------------------------------------------


@R.query("""WITH t AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_nationkey % 2 = 0 THEN c_nationkey - i END::double AS height_min, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 10 WHEN c_nationkey % 2 = 0 THEN c_nationkey + i END::double AS height_max FROM t""")
def refined_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of tiles measured by their own content, else told by their parent's."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    number = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    tiles = c.select(F.concat(F.lit("c"), "c_custkey").alias("tile_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), number.alias("ordinal"), "c_custkey")
    own = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("tile_id"), F.col("c_custkey").cast("double").alias("low"), (F.col("c_custkey") + 10).cast("double").alias("high"))
    above = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("tile_id"), F.col("n_nationkey").cast("double").alias("low"), F.col("n_nationkey").cast("double").alias("high"))
    told = lambda p, i: F.struct((p["low"] - i).alias("low"), (p["high"] + i).alias("high"))
    return refined_heights(tiles, own.unionAll(above), told).select("c_custkey", "height_min", "height_max")


@R.query("SELECT event_id, 1000 - event_id > 300 AS by_frames, value IS NULL OR 500 - value > 400 AS by_time FROM events")
def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not touched for more than 300 frames, or for more than 400 milliseconds."""
    now = (F.lit(1000), F.lit(500))
    frames = C.is_stale(F.col("event_id"), F.col("value"), *now, C.Budgets(frame_retention=300))
    return table(spark, sf_dir, "events").select("event_id", frames.alias("by_frames"), C.is_stale(F.col("event_id"), F.col("value"), *now, C.Budgets(retention_ms=400)).alias("by_time"))


@R.query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'idle' ELSE 'ready' END AS status, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 50 END AS cpu, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END::bigint AS attempts FROM events")
def evict_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents after a sweep that took the views."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("content_id"), F.lit("ready").alias("status"), (F.col("event_id") % 50).alias("cpu"), F.lit(2).alias("attempts"), "event_type")
    left = C.evict_effects(rows.drop("event_type"), rows.where("event_type = 'view'").select("user_id", "content_id"), key=["user_id"])
    return left.select(F.col("content_id").alias("event_id"), "status", long("cpu").alias("cpu"), long("attempts").alias("attempts"))


@R.query("SELECT user_id, count(*) AS entries, sum(event_id % 50)::bigint AS cpu, sum(CASE WHEN event_id % 3 > 0 THEN event_id % 7 ELSE 0 END)::bigint AS gpu FROM events WHERE event_type <> 'view' AND event_id % 4 > 0 GROUP BY 1")
def content_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", "metadata").otherwise("renderable").alias("kind"), F.when(k % 4 > 0, "ready").otherwise("queued").alias("status"), (k % 50).alias("cpu"), F.when(k % 3 > 0, k % 7).alias("gpu"))
    return C.content_totals(rows, key=["user_id"])


@R.query("SELECT user_id, event_type AS subtree_id, count(*) AS users, bool_or(event_id % 97 = 0) AS protected FROM events GROUP BY ALL")
def subtree_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("subtree_id"), F.col("event_id").alias("tile_id"), (F.col("event_id") % 97 == 0).alias("protected"))
    return C.subtree_users(rows, key=["user_id"])


@R.query("SELECT l_orderkey AS tile_id, count(*) FILTER (l_linenumber % 3 < 2) > 0 AS potential, count(*) FILTER (l_linenumber % 3 < 2) > 0 AND count(*) FILTER (l_linenumber % 3 < 2 AND NOT (l_linenumber % 3 = 0 AND l_returnflag = 'N' AND l_suppkey % 10 > 0)) = 0 AS ready FROM lineitem GROUP BY 1")
def presentation_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tiles, lines as contents: renderable, unknown or metadata; ready if not returned."""
    kind = F.element_at(F.array(F.lit("renderable"), F.lit("unknown"), F.lit("metadata")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tile_id"), kind.alias("kind"), F.when(F.col("l_returnflag") == "N", "ready").otherwise("failed").alias("status"), (F.col("l_suppkey") % 10 > 0).alias("has_handle"))
    return S.presentation_ready(rows)


@R.query("SELECT user_id, event_type AS resource, max(CASE WHEN event_id % 2 = 0 THEN value ELSE value * 0.25::double END) AS priority, min(event_id) AS ord FROM events GROUP BY ALL")
def follow_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that are asked for more than once follow the greatest priority; what is not seen counts a quarter."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("resource"), O.load_priority(F.col("event_id") % 2 == 0, F.col("value")).alias("priority"), F.col("event_id").alias("ord"))
    return O.follow_priority(rows, key=["user_id", "resource"])


@R.query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = e.event_type AND o.value > 150)")
def cancelled_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of users and types that no frame touches any more."""
    rows = table(spark, sf_dir, "events")
    return O.cancelled_outside(rows, rows.where("value > 150"), key=["user_id", "event_type"]).select("event_id")


@R.query("""WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'evicted' WHEN 'view' THEN 'cancelled' ELSE 'ready' END AS outcome, CASE WHEN event_id % 3 = 0 THEN 'subtree' ELSE 'content' END AS kind FROM events),
r AS (SELECT user_id, max(event_id) AS reset FROM l WHERE outcome = 'evicted' GROUP BY 1)
SELECT user_id, count(*) FILTER (NOT (kind = 'content' AND outcome = 'cancelled')) AS attempts, count(*) FILTER (NOT (kind = 'content' AND outcome = 'cancelled')) < 3 AS may_retry FROM l LEFT JOIN r USING (user_id) WHERE reset IS NULL OR event_id > reset GROUP BY user_id""")
def counted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts since the last eviction; contents that were cancelled are not counted."""
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failed").when(kind == "signup", "evicted").when(kind == "view", "cancelled").otherwise("ready")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), outcome.alias("outcome"), F.when(F.col("event_id") % 3 == 0, "subtree").otherwise("content").alias("kind"))
    return O.counted_attempts(rows, key=["user_id"])


@R.query("SELECT event_id AS key, CASE event_id % 3 WHEN 0 THEN 'content.load' WHEN 1 THEN 'hook.show' ELSE 'frame' END AS phase, event_id % 3 <> 1 AS for_hooks, unnest(CASE WHEN event_id % 3 = 0 THEN ['runtime.error', 'content.error'] ELSE ['runtime.error'] END) AS name FROM events WHERE event_type = 'error'")
def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(k.alias("key"), F.when(k % 3 == 0, "content.load").when(k % 3 == 1, "hook.show").otherwise("frame").alias("phase"), F.lit("m").alias("message"))
    return X.error_events(rows).select("key", "phase", "for_hooks", "name")


@R.query("SELECT event_id, 'frame.duration' AS name, (event_id % 9)::double AS value, 'millisecond' AS unit FROM events WHERE event_id % 4 > 0 AND event_type = 'view'")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of frames; a quarter never started."""
    k = F.col("event_id")
    spans = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.lit("frame.duration").alias("name"), F.when(k % 4 > 0, k).alias("started_ms"), (k + k % 9).alias("ended_ms"), F.create_map(F.lit("event"), k).alias("tags"))
    return X.durations(spans).select(F.col("tags")["event"].alias("event_id"), "name", "value", "unit")


@R.query("""WITH m AS (SELECT event_id, ['frame', 'frame.duration', 'cache.subtree.bytes', 'no.metric', 'tile.refine', 'content.load.network-bytes'][event_id % 6 + 1] AS name, value FROM events)
SELECT event_id, name, value, CASE event_id % 6 WHEN 1 THEN 'millisecond' WHEN 2 THEN 'byte' WHEN 5 THEN 'byte' ELSE 'count' END AS unit FROM m WHERE event_id % 6 <> 3""")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("frame", "frame.duration", "cache.subtree.bytes", "no.metric", "tile.refine", "content.load.network-bytes")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(name.alias("name"), "value", F.create_map(F.lit("event"), F.col("event_id")).alias("tags"))
    return X.telemetry(rows).select(F.col("tags")["event"].alias("event_id"), "name", "value", "unit")


@R.query(f"SELECT 'v' AS view, tile_id, CASE WHEN c_custkey % 3 = 0 THEN 'publish' ELSE 'revoke' END AS action, concat('label ', c_custkey) AS label FROM {CUSTOMERS} WHERE c_custkey % 3 < 2 AND c_custkey % 5 = 0")
def glyph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tiles that enter or leave a cut; some tiles have none."""
    leaf = _customers(spark, sf_dir)
    k = F.col("c_custkey") % 3
    changes = leaf.select(F.lit("v").alias("view"), "tile_id", F.when(k == 0, "enter").when(k == 1, "leave").otherwise("stay").alias("change"))
    return X.glyph_changes(changes, leaf.where("c_custkey % 5 = 0").select("tile_id", F.concat(F.lit("label "), "c_custkey").alias("label")))


@R.query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN concat('http://h/d/s', c_custkey % 4, '.json') END AS schema_uri, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 4 < 2 THEN concat('file', c_custkey % 4) END AS id,
  CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 >= 2 THEN 'METADATA_SCHEMA_LOAD_FAILED' END AS schema_issue FROM customer""")
def metadata_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a schema of their own or in a file; of four files one is broken and one is missing."""
    from tessella.sources import tilesets as T

    k = F.col("c_custkey")
    raw = F.when(k % 3 > 0, F.concat(F.lit('{"schemaUri":"./s'), k % 4, F.lit('.json"}'))).otherwise(F.lit('{"schema":{"id":"own"}}'))
    docs = T.parse_documents(table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit("http://h/d/").alias("base_uri"), raw.alias("raw")))
    files = spark.range(3).select(F.concat(F.lit("http://h/d/s"), "id", F.lit(".json")).alias("uri"), F.try_parse_json(F.when(F.col("id") < 2, F.concat(F.lit('{"id":"file'), "id", F.lit('"}'))).otherwise(F.lit("{"))).alias("v"))
    found = T.with_schemas(docs, files)
    return found.select(F.col("doc_id").alias("c_custkey"), "schema_uri", F.try_variant_get("schema", "$.id", "string").alias("id"), "schema_issue")


@R.query("""WITH n AS (SELECT concat('tile-', c_custkey) AS name, c_custkey AS k FROM customer), f AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS handle FROM n WHERE k % 3 > 0),
free AS (SELECT handle, row_number() OVER (ORDER BY handle) AS i FROM f WHERE k % 7 = 0), fresh AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM n WHERE k % 21 = 0 OR (k % 3 = 0 AND k % 2 = 0))
SELECT name, handle FROM f WHERE k % 7 > 0 UNION ALL SELECT name, coalesce(handle, (SELECT count(*) FROM f) + fresh.i - (SELECT count(*) FROM free) - 1) FROM fresh LEFT JOIN free USING (i) UNION ALL SELECT NULL, handle FROM free WHERE i > (SELECT count(*) FROM fresh)""")
def snapshot_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of snapshots that come, go and come: numbers without gaps that stay with their names."""
    k = F.col("c_custkey")
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("tile-"), k.cast("string")).alias("name"), k)
    first = N.with_names(None, names.where(k % 3 > 0))
    left = N.without_names(first, names.where(k % 7 == 0))
    return N.with_names(left, names.where((k % 21 == 0) | (k % 3 == 0) & (k % 2 == 0))).select("name", "handle")


QUERIES, ORACLES = R.queries, R.oracles
