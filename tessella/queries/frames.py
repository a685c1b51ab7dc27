"""Selections over a tree made of the tables: regions, nations, customers, orders as tiles; each nation's camera as a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.implicit import ancestor
from tessella.operators import selection as S
from tessella.operators.balancing import select_balanced
from tessella.plans.lod import grid_error
from tessella.queries.common import Registry, long, table
from tessella.queries.grids import CAMERA, DEPTH, _grid

R = Registry()
RULES = S.Rules(max_error=16.0)


def tiles_of_orders(spark: SparkSession, sf_dir: str, views: int = 4) -> DataFrame:
    """(view, tile_id, ...): the occupied tiles of the orders grid with the state of some views, made of their addresses."""
    grid = _grid(spark, sf_dir)
    depths = F.when(F.col("level") > 0, F.sequence(F.lit(1), F.col("level"))).otherwise(F.array().cast("array<int>"))
    digit = lambda k: ancestor(F.col("x"), F.col("level") - k).bitwiseAND(F.lit(1)) + 2 * ancestor(F.col("y"), F.col("level") - k).bitwiseAND(F.lit(1))
    path = F.concat_ws("/", F.lit("g"), F.transform(depths, lambda k: digit(k).cast("string")))
    rows = grid.withColumn("tile_id", path).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    sse = grid_error(F.col("level"), F.col("x"), F.col("y"), depth=DEPTH, camera=CAMERA, error=64.0, pixels=4.0) * (1 + F.col("v") * 0.5)
    mark = F.pmod(F.col("x") * 7 + F.col("y") * 11 + F.col("level") * 3 + F.col("v") * 5, F.lit(16))
    return rows.select(
        F.concat(F.lit("v"), F.col("v").cast("string")).alias("view"), "tile_id", F.col("level").alias("depth"), F.when(mark == 3, "ADD").otherwise("REPLACE").alias("refine"), sse.alias("sse"),
        ((mark != 5) | (F.col("level") < 2)).alias("visible"), (mark == 5).alias("periphery"), (mark != 7).alias("potential"), ((mark != 7) & (mark != 9) & (mark != 11)).alias("ready"), (mark != 13).alias("subtree_ready"),
        (mark % 2 == 0).alias("was_refining"), ((F.col("level") == 3) & (mark < 8)).alias("selected_before"), F.lit("").alias("ns"), long("level").alias("lod"), "x", "y",
    )


def _tiles_sql(views: int = 4) -> str:
    """tiles_of_orders() and what is decided of a tile alone."""
    path = "".join(f", CASE WHEN level >= {k} THEN concat('/', ((x >> (level - {k})) & 1) + 2 * ((y >> (level - {k})) & 1)) ELSE '' END" for k in range(1, DEPTH + 1))
    size = "(32.0::double / power(2.0::double, level::double))"
    d = [f"(({a} + 0.5::double) * {size} - {c}::double)" for a, c in zip("xy", CAMERA)]
    gap = f"greatest(sqrt({d[0]} * {d[0]} + {d[1]} * {d[1]}) - {size} / 2::double, 0.5::double)"
    return f"""grid AS (SELECT DISTINCT l AS level, (o_custkey % 32) >> (5 - l) AS x, ((o_orderkey // 4) % 32) >> (5 - l) AS y FROM orders, (SELECT unnest([0, 1, 2, 3, 4, 5])::bigint AS l)),
m AS (SELECT *, (x * 7 + y * 11 + level * 3 + v * 5) % 16 AS mark FROM grid, (SELECT unnest(range({views})) AS v)),
t AS (SELECT concat('v', v) AS view, concat('g'{path}) AS tile_id, level AS depth, x, y, CASE WHEN mark = 3 THEN 'ADD' ELSE 'REPLACE' END AS refine,
  64.0::double / power(2.0::double, level::double) * 4.0::double / {gap} * (1 + v * 0.5::double) AS sse, mark <> 5 OR level < 2 AS visible, mark = 5 AS periphery, mark <> 7 AS potential, mark NOT IN (7, 9, 11) AS ready, mark <> 13 AS subtree_ready,
  mark % 2 = 0 AS was_refining, level = 3 AND mark < 8 AS selected_before FROM m)"""


def _selection_sql(base: bool) -> str:
    """The descent of a strategy as recursion: what is reached from the root, what is wrong told upward from child to parent."""
    active, missing, structural = "visible OR periphery", "visible AND (NOT subtree_ready OR (potential AND NOT ready))", "visible AND subtree_ready AND NOT potential"
    bare, keeps, barrier = "visible AND NOT has_children AND NOT selected_before", "active", "-1"
    wants = "subtree_ready AND (sse > CASE WHEN was_refining THEN 14.4 ELSE 16 END OR NOT potential) AND has_children"
    if base:
        active, missing, structural = "visible", "NOT subtree_ready OR (potential AND NOT ready)", "subtree_ready AND NOT potential"
        bare, keeps = f"{bare} AND NOT (subtree_ready AND NOT potential)", "visible AND k.ready"
        barrier = "coalesce((SELECT max(b.depth) FROM o b WHERE b.view = c.view AND starts_with(c.tile_id, concat(b.tile_id, '/')) AND b.refine = 'ADD'), -1)"
        node = "reached AND (NOT subtree_ready OR (NOT wants AND potential))"
        ladder = "CASE WHEN ready THEN 'self' WHEN up IS NOT NULL THEN 'up' ELSE 'none' END"
        choice = f"CASE WHEN gated THEN CASE WHEN covered THEN 'kept' WHEN can_retain THEN 'blocked' ELSE {ladder} END WHEN node THEN CASE WHEN covered AND NOT ready THEN 'kept' ELSE {ladder} END WHEN reached AND wants AND refine = 'ADD' AND ready THEN 'self' ELSE 'none' END"
        wants = f"visible AND {wants}"
    else:
        node = "reached AND subtree_ready AND NOT wants AND potential AND NOT ready"
        choice = """CASE WHEN NOT reached THEN 'none' WHEN NOT subtree_ready THEN 'self'
          WHEN node THEN CASE WHEN can_retain THEN 'kept' WHEN NOT visible THEN 'none' WHEN up IS NOT NULL THEN 'up' ELSE 'self' END
          WHEN NOT wants OR refine = 'ADD' THEN 'self' WHEN front_ok THEN 'none' WHEN ready THEN 'self' WHEN up IS NOT NULL THEN 'up' WHEN can_retain THEN 'kept' ELSE 'self' END"""
        wants = f"{wants} AND (visible OR active_child)"
    return f"""WITH RECURSIVE {_tiles_sql()},
a AS (SELECT *, regexp_extract(tile_id, '^(.*)/[^/]*$', 1) AS parent, {active} AS active FROM t),
d AS (SELECT a.*, c.view IS NOT NULL AS has_children, coalesce(c.some, false) AS active_child FROM a LEFT JOIN (SELECT view, parent AS tile_id, bool_or(active) AS some FROM a GROUP BY 1, 2) c USING (view, tile_id)),
shut(view, tile_id) AS (SELECT view, parent FROM d WHERE {missing} UNION SELECT d.view, d.parent FROM shut JOIN d USING (view, tile_id) WHERE {structural}),
open(view, tile_id) AS (SELECT view, parent FROM d WHERE {bare} UNION SELECT d.view, d.parent FROM open JOIN d USING (view, tile_id) WHERE NOT d.selected_before AND d.visible),
w AS (SELECT d.*, {wants} AS wants, shut.view IS NULL AS front_ok, open.view IS NULL AND has_children AS covered FROM d LEFT JOIN shut USING (view, tile_id) LEFT JOIN open USING (view, tile_id)),
way(view, tile_id) AS (SELECT view, tile_id FROM w WHERE parent = '' AND active UNION ALL SELECT k.view, k.tile_id FROM way JOIN w p USING (view, tile_id) JOIN w k ON k.view = p.view AND k.parent = p.tile_id WHERE p.wants AND (p.refine = 'ADD' OR p.front_ok) AND k.active),
r AS (SELECT w.*, way.view IS NOT NULL AS reached FROM w LEFT JOIN way USING (view, tile_id)),
o AS (SELECT *, {node} AS node, reached AND wants AND refine = 'REPLACE' AND NOT front_ok AS gated FROM r),
kept AS (SELECT k.view, c.tile_id AS of, k.tile_id FROM o k JOIN o c ON c.view = k.view AND starts_with(k.tile_id, concat(c.tile_id, '/')) WHERE k.selected_before AND k.{keeps}),
ups AS (SELECT c.view, c.tile_id, arg_max(u.tile_id, u.depth) AS up FROM o c JOIN o u ON u.view = c.view AND starts_with(c.tile_id, concat(u.tile_id, '/')) WHERE (c.node OR c.gated) AND u.ready AND u.depth > {barrier} GROUP BY 1, 2),
q AS (SELECT o.*, up, EXISTS (SELECT 1 FROM kept WHERE kept.view = o.view AND kept.of = o.tile_id) AS can_retain FROM o LEFT JOIN ups USING (view, tile_id)),
h AS (SELECT *, {choice} AS choice FROM q),
cut AS (SELECT view, tile_id FROM h WHERE choice = 'self' UNION SELECT kept.view, kept.tile_id FROM kept JOIN h ON h.view = kept.view AND h.tile_id = kept.of WHERE choice = 'kept' UNION SELECT view, up FROM h WHERE choice = 'up'),
s AS (SELECT h.*, cut.view IS NOT NULL AS selected FROM h LEFT JOIN cut USING (view, tile_id))"""


ACTIVE_SQL = _selection_sql(False)
BASE_SQL = f"""{_selection_sql(True)},
hidden AS (SELECT DISTINCT c.view, c.tile_id FROM s c JOIN s u ON u.view = c.view AND starts_with(c.tile_id, concat(u.tile_id, '/')) WHERE u.selected AND NOT EXISTS (
  SELECT 1 FROM s b WHERE b.view = c.view AND b.refine = 'ADD' AND starts_with(c.tile_id, concat(b.tile_id, '/')) AND b.depth >= u.depth)),
stuck AS (SELECT DISTINCT view FROM h WHERE choice = 'blocked')
SELECT view, tile_id, stuck.view IS NOT NULL AS blocked FROM s LEFT JOIN stuck USING (view) LEFT JOIN hidden USING (view, tile_id)
WHERE CASE WHEN stuck.view IS NOT NULL THEN selected_before AND ready ELSE selected AND hidden.view IS NULL END"""
LOADS_SQL = f"""{ACTIVE_SQL},
f AS (SELECT c.view, c.tile_id, c.subtree_ready, c.potential, c.ready, CASE WHEN c.visible THEN greatest(c.sse, 0) ELSE c.sse * 0.25::double END AS priority FROM s c JOIN s p ON p.view = c.view AND p.tile_id = c.parent WHERE p.reached AND p.wants AND p.refine = 'REPLACE'
  UNION ALL SELECT view, tile_id, subtree_ready, potential, ready, CASE WHEN visible THEN sse ELSE sse * 0.25::double END FROM s WHERE selected OR (reached AND potential AND NOT ready AND NOT wants))
SELECT view, tile_id, CASE WHEN subtree_ready THEN 'content' ELSE 'subtree' END AS kind, max(priority) AS priority FROM f WHERE NOT subtree_ready OR (potential AND NOT ready) GROUP BY ALL"""


@R.query(f"{ACTIVE_SQL} SELECT view, tile_id, wants AND reached AS refining FROM s WHERE selected")
def select_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_active(tiles_of_orders(spark, sf_dir), RULES).where("selected").select("view", "tile_id", "refining")


@R.query(BASE_SQL)
def select_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_base(tiles_of_orders(spark, sf_dir), RULES).where("selected").select("view", "tile_id", "blocked")


@R.query(LOADS_SQL)
def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.requests(S.select_active(tiles_of_orders(spark, sf_dir), RULES), RULES)


def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = tiles_of_orders(spark, sf_dir, 1).withColumns({"ready": F.lit(True), "potential": F.lit(True), "subtree_ready": F.lit(True), "visible": F.lit(True), "selected_before": F.lit(False)})
    return select_balanced(ready, S.Rules(max_error=30.0))[0].where("selected").select("view", "tile_id", "lod", "x", "y")


@R.query("""WITH c AS (SELECT l_orderkey AS tile_id, l_linenumber % 6 AS s FROM lineitem), n AS (SELECT tile_id, count(*) AS n, count(*) FILTER (s = 3) AS ready, count(*) FILTER (s = 2) AS preparing, count(*) FILTER (s = 1) AS queued, count(*) FILTER (s = 5) AS cancelled, count(*) FILTER (s = 4) AS failed FROM c GROUP BY 1)
SELECT tile_id, CASE WHEN ready = n THEN 'ready' WHEN preparing > 0 THEN 'preparing' WHEN queued > 0 THEN 'queued' WHEN cancelled = n THEN 'cancelled' WHEN failed + cancelled = n THEN 'failed' ELSE 'idle' END AS readiness FROM n""")
def readiness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*[F.lit(s) for s in ("idle", "queued", "preparing", "ready", "failed", "cancelled")]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return S.readiness_rollup(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tile_id"), states.alias("status")))


R.query()(balanced_selection)
QUERIES, ORACLES = R.queries, R.oracles
