"""Quadtrees over gridded rows: addresses, cuts, neighbourhood, balance, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import implicit as I
from tessella.functions.tiles import address_of, quadtree_key
from tessella.operators import quadtree as Q
from tessella.operators.hierarchy import children_of
from tessella.operators.selection import cut_changes
from tessella.plans.lod import lod_cut as cut_of
from tessella.plans.lod import rolled_up
from tessella.queries.common import Registry, long, table

R = Registry()
DEPTH = 5
CAMERA, OTHER_CAMERA = (5.5, 9.25), (20.25, 12.5)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rolled_up(orders, F.col("o_custkey") % 32, F.expr("o_orderkey div 4") % 32, DEPTH)


def _cut(spark: SparkSession, sf_dir: str, camera=CAMERA, threshold: float = 16.0) -> DataFrame:
    return cut_of(_grid(spark, sf_dir), depth=DEPTH, camera=camera, threshold=threshold)


def _cut_sql(camera=CAMERA, threshold: float = 16.0) -> str:
    def refines(level: str, x: str, y: str) -> str:
        size = f"(32.0::double / power(2.0::double, ({level})::double))"
        gap = f"greatest(sqrt((({x} + 0.5::double) * {size} - {camera[0]}::double) * (({x} + 0.5::double) * {size} - {camera[0]}::double) + (({y} + 0.5::double) * {size} - {camera[1]}::double) * (({y} + 0.5::double) * {size} - {camera[1]}::double)) - {size} / 2::double, 0.5::double)"
        return f"(({level}) < 5 AND (64.0::double / power(2.0::double, ({level})::double) * 4.0::double / {gap}) > {threshold}::double)"

    above = " AND ".join(f"(t.level < {k} OR {refines(f't.level - {k}', f'(t.x >> {k})', f'(t.y >> {k})')})" for k in range(1, DEPTH + 1))
    return f"""SELECT t.level, t.x, t.y, t.n FROM (
      SELECT level, cx >> (5 - level) AS x, cy >> (5 - level) AS y, count(*) AS n
      FROM (SELECT o_custkey % 32 AS cx, (o_orderkey // 4) % 32 AS cy FROM orders) c, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS level) l GROUP BY ALL) t
    WHERE NOT {refines('t.level', 't.x', 't.y')} AND {above}"""


@R.query(f"SELECT CAST(level AS bigint) AS level, CAST(x AS bigint) AS x, CAST(y AS bigint) AS y, CAST(n AS bigint) AS n FROM ({_cut_sql()})")
def lod_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select(*[long(c).alias(c) for c in ("level", "x", "y", "n")])


MORTON = "+".join(f"(((x >> {i}) & 1) << {2 * i}) + (((y >> {i}) & 1) << {2 * i + 1})" for i in range(7))
MORTON_3 = "+".join(f"(((x >> {i}) & 1) << {3 * i}) + (((y >> {i}) & 1) << {3 * i + 1}) + (((z >> {i}) & 1) << {3 * i + 2})" for i in range(7))
COORDS_SQL = "(SELECT l_orderkey, l_linenumber::bigint AS level, l_partkey % (1 << l_linenumber) AS x, l_suppkey % (1 << l_linenumber) AS y, l_orderkey % (1 << l_linenumber) AS z FROM lineitem)"


def _coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", long("l_linenumber").alias("level"), (F.col("l_partkey") % side).alias("x"), (F.col("l_suppkey") % side).alias("y"), (F.col("l_orderkey") % side).alias("z"))


@R.query(f"SELECT level, x, y, {MORTON} AS morton, (power(4, level)::bigint - 1) // 3 AS level_offset, (power(4, level)::bigint - 1) // 3 + {MORTON} AS availability_index, count(*) AS n FROM {COORDS_SQL} GROUP BY ALL")
def morton_quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, x, y = F.col("level"), F.col("x"), F.col("y")
    cells = _coords(spark, sf_dir).groupBy("level", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return cells.select("level", "x", "y", I.morton(level, x, y).alias("morton"), I.level_offset(level, 4).alias("level_offset"), I.availability_index(level, x, y).alias("availability_index"), "n")


@R.query(f"SELECT level, x, y, z, {MORTON_3} AS morton, (power(8, level)::bigint - 1) // 7 + {MORTON_3} AS availability_index, count(*) AS n FROM {COORDS_SQL} GROUP BY ALL")
def morton_octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, x, y, z = (F.col(c) for c in ("level", "x", "y", "z"))
    cells = _coords(spark, sf_dir).groupBy("level", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    return cells.select("level", "x", "y", "z", I.morton(level, x, y, z).alias("morton"), I.availability_index(level, x, y, z).alias("availability_index"), "n")


@R.query(f"SELECT DISTINCT level AS parent_level, x AS parent_x, y AS parent_y, c AS child, level + 1 AS level, x * 2 + (c & 1) AS x, y * 2 + (c >> 1) AS y FROM {COORDS_SQL}, (SELECT unnest([0, 1, 2, 3])::bigint AS c)")
def child_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = children_of(_coords(spark, sf_dir).select("level", "x", "y").distinct())
    return made.select("parent_level", "parent_x", "parent_y", long("child").alias("child"), "level", "x", "y")


@R.query(f"SELECT level, x, y, x - (x >> (level - level // 2)) * (1 << (level - level // 2)) AS local_x, y - (y >> (level - level // 2)) * (1 << (level - level // 2)) AS local_y, count(*) AS n FROM {COORDS_SQL} GROUP BY ALL")
def local_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _coords(spark, sf_dir).groupBy("level", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    root = F.expr("level div 2")
    local = [I.local_coordinate(F.col(c), F.col("level"), I.ancestor(F.col(c), F.col("level") - root), root).alias(f"local_{c}") for c in ("x", "y")]
    return cells.select("level", "x", "y", *local, "n")


@R.query(f"SELECT DISTINCT level, x, y, 3 + level AS lod, (1 << level) * 2 + x AS px, (1 << level) * 5 + ((1 << level) - 1 - y) AS py, concat('g:', 3 + level, '/', (1 << level) * 2 + x, '/', (1 << level) * 5 + ((1 << level) - 1 - y)) AS key FROM {COORDS_SQL}")
def address_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _coords(spark, sf_dir).select("level", "x", "y").distinct()
    lod, px, py = address_of(F.col("level"), F.col("x"), F.col("y"), F.lit(3).cast("long"), F.lit(2).cast("long"), F.lit(5).cast("long"))
    return cells.select("level", "x", "y", lod.alias("lod"), px.alias("px"), py.alias("py"), quadtree_key(F.lit("g:"), lod, px, py).alias("key"))


@R.query("SELECT p_partkey, concat('t/', p_size, '/', p_partkey % 64, '-', p_partkey % 64, '/', (p_partkey // 64) % 64, '/0.glb') AS uri FROM part")
def expand_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = I.expand_template(F.lit("t/{level}/{x}-{x}/{y}/{z}.glb"), F.col("p_size"), F.col("p_partkey") % 64, F.expr("p_partkey div 64") % 64)
    return table(spark, sf_dir, "part").select("p_partkey", uri.alias("uri"))


CUSTOMER_CELLS = "(SELECT DISTINCT '' AS ns, 3 + c_custkey % 3 AS lod, (c_custkey // 3) % (1 << (3 + c_custkey % 3)) AS x, (c_custkey // 7) % (1 << (3 + c_custkey % 3)) AS y FROM customer)"


def _customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = "shiftleft(1L, cast(3 + c_custkey % 3 AS int))"
    return table(spark, sf_dir, "customer").selectExpr("'' AS ns", "3 + c_custkey % 3 AS lod", f"(c_custkey div 3) % {side} AS x", f"(c_custkey div 7) % {side} AS y").distinct()


def _neighbors_sql(cells: str, steps) -> str:
    parts = [f"SELECT *, {i}::bigint AS edge, x + ({dx}) AS nx, y + ({dy}) AS ny FROM {cells}" for i, (dx, dy) in enumerate(steps)]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE nx >= 0 AND ny >= 0 AND nx < (1 << lod) AND ny < (1 << lod))"


@R.query(f"SELECT lod, x, y, edge, nx, ny FROM {_neighbors_sql(CUSTOMER_CELLS, Q.EDGES)}")
def edge_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.neighbors(_customer_cells(spark, sf_dir)).select("lod", "x", "y", long("edge").alias("edge"), "nx", "ny")


@R.query(f"WITH c AS {CUSTOMER_CELLS}, seen AS (SELECT lod, x, y FROM c WHERE (x * 7 + y) % 5 = 0), n AS {_neighbors_sql('c', [*Q.EDGES, *Q.CORNERS])} SELECT DISTINCT n.lod, n.x, n.y FROM n JOIN seen s ON s.lod <= n.lod AND s.x = n.nx >> (n.lod - s.lod) AND s.y = n.ny >> (n.lod - s.lod)")
def quadtree_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _customer_cells(spark, sf_dir)
    return Q.touching(cells, cells.where("(x * 7 + y) % 5 = 0")).select("lod", "x", "y")


SHARP = (5.5, 9.25)


def _sharp_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut that is not balanced."""
    return _cut(spark, sf_dir, SHARP, 30.0).select(F.lit("").alias("ns"), long("level").alias("lod"), "x", "y")


SHARP_SQL = f"(SELECT '' AS ns, level::bigint AS lod, x, y FROM ({_cut_sql(SHARP, 30.0)}))"


@R.query(f"WITH c AS {SHARP_SQL}, n AS {_neighbors_sql('c', Q.EDGES)}, e AS (SELECT n.lod, n.x, n.y, n.edge, max(a.lod) AS a FROM n JOIN c a ON a.lod <= n.lod - 2 AND a.x = n.nx >> (n.lod - a.lod) AND a.y = n.ny >> (n.lod - a.lod) GROUP BY ALL) SELECT lod, x, y, min(a) AS coarse_lod FROM e GROUP BY ALL")
def quadtree_imbalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.imbalances(_sharp_cut(spark, sf_dir)).select("lod", "x", "y", long("coarse_lod").alias("coarse_lod"))


EDGE_CAMERA = (0.5, 9.25)
FACES = ("+x", "-x", "+y", "-y", "+z", "-z")
# faces in space, in units of a 64th of a cell's side at the finest level: each tile is a flat box, each edge of it has a middle and ends
_FACE_CUT = f"(SELECT f.ns, level::bigint AS lod, CASE WHEN f.i % 2 = 0 THEN x ELSE y END AS x, CASE WHEN f.i % 2 = 0 THEN y ELSE x END AS y, f.axis, f.wall FROM ({_cut_sql(EDGE_CAMERA, 30.0)}) t, (VALUES {', '.join(f'({n!r}, {i}, {i // 2}, {64 - i % 2 * 64})' for i, n in enumerate(FACES))}) f(ns, i, axis, wall) WHERE f.i < 3 OR t.level > 2)"
_IN_SPACE = "[CASE k WHEN axis THEN [wall, wall] WHEN (axis + 1) % 3 THEN [x << (6 - lod), (x + 1) << (6 - lod)] ELSE [y << (6 - lod), (y + 1) << (6 - lod)] END FOR k IN [0, 1, 2]]"
_PLACES = "SELECT *, CASE WHEN axis = 0 THEN [wall, u, v] WHEN axis = 1 THEN [v, wall, u] ELSE [u, v, wall] END AS p FROM (SELECT b.*, m.edge, (x << (6 - lod)) + m.i * (1 << (5 - lod)) AS u, (y << (6 - lod)) + m.j * (1 << (5 - lod)) AS v FROM b, m)"
_FACE_SQL = f"c AS {_FACE_CUT}, b AS (SELECT ns, lod, x, y, axis, wall, {_IN_SPACE} AS box FROM c), m(edge, i, j) AS (VALUES (0, 1, 0), (1, 0, 1), (2, 2, 1), (3, 1, 2), (4, 0, 0), (5, 2, 0), (6, 0, 2), (7, 2, 2)), q AS ({_PLACES})"
_HOLDS = " AND ".join(f"q.p[{k}] BETWEEN a.box[{k}][1] AND a.box[{k}][2]" for k in (1, 2, 3))


def _face_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut on each face of a cube, fine at one edge; every other face has it turned over, three lack its coarse tiles."""
    cut = _cut(spark, sf_dir, EDGE_CAMERA, 30.0).withColumn("f", F.explode(F.array(*[F.struct(F.lit(n).alias("ns"), F.lit(i).alias("i")) for i, n in enumerate(FACES)])))
    turned = F.col("f.i") % 2 == 1
    cut = cut.where("f.i < 3 OR level > 2")
    return cut.select("f.ns", long("level").alias("lod"), long(F.when(turned, F.col("y")).otherwise(F.col("x"))).alias("x"), long(F.when(turned, F.col("x")).otherwise(F.col("y"))).alias("y"))


@R.query(f"WITH {_FACE_SQL}, e AS (SELECT q.ns, q.lod, q.x, q.y, q.edge, max(a.lod) AS a FROM q JOIN b a ON q.edge < 4 AND a.lod <= q.lod - 2 AND {_HOLDS} GROUP BY ALL) SELECT ns, lod, x, y, min(a) AS coarse_lod FROM e GROUP BY ALL")
def cube_imbalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles beside one two or more levels coarser, across the edges of a cube's faces too; the SQL looks for them in space."""
    return Q.imbalances(_face_cut(spark, sf_dir), seams=Q.cube_seams(spark)).select("ns", "lod", "x", "y", long("coarse_lod").alias("coarse_lod"))


@R.query(f"WITH {_FACE_SQL} SELECT DISTINCT q.ns, q.lod, q.x, q.y FROM q JOIN b a ON (a.x * 7 + a.y) % 5 = 0 AND a.lod <= q.lod AND {_HOLDS} AND (a.ns, a.lod, a.x, a.y) <> (q.ns, q.lod, q.x, q.y)")
def cube_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a cube's faces that touch one of some tiles at their level or coarser, by an edge or a corner; three faces meet at each corner of the cube."""
    cut = _face_cut(spark, sf_dir)
    return Q.touching(cut, cut.where("(x * 7 + y) % 5 = 0"), seams=Q.cube_seams(spark)).select("ns", "lod", "x", "y")


@R.query(f"WITH c AS {SHARP_SQL}, n AS {_neighbors_sql('c', Q.EDGES)} SELECT DISTINCT n.lod - k AS lod, n.nx >> k AS x, n.ny >> k AS y FROM n, (SELECT unnest([2, 3, 4, 5])::bigint AS k) WHERE k <= n.lod")
def balance_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.balance_refinements(_sharp_cut(spark, sf_dir)).select("lod", "x", "y")


# every tile that the closure of the balance rule over all finer tiles names is split; what remains of the cut's subtrees are leaves
BALANCED_SQL = f"""WITH RECURSIVE c AS {SHARP_SQL}, must(lod, x, y) AS (
  SELECT lod - 1, x >> 1, y >> 1 FROM c WHERE lod > 0
  UNION
  SELECT * FROM (
    SELECT m.lod - 1 AS lod, (m.x + d.dx) >> 1 AS x, (m.y + d.dy) >> 1 AS y FROM must m, (SELECT unnest([0, -1, 1, 0, 0]) AS dx, unnest([0, 0, 0, -1, 1]) AS dy) d
    WHERE m.lod > 0 AND m.x + d.dx >= 0 AND m.y + d.dy >= 0 AND m.x + d.dx < (1 << m.lod) AND m.y + d.dy < (1 << m.lod))
), root AS (SELECT lod, x, y FROM c), split AS (
  SELECT DISTINCT m.lod, m.x, m.y FROM must m JOIN root r ON m.lod >= r.lod AND m.x >> (m.lod - r.lod) = r.x AND m.y >> (m.lod - r.lod) = r.y
), leaves AS (
  SELECT s.lod + 1 AS lod, s.x * 2 + k.dx AS x, s.y * 2 + k.dy AS y FROM split s, (SELECT unnest([0, 1, 0, 1]) AS dx, unnest([0, 0, 1, 1]) AS dy) k
  UNION SELECT lod, x, y FROM root
) SELECT lod, x, y FROM leaves ANTI JOIN split USING (lod, x, y)"""


@R.query(BALANCED_SQL)
def balanced_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut, split until tiles that share an edge are one level apart at most."""
    return Q.refine_cut(_sharp_cut(spark, sf_dir))[0].select("lod", "x", "y")


@R.query(f"""WITH a AS ({_cut_sql(CAMERA)}), b AS ({_cut_sql(OTHER_CAMERA)})
SELECT concat(coalesce(a.level, b.level), '/', coalesce(a.x, b.x), '/', coalesce(a.y, b.y)) AS tile_id, CASE WHEN a.level IS NULL THEN 'enter' WHEN b.level IS NULL THEN 'leave' ELSE 'stay' END AS change
FROM a FULL JOIN b ON a.level = b.level AND a.x = b.x AND a.y = b.y""")
def cut_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c: _cut(spark, sf_dir, c).select(F.lit("v").alias("view"), F.concat_ws("/", "level", "x", "y").alias("tile_id"))
    return cut_changes(named(CAMERA), named(OTHER_CAMERA)).select("tile_id", "change")


BITS_SQL = "(SELECT DISTINCT o_custkey, o_orderkey % 64 AS bit FROM orders)"


@R.query(f"WITH b AS {BITS_SQL} SELECT o.o_orderkey, (o_orderkey // 64) % 64 AS probe, EXISTS (SELECT 1 FROM b WHERE b.o_custkey = o.o_custkey AND b.bit = (o.o_orderkey // 64) % 64) AS available FROM orders o")
def availability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of each customer's orders, eight bytes with the lowest bit first, and a look at a bit for each order."""
    orders = table(spark, sf_dir, "orders")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("o_orderkey") % 64).cast("int"))
    bits = orders.groupBy("o_custkey").agg(F.bit_or(one).alias("bits"))
    digits = F.lpad(F.hex("bits"), 16, "0")
    maps = bits.select("o_custkey", F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])).alias("map"))
    probe = F.expr("o_orderkey div 64") % 64
    return orders.join(maps, "o_custkey").select("o_orderkey", probe.alias("probe"), I.get_bit(F.col("map"), probe).alias("available"))


SPARSE = 8


@R.query(f"""WITH cells AS (SELECT DISTINCT o_custkey % {1 << SPARSE} AS cx, (o_orderkey // 4) % {1 << SPARSE} AS cy FROM orders), t AS (
  SELECT DISTINCT l AS level, cx >> ({SPARSE} - l) AS x, cy >> ({SPARSE} - l) AS y FROM cells, (SELECT unnest(range({SPARSE + 1}))::bigint AS l))
SELECT level, x, y, CASE WHEN level = 0 THEN 0 ELSE (x & 1) + 2 * (y & 1) END AS child, level // 3 * 3 AS root_level FROM t""")
def materialize_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a sparse implicit quadtree, from subtree bitstreams made of the occupied cells."""
    from tessella.operators.hierarchy import materialize

    tiles = rolled_up(table(spark, sf_dir, "orders"), F.col("o_custkey") % (1 << SPARSE), F.expr("o_orderkey div 4") % (1 << SPARSE), SPARSE).select(long("level").alias("level"), "x", "y")
    made = materialize(subtrees_of(tiles, 3), subtree_levels=3, available_levels=SPARSE + 1)
    return made.select(long("level").alias("level"), "x", "y", long("child").alias("child"), long("root_level").alias("root_level"))


def subtrees_of(tiles: DataFrame, subtree_levels: int) -> DataFrame:
    """(level, x, y, subtree): subtree rows with the bitstreams of the tiles (level, x, y) that there are."""
    root = F.expr(f"level div {subtree_levels}") * subtree_levels
    shift = F.col("level") - root
    local = [I.local_coordinate(F.col(c), F.col("level"), I.ancestor(F.col(c), shift), root) for c in ("x", "y")]
    inside = tiles.select(root.alias("root"), I.ancestor(F.col("x"), shift).alias("rx"), I.ancestor(F.col("y"), shift).alias("ry"), F.lit("tile").alias("kind"), I.availability_index(shift, *local).alias("bit"))
    tops = tiles.where((F.col("level") > 0) & (F.col("level") == root))
    above = [F.col("level") - subtree_levels, I.ancestor(F.col("x"), subtree_levels), I.ancestor(F.col("y"), subtree_levels)]
    mine = [I.local_coordinate(F.col(c), F.col("level"), a, above[0]) for c, a in zip(("x", "y"), above[1:])]
    child = tops.select(above[0].alias("root"), above[1].alias("rx"), above[2].alias("ry"), F.lit("child").alias("kind"), I.morton(F.lit(subtree_levels), *mine).alias("bit"))
    bits = inside.unionAll(child).groupBy("root", "rx", "ry").pivot("kind", ["tile", "child"]).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))))

    def stream(name: str):
        digits = F.lpad(F.hex(F.coalesce(name, F.lit(0))), 16, "0")
        return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))

    av = lambda i: F.struct(F.lit(None).cast("int").alias("constant"), F.lit(i).alias("bitstream"))
    view = lambda i: F.struct(F.lit(i).alias("buffer"), F.lit(0).cast("long").alias("byteOffset"), F.lit(8).cast("long").alias("byteLength"))
    subtree = F.struct(av(0).alias("tileAvailability"), F.array(av(0)).alias("contentAvailability"), av(1).alias("childSubtreeAvailability"), F.array(view(0), view(1)).alias("bufferViews"), F.array(stream("tile"), stream("child")).alias("buffers"))
    return bits.select(F.col("root").cast("int").alias("level"), F.col("rx").alias("x"), F.col("ry").alias("y"), subtree.alias("subtree"))


QUERIES, ORACLES = R.queries, R.oracles
