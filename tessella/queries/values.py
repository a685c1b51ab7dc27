"""Geometry, projections and metadata values on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geodesy as G
from tessella.functions import implicit as I
from tessella.functions import spatial as S
from tessella.operators import boxes as X
from tessella.operators import metadata as M
from tessella.queries.common import Registry, long, table

R = Registry()


def _vec(first: int) -> S.Vec:
    return S.Vec(*(F.col("embedding")[first + i].cast("double") for i in range(3)))


def _e(i: int) -> str:
    return f"embedding[{i + 1}]::double"


_POINT = [f"{_e(r)} * {_e(16)} + {_e(4 + r)} * {_e(17)} + {_e(8 + r)} * {_e(18)} + {_e(12 + r)}" for r in range(3)]


@R.query(f"SELECT vec_id, {', '.join(f'{p} AS {n}' for p, n in zip(_POINT, 'xyz'))}, greatest({', '.join(f'sqrt({_e(4 * c)} * {_e(4 * c)} + {_e(4 * c + 1)} * {_e(4 * c + 1)} + {_e(4 * c + 2)} * {_e(4 * c + 2)})' for c in range(3))}) AS scale FROM embeddings")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [F.col("embedding")[i].cast("double") for i in range(16)]
    p = S.transform_point(m, _vec(16))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[a.alias(n) for a, n in zip(p, "xyz")], S.max_scale(m).alias("scale"))


_PTS = [[_e(3 * i + a) for i in range(6)] for a in range(3)]
_MID = [f"((least({', '.join(p)}) + greatest({', '.join(p)})) * 0.5::double)" for p in _PTS]


@R.query(f"SELECT vec_id, {', '.join(f'least({chr(44).join(p)}) AS min_{n}, greatest({chr(44).join(p)}) AS max_{n}' for p, n in zip(_PTS, 'xyz'))}, greatest({', '.join('sqrt(' + ' + '.join(f'({_PTS[a][i]} - {_MID[a]}) * ({_PTS[a][i]} - {_MID[a]})' for a in range(3)) + ')' for i in range(6))}) AS radius FROM embeddings")
def bounds_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.bounds_of_points(F.array(*[_vec(3 * i).struct() for i in range(6)]))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", b.alias("b"))
    return rows.select("vec_id", *[F.col(f"b.{e}.{n}").alias(f"{e}_{n}") for n in "xyz" for e in ("min", "max")], F.col("b.radius").alias("radius"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = zip(*[(F.least(F.col("embedding")[i], F.col("embedding")[3 + i]).cast("double"), F.greatest(F.col("embedding")[i], F.col("embedding")[3 + i]).cast("double")) for i in range(3)])
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", S.Vec(*low).struct().alias("low"), S.Vec(*high).struct().alias("high"))


_BOX_SQL = "SELECT vec_id, label, " + ", ".join(f"least({_e(i)}, {_e(3 + i)}) AS l{i}, greatest({_e(i)}, {_e(3 + i)}) AS h{i}" for i in range(3)) + " FROM embeddings"


_AHEAD = "vec_id / 64.0::double"


@R.query(f"WITH b AS (SELECT vec_id, l0 + {_AHEAD} AS l0, h0 + {_AHEAD} AS h0, l1, h1, l2, h2 FROM ({_BOX_SQL})) SELECT a.vec_id, c.vec_id AS camera FROM b a JOIN b c ON c.vec_id % 50 = 0 WHERE {' AND '.join(f'a.h{i} >= c.l{i} AND a.l{i} <= c.h{i}' for i in range(3))}")
def aabb_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes along a road that meet a camera's clip box; nothing else says which may."""
    ahead = F.col("vec_id") / 64.0
    moved = lambda c: F.struct((F.col(f"{c}.x") + ahead).alias("x"), f"{c}.y", f"{c}.z").alias(c)
    boxes = _boxes(spark, sf_dir).select("vec_id", moved("low"), moved("high"))
    return X.box_join(boxes, boxes.where("vec_id % 50 = 0")).select("left.vec_id", F.col("right.vec_id").alias("camera"))


PLANES = ((0.6, 0.8, 0.0, 0.05), (0.0, 0.6, 0.8, 0.15), (-0.8, 0.0, 0.6, 0.25))
_SPHERE = ([_e(i) for i in range(3)], f"abs({_e(3)})")
_BEHIND = " OR ".join(f"({p[0]}::double * {_e(0)} + {p[1]}::double * {_e(1)} + {p[2]}::double * {_e(2)} + {p[3]}::double < -abs({_e(3)}))" for p in PLANES)


def _spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", _vec(0).struct().alias("c"), F.abs(F.col("embedding")[3].cast("double")).alias("r"))


def _planes() -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, "xyzw")]) for p in PLANES])


@R.query(f"SELECT vec_id FROM embeddings WHERE NOT ({_BEHIND})")
def frustum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spheres(spark, sf_dir).where(~F.exists(_planes(), lambda p: S.outside_plane(S.Vec.of(F.col("c")), F.col("r"), p))).select("vec_id")


CAMERA, BALL = (0.3, 0.4, 1.2), 0.25
_FAR = f"sqrt({' + '.join(f'{v}::double * {v}::double' for v in CAMERA)})"
_BELOW = f"({_FAR} > {BALL}::double AND {' + '.join(f'{_e(i)} * {v}::double' for i, v in enumerate(CAMERA))} + abs({_e(3)}) * {_FAR} < {BALL}::double * {BALL}::double)"


@R.query(f"SELECT vec_id, {_BELOW} AS hidden FROM embeddings")
def horizon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spheres(spark, sf_dir).select("vec_id", S.below_horizon_plane(S.Vec.of(F.col("c")), F.col("r"), S.Vec.lit(*CAMERA), BALL).alias("hidden"))


@R.query(f"SELECT vec_id FROM embeddings WHERE NOT ({_BEHIND}) AND NOT {_BELOW} AND {' AND '.join(f'{_e(i)} + abs({_e(3)}) >= -0.2::double AND {_e(i)} - abs({_e(3)}) <= 0.2::double' for i in range(3))}")
def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip box, horizon and planes together."""
    centre, r = S.Vec.of(F.col("c")), F.col("r")
    reach = S.Vec(r, r, r)
    b = S.bounds(centre.minus(reach), centre.plus(reach), centre, r)
    camera = F.struct(S.Vec.lit(*CAMERA).struct().alias("position"), S.Vec.lit(-0.2, -0.2, -0.2).struct().alias("clip_min"), S.Vec.lit(0.2, 0.2, 0.2).struct().alias("clip_max"))
    return _spheres(spark, sf_dir).where(S.inside_view(b, camera, _planes(), BALL)).select("vec_id")


@R.query("""WITH c AS (SELECT c_custkey, c_acctbal / 100 AS error, (c_custkey % 97)::double AS x, (c_custkey % 89)::double AS y, (c_custkey % 83)::double AS z, (c_custkey % 11)::double AS r FROM customer)
SELECT c_custkey, CASE WHEN error <= 0 THEN 0 ELSE round(error / (2 * 0.5::double * greatest(sqrt((50 - x) * (50 - x) + (60 - y) * (60 - y) + (200 - z) * (200 - z)) - r, 2.220446049250313e-16) / 1000), 6) END AS sse FROM c""")
def screen_space_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    centre = S.Vec(*((F.col("c_custkey") % k).cast("double") for k in (97, 89, 83)))
    b = S.bounds(centre, centre, centre, (F.col("c_custkey") % 11).cast("double"))
    sse = S.screen_space_error(F.col("c_acctbal") / 100, b, S.Vec.lit(50, 60, 200), viewport=F.lit(1000.0), tan_half=F.lit(0.5))
    return c.select("c_custkey", F.round(sse, 6).alias("sse"))


@R.query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 2 * tan(pi() / 3 / 2) * c_acctbal / CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 4) * 500.0::double ELSE 1080 END END, 6) AS metres FROM customer")
def metres_per_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.metres_per_pixel(F.col("c_acctbal"), (F.col("c_custkey") % 4) * 500.0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.when(F.col("c_acctbal") > 0, m), 6).alias("metres"))


_LEVEL = "(1 + c_custkey % 5)"


@R.query(f"""WITH c AS (SELECT c_custkey, power(2.0::double, {_LEVEL}::double) AS s, (c_custkey % (1 << {_LEVEL}))::double AS x, ((c_custkey // 3) % (1 << {_LEVEL}))::double AS y, (c_nationkey - 12) / 8.0::double AS west, c_nationkey / 50.0::double - 0.3::double AS south FROM customer)
SELECT c_custkey, round(west + 1.5::double / s * x, 9) AS west, round(south + 0.25::double / s * y, 9) AS south, round(west + 1.5::double / s * x + 1.5::double / s, 9) AS east, round(south + 0.25::double / s * (y + 1), 9) AS north FROM c""")
def subdivide_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, side = long(F.col("c_custkey") % 5 + 1), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c_custkey") % 5 + 1).cast("int"))
    west, south = (F.col("c_nationkey") - 12) / 8.0, F.col("c_nationkey") / 50.0 - 0.3
    region = F.array(west, south, west + 1.5, south + 0.25, F.lit(0.0), F.lit(100.0))
    out = I.subdivide_region(region, level, F.col("c_custkey") % side, F.expr("c_custkey div 3") % side)
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("r")).select("c_custkey", *[F.round(F.col("r")[i], 9).alias(n) for i, n in enumerate(("west", "south", "east", "north"))])


@R.query(f"""WITH c AS (SELECT c_custkey, power(2.0::double, {_LEVEL}::double) AS s, (c_custkey % (1 << {_LEVEL}))::double AS x, ((c_custkey // 3) % (1 << {_LEVEL}))::double AS y, c_acctbal AS b, c_nationkey::double + 1 AS a FROM customer)
SELECT c_custkey, round(b + a * (-1 + (2 * x + 1) / s), 9) AS cx, round(b + 2 * a * (-1 + (2 * y + 1) / s), 9) AS cy, b AS cz, round(a / s, 9) AS ax, round(2 * a / s, 9) AS ay, 3 * a AS az FROM c""")
def subdivide_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, side = long(F.col("c_custkey") % 5 + 1), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c_custkey") % 5 + 1).cast("int"))
    b, a, zero = F.col("c_acctbal"), F.col("c_nationkey").cast("double") + 1, F.lit(0.0)
    box = F.array(b, b, b, a, zero, zero, zero, 2 * a, zero, zero, zero, 3 * a)
    out = I.subdivide_box(box, level, F.col("c_custkey") % side, F.expr("c_custkey div 3") % side)
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("r")).select("c_custkey", *[F.round(F.col("r")[i], 9).alias(n) for i, n in ((0, "cx"), (1, "cy"), (2, "cz"), (3, "ax"), (7, "ay"), (11, "az"))])


_EXTENT = "minEasting double, minNorthing double, maxEasting double, maxNorthing double, vertical struct<direction: string, minimum: double, maximum: double>"


@R.query("""WITH s AS (SELECT s_suppkey, 4.0::double AS s, s_suppkey % 4 AS x, (s_suppkey // 4) % 4 AS y, (s_suppkey // 2) % 4 AS z, 400000::double + s_nationkey * 100 AS e, 5000000::double + s_nationkey AS n, s_suppkey % 2 AS down FROM supplier)
SELECT s_suppkey, e + 1000 / s * x AS min_easting, n + 2000 / s * y AS min_northing, CASE WHEN down = 1 THEN 100 - 100 / s * z - 100 / s ELSE 100 / s * z END AS lowest, CASE WHEN down = 1 THEN 100 - 100 / s * z ELSE 100 / s * z + 100 / s END AS highest FROM s""")
def subdivide_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = 400000.0 + F.col("s_nationkey") * 100, 5000000.0 + F.col("s_nationkey")
    vertical = F.struct(F.when(F.col("s_suppkey") % 2 == 1, "DOWN").otherwise("UP").alias("direction"), F.lit(0.0).alias("minimum"), F.lit(100.0).alias("maximum"))
    extent = F.struct(e.alias("minEasting"), n.alias("minNorthing"), (e + 1000).alias("maxEasting"), (n + 2000).alias("maxNorthing"), vertical.alias("vertical"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", extent.alias("u"))
    out = I.subdivide_utm(F.col("u"), F.lit(2), F.col("s_suppkey") % 4, F.expr("s_suppkey div 4") % 4, F.expr("s_suppkey div 2") % 4)
    return rows.select("s_suppkey", out.alias("u")).select("s_suppkey", F.col("u.minEasting").alias("min_easting"), F.col("u.minNorthing").alias("min_northing"), F.col("u.vertical.minimum").alias("lowest"), F.col("u.vertical.maximum").alias("highest"))


_CSRS = " ".join(f"WHEN {k} THEN {v}" for k, v in G.CSRS_ZONES.items())
_CODE = "(CASE p_partkey % 5 WHEN 0 THEN 32595 + p_partkey % 75 WHEN 1 THEN 32695 + p_partkey % 75 WHEN 2 THEN 26895 + p_partkey % 35 WHEN 3 THEN 25825 + p_partkey % 20 ELSE 2950 + p_partkey % 220 END)"


@R.query(f"""WITH p AS (SELECT p_partkey, {_CODE} AS e FROM part), z AS (SELECT p_partkey, e, CASE e {_CSRS} END AS csrs FROM p), k AS (SELECT p_partkey, e,
  CASE WHEN e BETWEEN 32601 AND 32660 THEN e - 32600 WHEN e BETWEEN 32701 AND 32760 THEN e - 32700 WHEN e BETWEEN 26901 AND 26923 THEN e - 26900 WHEN e BETWEEN 25828 AND 25838 THEN e - 25800 ELSE csrs END AS zone,
  CASE WHEN e BETWEEN 32601 AND 32660 OR e BETWEEN 32701 AND 32760 THEN 'WGS 84' WHEN e BETWEEN 26901 AND 26923 THEN 'NAD83' WHEN e BETWEEN 25828 AND 25838 THEN 'ETRS89' WHEN csrs IS NOT NULL THEN 'NAD83(CSRS)' END AS datum FROM z)
SELECT p_partkey, coalesce(zone, CASE WHEN p_partkey % 3 = 0 THEN 17 END)::bigint AS zone, CASE WHEN zone IS NOT NULL THEN CASE WHEN e BETWEEN 32701 AND 32760 THEN 'S' ELSE 'N' END WHEN p_partkey % 3 = 0 THEN 'S' END AS hemisphere, datum FROM k""")
def utm_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.col("p_partkey") % 3 == 0
    extent = F.struct(F.expr(_CODE).cast("double").alias("epsg"), F.when(stated, 17).alias("zone"), F.when(stated, "S").alias("hemisphere"))
    rows = table(spark, sf_dir, "part").select("p_partkey", extent.alias("u"))
    return rows.select("p_partkey", G.utm_resolve(F.col("u")).alias("r")).select("p_partkey", long("r.zone").alias("zone"), "r.hemisphere", "r.datum")


_K = "CAST(json_extract(props, '$.k') AS double)"


@R.query(f"SELECT event_id, round(CASE WHEN {_K} = 50 THEN 42 ELSE {_K} END / 255 * 10 + 1, 9) AS value, ({_K} = 50) AS is_no_data FROM events")
def nodata_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props.k as an unsigned byte: 50 means no data and has the default 42; normalised, times ten, plus one."""
    raw = F.get_json_object("props", "$.k").cast("double")
    source = F.when(raw == 50, F.lit(42.0)).otherwise(raw)
    value = M.scaled(source, F.lit("UINT8"), F.lit(True), F.lit(10.0), F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(value, 9).alias("value"), (raw == 50).alias("is_no_data"))


@R.query("SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, round(greatest((l_quantity - 25) * 8 / 127, -1), 9) AS int8, round(l_quantity / 65535, 9) AS uint16, l_quantity AS float32 FROM lineitem")
def normalize_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), F.round(M.normalize((q - 25) * 8, F.lit("INT8")), 9).alias("int8"), F.round(M.normalize(q, F.lit("UINT16")), 9).alias("uint16"), M.normalize(q, F.lit("FLOAT32")).alias("float32"))


DEFINITIONS = """SELECT 'events' AS schema_id, * FROM VALUES
 ('view', 'k', 0, 'SCALAR', 'UINT8', true, '10', '1', '50', '42', true, 'RATE'),
 ('click', 'k', 0, 'SCALAR', 'UINT8', false, NULL, NULL, '7', NULL, true, 'RATE'),
 ('click', 'label', 1, 'STRING', NULL, false, NULL, NULL, NULL, '"none"', false, NULL),
 ('error', 'k', 0, 'SCALAR', 'INT8', true, NULL, NULL, NULL, NULL, false, 'RATE'),
 ('signup', 'level', 0, 'SCALAR', 'FLOAT32', false, NULL, NULL, NULL, NULL, true, NULL)
 AS t(class, property, prop_ord, type, component_type, normalized, scale, offset, no_data, default_value, required, semantic)"""


def _definitions(spark: SparkSession) -> DataFrame:
    rows = spark.sql(DEFINITIONS).withColumns({c: F.parse_json(c) for c in ("scale", "offset", "no_data", "default_value")})
    return rows.withColumns({"enum_type": F.lit(None).cast("string"), "is_array": F.lit(False), "count": F.lit(None).cast("int")})


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    scopes = events.select(F.col("event_id").alias("snapshot"), F.lit(0).alias("scope_ord"), F.lit("tile").alias("scope"), F.col("user_id").cast("string").alias("owner"), F.lit("events").alias("schema_id"), F.col("event_type").alias("class"))
    said = events.select(F.col("event_id").alias("snapshot"), F.lit(0).alias("scope_ord"), F.lit("k").alias("property"), F.lit(0).alias("ord"), F.try_variant_get(F.parse_json("props"), "$.k", "variant").alias("raw"))
    enums = spark.createDataFrame([], "schema_id string, enum string, name string")
    return M.resolve_metadata(scopes, said, F.broadcast(_definitions(spark)), enums)


@R.query(f"""WITH e AS (SELECT event_id, event_type AS c, {_K} AS k FROM events)
SELECT event_id, 'k' AS property, round(CASE c WHEN 'view' THEN CASE WHEN k = 50 THEN 42 ELSE k END / 255 * 10 + 1 WHEN 'click' THEN CASE WHEN k <> 7 THEN k END WHEN 'error' THEN greatest(k / 127, -1) END, 9) AS value,
  (c = 'view' AND k = 50) AS from_default, (c = 'view' AND k = 50) OR (c = 'click' AND k = 7) AS is_no_data, CASE WHEN c IN ('signup', 'purchase') THEN 'METADATA_PROPERTY_UNKNOWN' WHEN c = 'click' AND k = 7 THEN 'METADATA_PROPERTY_REQUIRED' END AS issue FROM e
UNION ALL SELECT event_id, 'label', NULL, true, false, NULL FROM e WHERE c = 'click'
UNION ALL SELECT event_id, 'level', NULL, false, false, 'METADATA_PROPERTY_REQUIRED' FROM e WHERE c = 'signup'""")
def metadata_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's props as a typed entity of its event type's class."""
    return _resolved(spark, sf_dir).select(F.col("snapshot").alias("event_id"), "property", F.round("number", 9).alias("value"), "from_default", "is_no_data", "issue")


@R.query("""WITH s AS (
  SELECT l_orderkey AS snapshot, 6 AS p, l_linenumber AS o, l_quantity AS v FROM lineitem WHERE l_linenumber > 2 AND l_returnflag = 'R'
  UNION ALL SELECT o_orderkey, 5, 0, o_totalprice FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 4, 0, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 > 0
  UNION ALL SELECT o_orderkey, 0, 0, 1.0::double FROM orders)
SELECT snapshot AS o_orderkey, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY p DESC, o DESC, v) AS n FROM s) WHERE n = 1""")
def find_by_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's value by meaning: its last returned line's, else the order's, else its customer's, else the tileset's."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    scope = lambda kind, key, ord_, value: [F.col(key).alias("snapshot"), F.lit(kind).alias("scope"), ord_.cast("long").alias("scope_ord"), F.lit("PRICE").alias("semantic"), value.alias("value")]
    rows = line.where("l_linenumber > 2 AND l_returnflag = 'R'").select(*scope("feature", "l_orderkey", F.col("l_linenumber"), F.col("l_quantity")))
    rows = rows.unionAll(orders.where("o_orderkey % 3 = 0").select(*scope("content", "o_orderkey", F.lit(0), F.col("o_totalprice"))))
    owned = orders.where("o_orderkey % 5 > 0").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.unionAll(owned.select(*scope("tile", "o_orderkey", F.lit(0), F.col("c_acctbal")))).unionAll(orders.select(*scope("tileset", "o_orderkey", F.lit(0), F.lit(1.0))))
    return M.find_by_semantic(rows.withColumn("prop_ord", F.col("value")), "PRICE").select(F.col("snapshot").alias("o_orderkey"), "value")


QUERIES, ORACLES = R.queries, R.oracles
