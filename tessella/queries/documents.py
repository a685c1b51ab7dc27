"""Documents made of the region, nation and customer tables: flattening, inheritance, extensions, URIs, subtree files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.uri import base_uri, resolve_uri
from tessella.plans import validation as V
from tessella.queries.common import Registry, long, table
from tessella.queries.grids import DEPTH, subtrees_of
from tessella.sources import subtrees as B
from tessella.sources import tilesets as T

R = Registry()
MODE = "CASE {k} % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'REPLACE' END"
BOX = [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tileset for the customers of each nation and thousand of keys, their hundreds its children, in the order of keys: no document grows with the table."""
    volume = F.struct(F.array(*[F.lit(float(v)) for v in BOX]).alias("box"))
    tile = lambda error, key, *more: F.struct(volume.alias("boundingVolume"), F.lit(error).alias("geometricError"), F.expr(MODE.format(k=key)).alias("refine"), *more)
    in_order = lambda key: F.transform(F.sort_array(F.collect_list(F.struct(key, "tile"))), lambda c: c["tile"]).alias("children")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 100").alias("g"), F.expr("c_custkey div 1000").alias("b"), "c_nationkey", tile(0.0, "c_custkey").alias("tile"))
    groups = rows.groupBy("c_nationkey", "b", "g").agg(in_order("c_custkey")).withColumn("tile", tile(10.0, "g", F.col("children")))
    tops = groups.groupBy("c_nationkey", "b").agg(in_order("g"))
    root = F.struct(volume.alias("boundingVolume"), F.lit(20.0).alias("geometricError"), F.lit("REPLACE").alias("refine"), F.col("children"))
    doc = F.struct(F.struct(F.lit("1.1").alias("version")).alias("asset"), F.lit(40.0).alias("geometricError"), root.alias("root"))
    return tops.select(F.concat(F.lit("n"), F.concat_ws("-", "c_nationkey", "b")).alias("doc_id"), F.to_json(doc).alias("raw"))


TREE = """c AS (SELECT c_custkey, c_custkey // 100 AS g, concat('n', c_nationkey, '-', c_custkey // 1000) AS d, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 100 ORDER BY c_custkey) - 1 AS j FROM customer),
n AS (SELECT d, g, row_number() OVER (PARTITION BY d ORDER BY g) - 1 AS i FROM (SELECT DISTINCT d, g FROM c))"""
GROUP_MODE = "coalesce(CASE g % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'REPLACE' END, 'REPLACE')"


@R.query(f"""WITH {TREE}
SELECT DISTINCT concat(d, '/root') AS tile_id, NULL AS parent_id, 0::bigint AS depth, 0::bigint AS ordinal FROM n
UNION ALL SELECT concat(d, '/root/', i), concat(d, '/root'), 1, i FROM n
UNION ALL SELECT concat(d, '/root/', i, '/', j), concat(d, '/root/', i), 2, j FROM n JOIN c USING (d, g)""")
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.flatten(T.parse_documents(_documents(spark, sf_dir))).select("tile_id", "parent_id", long("depth").alias("depth"), long("ordinal").alias("ordinal"))


@R.query(f"""WITH {TREE}
SELECT refine, depth, count(*)::bigint AS n FROM (
  SELECT DISTINCT 'REPLACE' AS refine, 0::bigint AS depth, d FROM n
  UNION ALL SELECT {GROUP_MODE}, 1, d FROM n
  UNION ALL SELECT coalesce({MODE.format(k='c_custkey')}, {GROUP_MODE}), 2, d FROM c) GROUP BY ALL""")
def effective_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = T.flatten(T.parse_documents(_documents(spark, sf_dir)))
    return tiles.groupBy("refine", long("depth").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


_CHAIN_MODE = "CASE WHEN c_custkey % 5 = 0 THEN 'ADD' WHEN c_custkey % 7 = 0 THEN 'REPLACE' END"


@R.query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey // 31 AS g, {_CHAIN_MODE} AS mode FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS depth, count(*) OVER (PARTITION BY g) AS n FROM c)
SELECT concat(g, '/root', repeat('/0', depth::int)) AS tile_id, CASE WHEN depth > 0 THEN concat(g, '/root', repeat('/0', depth::int - 1)) END AS parent_id, depth,
  coalesce(last_value(mode IGNORE NULLS) OVER (PARTITION BY g ORDER BY k), 'REPLACE') AS refine,
  concat('{{', CASE WHEN depth + 1 < n THEN '"children":[true],' ELSE '' END, '"extras":{{"note":"a \\"[}}{{"}},"key":', k, CASE WHEN mode IS NULL THEN '' ELSE concat(',"refine":"', mode, '"') END, '}}') AS own FROM n""")
def deep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to 31 customers, each the child of the one before: tiles with their own members alone."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 31").alias("g"), F.expr(_CHAIN_MODE).alias("mode"))
    mode = F.when(F.col("mode").isNull(), "").otherwise(F.concat(F.lit(',"refine":"'), "mode", F.lit('"')))
    head = F.concat(F.lit('{"key":'), F.col("c_custkey").cast("string"), mode, F.lit(',"extras":{"note":"a \\"[}{"}'))
    chains = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("c_custkey", head.alias("head")))).alias("c"))
    raw = F.concat(F.lit('{"asset":{"version":"1.1"},"root":'), F.array_join(F.transform("c", lambda x: x["head"]), ', "children" : ['), F.lit("}"), F.expr("repeat(']}', size(c) - 1)"), F.lit("}"))
    tiles = T.flatten(T.parse_documents(chains.select(F.col("g").cast("string").alias("doc_id"), raw.alias("raw"))))
    return tiles.select("tile_id", "parent_id", long("depth").alias("depth"), "refine", F.to_json("tile").alias("own"))


EXT = "ACME_bounding_volume_utm"
_VOLUME = "/root/boundingVolume"
_EXTENT = f"{_VOLUME}/extensions/{EXT}"
_IMPLICIT = {"subdivisionScheme": "QUADTREE", "subtreeLevels": 2, "availableLevels": 3, "subtrees": {"uri": "{level}/{x}/{y}.subtree"}}
_UTM = {"epsg": 32618, "minEasting": 4e5, "minNorthing": 4e6, "maxEasting": 4.1e5, "maxNorthing": 4.1e6, "vertical": {"reference": "ELLIPSOID", "direction": "UP", "minimum": 0, "maximum": 10}}
_GONE = object()
#: Each: members that are set in a sound document, then what is found there: a code, or (path, code); warnings begin with "?".
_BROKEN = (
    ({}, ()),
    ({"/asset": 5}, ("INVALID_ASSET",)),
    ({"/asset/extensions": []}, ("INVALID_EXTENSIONS",)),
    ({"/asset/version": ""}, ("INVALID_ASSET_VERSION",)),
    ({"/asset/tilesetVersion": 1}, ("INVALID_TILESET_VERSION",)),
    ({"/geometricError": -1}, ("INVALID_NON_NEGATIVE_NUMBER",)),
    ({"/schema": {}, "/schemaUri": "s.json"}, (("", "SCHEMA_CARDINALITY"),)),
    ({"/schema": 5}, ("INVALID_SCHEMA",)),
    ({"/schemaUri": ""}, ("INVALID_SCHEMA_URI",)),
    ({"/groups": []}, ("INVALID_GROUPS",)),
    ({"/extensionsUsed": []}, ("INVALID_STRING_ARRAY",)),
    ({"/extensionsRequired": ["A"]}, (("/extensionsRequired/0", "REQUIRED_EXTENSION_NOT_USED"),)),
    ({"/extensions": 1}, ("INVALID_EXTENSIONS",)),
    ({"/root": 5}, ("INVALID_TILE",)),
    ({"/root/geometricError": "x"}, ("INVALID_NON_NEGATIVE_NUMBER",)),
    ({"/root/refine": _GONE}, ("MISSING_ROOT_REFINEMENT",)),
    ({"/root/refine": "BOTH"}, ("INVALID_REFINEMENT",)),
    ({"/root/transform": [1]}, ("INVALID_NUMBER_TUPLE",)),
    ({"/root/contents": [{"uri": "a"}], "/root/content": {"uri": "b"}}, (("/root", "CONTENT_CARDINALITY"),)),
    ({"/root/contents": []}, ("INVALID_CONTENTS",)),
    ({"/root/children": []}, ("INVALID_CHILDREN",)),
    ({"/root/children": [{"boundingVolume": {"box": BOX}, "geometricError": -2, "refine": "X"}]}, (("/root/children/0/geometricError", "INVALID_NON_NEGATIVE_NUMBER"), ("/root/children/0/refine", "INVALID_REFINEMENT"))),
    ({"/root/implicitTiling": _IMPLICIT, "/root/metadata": {"class": "c"}}, (("/root/metadata", "IMPLICIT_METADATA_FORBIDDEN"),)),
    ({"/root/implicitTiling": _IMPLICIT, "/root/children": [{"boundingVolume": {"box": BOX}, "geometricError": 0}]}, (("/root/children", "IMPLICIT_CHILDREN_FORBIDDEN"),)),
    ({"/root/implicitTiling": _IMPLICIT, _VOLUME: {"sphere": [0, 0, 0, 1]}}, ((f"{_VOLUME}/sphere", "IMPLICIT_SPHERE_FORBIDDEN"),)),
    ({"/root/implicitTiling": 5}, ("INVALID_IMPLICIT_TILING",)),
    ({"/root/implicitTiling": _IMPLICIT | {"subdivisionScheme": "X"}}, (("/root/implicitTiling/subdivisionScheme", "INVALID_SUBDIVISION_SCHEME"),)),
    ({"/root/implicitTiling": _IMPLICIT | {"subtreeLevels": 0}}, (("/root/implicitTiling/subtreeLevels", "INVALID_POSITIVE_INTEGER"),)),
    ({"/root/implicitTiling": _IMPLICIT | {"subtrees": {"uri": 5}}}, (("/root/implicitTiling/subtrees/uri", "INVALID_SUBTREE_URI"),)),
    ({"/root/implicitTiling": _IMPLICIT | {"subdivisionScheme": "OCTREE"}}, (("/root/implicitTiling/subtrees/uri", "INVALID_IMPLICIT_TEMPLATE"),)),
    ({"/root/implicitTiling": _IMPLICIT, "/root/content": {"uri": "{level}/{x}/{y}", "boundingVolume": {"box": BOX}}}, (("/root/content/boundingVolume", "IMPLICIT_CONTENT_BOUNDING_VOLUME_FORBIDDEN"),)),
    ({"/root/content": 5}, ("INVALID_CONTENT",)),
    ({"/root/content": {"uri": 5, "group": -1}}, (("/root/content/uri", "INVALID_CONTENT_URI"), ("/root/content/group", "INVALID_CONTENT_GROUP"))),
    ({"/metadata": 5}, ("INVALID_METADATA_ENTITY",)),
    ({"/root/metadata": {"class": "", "properties": 1}}, (("/root/metadata/class", "INVALID_METADATA_CLASS"), ("/root/metadata/properties", "INVALID_METADATA_PROPERTIES"))),
    ({_VOLUME: 5}, ("INVALID_BOUNDING_VOLUME",)),
    ({_VOLUME: {}}, ("BOUNDING_VOLUME_CARDINALITY",)),
    ({_VOLUME: {"box": [1, 2]}}, ((f"{_VOLUME}/box", "INVALID_NUMBER_TUPLE"),)),
    ({_VOLUME: {"region": [0, 1, 0, 0.5, 9, 3]}}, ((f"{_VOLUME}/region", "INVALID_REGION_LATITUDE_ORDER"), (f"{_VOLUME}/region", "INVALID_REGION_HEIGHT_ORDER"))),
    ({_VOLUME: {"sphere": [0, 0, 0, -1]}}, ((f"{_VOLUME}/sphere/3", "INVALID_SPHERE_RADIUS"),)),
    ({_EXTENT: _UTM, f"{_VOLUME}/box": _GONE, "/extensionsUsed": _GONE, "/extensionsRequired": _GONE}, ((_EXTENT, "EXTENSION_NOT_DECLARED"),)),
    ({_EXTENT: _UTM, f"{_VOLUME}/box": _GONE, "/extensionsUsed": [EXT], "/extensionsRequired": _GONE}, ((_EXTENT, "BOUNDING_VOLUME_EXTENSION_NOT_REQUIRED"),)),
    ({_EXTENT: 5}, ("INVALID_UTM_BOUNDING_VOLUME",)),
    ({f"{_EXTENT}/epsg": _GONE}, ((_EXTENT, "UTM_REFERENCE_MISSING"),)),
    ({f"{_EXTENT}/epsg": 0}, ("INVALID_UTM_EPSG",)),
    ({f"{_EXTENT}/zone": 61, f"{_EXTENT}/hemisphere": "N"}, ((f"{_EXTENT}/zone", "INVALID_UTM_ZONE"),)),
    ({f"{_EXTENT}/zone": 18, f"{_EXTENT}/hemisphere": "X"}, ((f"{_EXTENT}/hemisphere", "INVALID_UTM_HEMISPHERE"),)),
    ({f"{_EXTENT}/zone": 18}, ((_EXTENT, "INCOMPLETE_UTM_ZONE"),)),
    ({f"{_EXTENT}/zone": 17, f"{_EXTENT}/hemisphere": "N"}, ((_EXTENT, "UTM_EPSG_ZONE_MISMATCH"),)),
    ({f"{_EXTENT}/epsg": _GONE, f"{_EXTENT}/zone": 18, f"{_EXTENT}/hemisphere": "N"}, ((_EXTENT, "?UTM_EPSG_MISSING"),)),
    ({f"{_EXTENT}/epsg": 4326}, ((_EXTENT, "UTM_ZONE_REQUIRED"),)),
    ({f"{_EXTENT}/minEasting": "a"}, ("INVALID_UTM_COORDINATE",)),
    ({f"{_EXTENT}/minEasting": 5e5}, ("INVALID_UTM_EXTENT_ORDER",)),
    ({f"{_EXTENT}/minEasting": 0}, ((_EXTENT, "?UTM_EASTING_OUT_OF_RANGE"),)),
    ({f"{_EXTENT}/minNorthing": -1}, ((_EXTENT, "?UTM_NORTHING_OUT_OF_RANGE"),)),
    ({f"{_EXTENT}/vertical": 5}, ("INVALID_VERTICAL_EXTENT",)),
    ({f"{_EXTENT}/vertical/extensions": 5}, ("INVALID_EXTENSIONS",)),
    ({f"{_EXTENT}/vertical/reference": "SEA"}, ("INVALID_VERTICAL_REFERENCE",)),
    ({f"{_EXTENT}/vertical/reference": "GROUND"}, ((f"{_EXTENT}/vertical", "?GROUND_ELEVATION_MISSING"),)),
    ({f"{_EXTENT}/vertical/direction": "LEFT"}, ("INVALID_VERTICAL_DIRECTION",)),
    ({f"{_EXTENT}/vertical/minimum": "0"}, ("INVALID_VERTICAL_BOUND",)),
    ({f"{_EXTENT}/vertical/minimum": 11}, ((f"{_EXTENT}/vertical", "INVALID_VERTICAL_ORDER"),)),
    ({f"{_EXTENT}/vertical/epsg": 0}, ("INVALID_VERTICAL_EPSG",)),
    ({f"{_EXTENT}/vertical/groundElevation": "a"}, ("INVALID_GROUND_ELEVATION",)),
    ({f"{_EXTENT}/vertical/groundElevation": 5}, ("GROUND_ELEVATION_REFERENCE_MISMATCH",)),
)
#: Texts that are no tileset at all.
_NO_TILESETS = (("{", "INVALID_JSON"), ("[]", "INVALID_TILESET"))


def _broken_text(members: dict) -> str:
    doc = {"asset": {"version": "1.1"}, "geometricError": 10, "root": {"boundingVolume": {"box": BOX}, "geometricError": 0, "refine": "ADD"}}
    if any(m.startswith(_EXTENT) for m in members):
        doc |= {"extensionsUsed": [EXT], "extensionsRequired": [EXT]}
        doc["root"]["boundingVolume"] = {"extensions": {EXT: json.loads(json.dumps(_UTM))}}
    for path, value in members.items():
        *above, last = path.split("/")[1:]
        at = doc
        for name in above:
            at = at[name]
        if value is _GONE:
            at.pop(last, None)
        else:
            at[last] = json.loads(json.dumps(value))
    return json.dumps(doc)


def _findings() -> list[tuple[int, str, str, str]]:
    """(case, path, code, severity) of all cases."""
    rows = []
    for i, (members, found) in enumerate(_BROKEN):
        for f in found:
            path, code = f if isinstance(f, tuple) else (next(iter(members)), f)
            rows.append((i, path, code.lstrip("?"), "warning" if code[0] == "?" else "error"))
    return rows + [(len(_BROKEN) + i, "", code, "error") for i, (_, code) in enumerate(_NO_TILESETS)]


CASES = len(_BROKEN) + len(_NO_TILESETS)
_FOUND_SQL = ", ".join(f"({i}, '{path}', '{code}', '{severity}')" for i, path, code, severity in _findings())


@R.query(f"SELECT c_custkey::varchar AS doc_id, path, code, severity FROM customer JOIN (VALUES {_FOUND_SQL}) f(i, path, code, severity) ON c_custkey % {CASES} = i")
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structural rules: a document for each customer, broken in one of the ways above."""
    texts = F.array(*[F.lit(t) for t in [*(_broken_text(m) for m, _ in _BROKEN), *(t for t, _ in _NO_TILESETS)]])
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.element_at(texts, (F.col("c_custkey") % CASES + 1).cast("int")).alias("raw"))
    return V.validate_tilesets(docs).select("doc_id", "path", "code", "severity")


@R.query("""WITH u AS (SELECT DISTINCT p_type AS t, p_brand AS b FROM part WHERE p_size % 5 = 0), r AS (SELECT DISTINCT p_type AS t, p_brand AS b FROM part)
SELECT t AS doc_id, b AS extension FROM r ANTI JOIN u USING (t, b)""")
def required_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose required extensions (brands of a part type) are not all used (brands of some sizes)."""
    part = table(spark, sf_dir, "part")
    lists = part.groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("required"), F.sort_array(F.collect_set(F.when(F.col("p_size") % 5 == 0, F.col("p_brand")))).alias("used"))
    raw = F.to_json(F.struct(F.col("used").alias("extensionsUsed"), F.col("required").alias("extensionsRequired")))
    docs = T.parse_documents(lists.select(F.col("p_type").alias("doc_id"), raw.alias("raw"), "required")).select("doc_id", F.array().cast("array<int>").alias("order"), F.lit("").alias("path"), "v", "required")
    found = V.required_subset(docs).join(docs.select("doc_id", "required"), "doc_id")
    at = F.regexp_extract("path", r"(\d+)$", 1).cast("int")
    return found.select("doc_id", F.element_at("required", at + 1).alias("extension"))


_E = "CAST(json_extract(props, '$.k') AS bigint)"


@R.query(f"""WITH e AS (SELECT event_id, {_E} AS k, value AS v FROM events)
SELECT event_id, 'UTM_REFERENCE_MISSING' AS code FROM e WHERE k % 4 = 0
UNION ALL SELECT event_id, 'INVALID_UTM_EPSG' FROM e WHERE k % 4 = 1 AND k % 3 = 0
UNION ALL SELECT event_id, 'INVALID_UTM_ZONE' FROM e WHERE k % 4 = 2 AND k > 60
UNION ALL SELECT event_id, 'UTM_EPSG_MISSING' FROM e WHERE k % 4 = 2
UNION ALL SELECT event_id, 'INVALID_UTM_EXTENT_ORDER' FROM e WHERE v * 1000 > 100000
UNION ALL SELECT event_id, 'UTM_NORTHING_OUT_OF_RANGE' FROM e WHERE k < 20
UNION ALL SELECT event_id, 'INVALID_VERTICAL_ORDER' FROM e WHERE k > 50
UNION ALL SELECT event_id, 'INVALID_UTM_COORDINATE' FROM e WHERE false""")
def validate_extent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM extents made of events: codes or zones by props.k, corners by value."""
    k, v = F.get_json_object("props", "$.k").cast("long"), F.col("value")
    extent = F.struct(
        F.when(k % 4 == 1, F.when(k % 3 == 0, F.lit(0)).otherwise(F.lit(32617))).when(k % 4 == 3, F.lit(32618)).alias("epsg"),
        F.when(k % 4 == 2, F.greatest(k, F.lit(1))).alias("zone"),
        F.when(k % 4 == 2, "N").alias("hemisphere"),
        (v * 1000 + 1).alias("minEasting"),
        F.when(k < 20, F.lit(-1.0)).otherwise(F.lit(5e6)).alias("minNorthing"),
        F.lit(100001.0).alias("maxEasting"),
        F.lit(5.1e6).alias("maxNorthing"),
        F.struct(F.lit("ELLIPSOID").alias("reference"), F.lit("UP").alias("direction"), k.alias("minimum"), F.lit(50).alias("maximum")).alias("vertical"),
    )
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.to_json(extent).alias("raw"))
    return V.validate_extents(docs).select(F.col("doc_id").alias("event_id"), "code")


@R.query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS base FROM pages")
def uri_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", base_uri(F.col("url")).alias("base"))


@R.query("""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS base, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root FROM pages)
SELECT page_id, concat(base, 'tiles/', page_id, '.json') AS here, concat(root, '/root.json') AS top FROM b""")
def uri_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = F.concat(F.lit("./x/../tiles/"), F.col("page_id").cast("string"), F.lit(".json"))
    return table(spark, sf_dir, "pages").select("page_id", resolve_uri(here, F.col("url")).alias("here"), resolve_uri(F.lit("/a/../root.json"), F.col("url")).alias("top"))


@R.query("""WITH t AS (SELECT DISTINCT l AS level, (o_custkey % 32) >> (5 - l) AS x, ((o_orderkey // 4) % 32) >> (5 - l) AS y FROM orders, (SELECT unnest([0, 1, 2, 3, 4, 5])::bigint AS l))
SELECT DISTINCT concat('s/', level // 2 * 2, '/', x >> (level % 2), '/', y >> (level % 2)) AS uri, true AS same, NULL::varchar AS error FROM t""")
def subtree_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtree files of the orders grid: bitstreams packed into containers, taken apart and looked up again."""
    from tessella.plans.lod import rolled_up

    orders = table(spark, sf_dir, "orders")
    tiles = rolled_up(orders, F.col("o_custkey") % 32, F.expr("o_orderkey div 4") % 32, DEPTH).select(long("level").alias("level"), "x", "y")
    made = subtrees_of(tiles, 2)
    text = '{"tileAvailability":{"bitstream":0},"contentAvailability":[{"bitstream":0}],"childSubtreeAvailability":{"bitstream":1},"bufferViews":[{"buffer":0,"byteLength":8},{"buffer":0,"byteOffset":8,"byteLength":8}],"buffers":[{"byteLength":16}]}'
    uri = F.concat_ws("/", F.lit("s"), "level", "x", "y")
    files = made.select("level", "x", "y", uri.alias("uri"), B.encode_subtree(F.lit(text), F.concat(F.col("subtree.buffers")[0], F.col("subtree.buffers")[1])).alias("content"))
    loaded = B.load_subtrees(B.decode_subtrees(files).select("uri", "v", "chunk", "error"), spark.createDataFrame([], "uri string, content binary"))
    same = F.concat(*[F.col("made.subtree.buffers")[i] for i in (0, 1)]) == F.col("loaded.subtree.buffers")[0]
    return files.drop("content").join(loaded.alias("loaded"), "uri").join(made.alias("made"), ["level", "x", "y"]).select("uri", same.alias("same"), "error")


QUERIES, ORACLES = R.queries, R.oracles
