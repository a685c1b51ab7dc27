import copy
import json

import pytest
from pyspark.sql import functions as F

from tessella.plans.validation import validate_extents, validate_tilesets
from tessella.sources import subtrees as B
from tessella.sources import tilesets as T

EXT = "VENDOR_bounding_volume_utm"
BOX = [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]
UTM = {"epsg": 26918, "minEasting": 4e5, "minNorthing": 5e6, "maxEasting": 4.01e5, "maxNorthing": 5.001e6, "vertical": {"reference": "ELLIPSOID", "direction": "UP", "minimum": 0, "maximum": 10}}


def tileset(**changes):
    doc = {"asset": {"version": "1.1"}, "geometricError": 10, "root": {"boundingVolume": {"box": BOX}, "geometricError": 0, "refine": "REPLACE", "content": {"uri": "content"}}}
    doc.update(changes)
    return doc


def root(**changes):
    doc = tileset()
    doc["root"].update(changes)
    doc["root"] = {k: v for k, v in doc["root"].items() if v is not None}
    return doc


def utm(declared=True, required=True, volume=None, drop=(), **changes):
    extent = copy.deepcopy(UTM)
    for k, v in changes.items():
        target, name = (extent["vertical"], k[2:]) if k.startswith("v_") else (extent, k)
        target[name] = v
    for k in drop:
        target, name = (extent["vertical"], k[2:]) if k.startswith("v_") else (extent, k)
        del target[name]
    doc = root(boundingVolume={**(volume or {}), "extensions": {EXT: extent}})
    if declared:
        doc["extensionsUsed"] = [EXT]
    if required:
        doc["extensionsRequired"] = [EXT]
    return doc


def raw_extent(value):
    doc = utm()
    doc["root"]["boundingVolume"]["extensions"][EXT] = value
    return doc


CASES = {
    "sound": (tileset(extras={"a": 1}, unknown=[1, 2]), set()),
    "content and contents": (root(contents=[{"uri": "b"}]), {"CONTENT_CARDINALITY"}),
    "required not used": (tileset(extensionsRequired=["X"], extensionsUsed=["Y"]), {"REQUIRED_EXTENSION_NOT_USED"}),
    "two volumes": (root(boundingVolume={"box": BOX, "sphere": [0, 0, 0, 1]}), {"BOUNDING_VOLUME_CARDINALITY"}),
    "no volume": (root(boundingVolume={}), {"BOUNDING_VOLUME_CARDINALITY"}),
    "volume missing": (root(boundingVolume=None), {"INVALID_BOUNDING_VOLUME"}),
    "not an object": ([1], {"INVALID_TILESET"}),
    "asset": (tileset(asset={"version": "", "tilesetVersion": 3}), {"INVALID_ASSET_VERSION", "INVALID_TILESET_VERSION"}),
    "no asset": (tileset(asset=None), {"INVALID_ASSET"}),
    "extensions": (tileset(extensions=[]), {"INVALID_EXTENSIONS"}),
    "error": (tileset(geometricError=-1), {"INVALID_NON_NEGATIVE_NUMBER"}),
    "error text": (root(geometricError="5"), {"INVALID_NON_NEGATIVE_NUMBER"}),
    "no root": ({"asset": {"version": "1.1"}, "geometricError": 1}, {"INVALID_TILE"}),
    "refine": (root(refine=None), {"MISSING_ROOT_REFINEMENT"}),
    "refine kind": (root(refine="MERGE"), {"INVALID_REFINEMENT"}),
    "transform": (root(transform=[1, 2]), {"INVALID_NUMBER_TUPLE"}),
    "box": (root(boundingVolume={"box": BOX[:-1] + ["1"]}), {"INVALID_NUMBER_TUPLE"}),
    "region": (root(boundingVolume={"region": [0, 1, 1, 0, 5, 4]}), {"INVALID_REGION_LATITUDE_ORDER", "INVALID_REGION_HEIGHT_ORDER"}),
    "sphere": (root(boundingVolume={"sphere": [0, 0, 0, -1]}), {"INVALID_SPHERE_RADIUS"}),
    "contents": (root(content=None, contents=[]), {"INVALID_CONTENTS"}),
    "content": (root(content={"uri": "", "group": -1, "metadata": {"class": "", "properties": 3}}), {"INVALID_CONTENT_URI", "INVALID_CONTENT_GROUP", "INVALID_METADATA_CLASS", "INVALID_METADATA_PROPERTIES"}),
    "content kind": (root(content="a"), {"INVALID_CONTENT"}),
    "children": (root(children=[]), {"INVALID_CHILDREN"}),
    "child": (root(children=[3, {"boundingVolume": {"box": BOX}, "geometricError": 0}]), {"INVALID_TILE"}),
    "metadata": (tileset(metadata=[]), {"INVALID_METADATA_ENTITY"}),
    "schemas": (tileset(schema=3, schemaUri=""), {"SCHEMA_CARDINALITY", "INVALID_SCHEMA", "INVALID_SCHEMA_URI"}),
    "groups": (tileset(groups=[]), {"INVALID_GROUPS"}),
    "string arrays": (tileset(extensionsUsed=[""], extensionsRequired=3), {"INVALID_STRING_ARRAY"}),
    "implicit": (
        root(boundingVolume={"sphere": [0, 0, 0, 1]}, metadata={"class": "a"}, children=[{"boundingVolume": {"box": BOX}, "geometricError": 0}], content={"uri": "{level}/{x}", "boundingVolume": {"box": BOX}}, implicitTiling={"subdivisionScheme": "QUADTREE", "subtreeLevels": 2, "availableLevels": 3, "subtrees": {"uri": "{level}/{x}/{y}"}}),
        {"IMPLICIT_CHILDREN_FORBIDDEN", "IMPLICIT_METADATA_FORBIDDEN", "IMPLICIT_SPHERE_FORBIDDEN", "IMPLICIT_CONTENT_BOUNDING_VOLUME_FORBIDDEN", "INVALID_IMPLICIT_TEMPLATE"},
    ),
    "octree template": (root(content={"uri": "{level}/{x}/{y}"}, implicitTiling={"subdivisionScheme": "OCTREE", "subtreeLevels": 1.5, "availableLevels": 0, "subtrees": {}}), {"INVALID_IMPLICIT_TEMPLATE", "INVALID_POSITIVE_INTEGER", "INVALID_SUBTREE_URI"}),
    "whole number": (root(content={"uri": "{level}/{x}/{y}"}, implicitTiling={"subdivisionScheme": "QUADTREE", "subtreeLevels": 2.0, "availableLevels": 3, "subtrees": {"uri": "{level}{x}{y}"}}), set()),
    "implicit kind": (root(implicitTiling=4, content={"uri": "{level}/{x}/{y}"}), {"INVALID_IMPLICIT_TILING"}),
    "utm": (utm(), set()),
    "utm beside a box": (utm(required=False, volume={"box": BOX}), set()),
    "utm not declared": (utm(declared=False, required=False), {"EXTENSION_NOT_DECLARED"}),
    "utm not required": (utm(required=False), {"BOUNDING_VOLUME_EXTENSION_NOT_REQUIRED"}),
    "utm kind": (raw_extent(7), {"INVALID_UTM_BOUNDING_VOLUME"}),
    "utm reference": (utm(drop=["epsg"]), {"UTM_REFERENCE_MISSING"}),
    "utm epsg": (utm(epsg=1.5), {"INVALID_UTM_EPSG"}),
    "utm zone": (utm(zone=61, hemisphere="N"), {"INVALID_UTM_ZONE"}),
    "utm hemisphere": (utm(zone=18, hemisphere="X"), {"INVALID_UTM_HEMISPHERE"}),
    "utm half": (utm(zone=18), {"INCOMPLETE_UTM_ZONE"}),
    "utm mismatch": (utm(zone=17, hemisphere="N"), {"UTM_EPSG_ZONE_MISMATCH"}),
    "utm unknown": (utm(epsg=4326), {"UTM_ZONE_REQUIRED"}),
    "utm unknown with zone": (utm(epsg=4326, zone=18, hemisphere="N"), set()),
    "utm zone alone": (utm(drop=["epsg"], zone=18, hemisphere="N"), {"UTM_EPSG_MISSING"}),
    "utm coordinate": (utm(minEasting=None), {"INVALID_UTM_COORDINATE"}),
    "utm order": (utm(minEasting=5e5), {"INVALID_UTM_EXTENT_ORDER"}),
    "utm easting": (utm(minEasting=0), {"UTM_EASTING_OUT_OF_RANGE"}),
    "utm northing": (utm(minNorthing=-1), {"UTM_NORTHING_OUT_OF_RANGE"}),
    "utm vertical": (utm(vertical=[]), {"INVALID_VERTICAL_EXTENT"}),
    "utm vertical parts": (utm(v_reference="SEA", v_direction="LEFT", v_minimum="0", v_epsg=0, v_groundElevation="a"), {"INVALID_VERTICAL_REFERENCE", "INVALID_VERTICAL_DIRECTION", "INVALID_VERTICAL_BOUND", "INVALID_VERTICAL_EPSG", "INVALID_GROUND_ELEVATION"}),
    "utm vertical order": (utm(v_minimum=11), {"INVALID_VERTICAL_ORDER"}),
    "utm ground": (utm(v_groundElevation=5), {"GROUND_ELEVATION_REFERENCE_MISMATCH"}),
    "utm ground missing": (utm(v_reference="GROUND"), {"GROUND_ELEVATION_MISSING"}),
    "utm depth": (utm(v_reference="GROUND", v_direction="DOWN", v_groundElevation=254.085), set()),
}


def test_every_rule(spark):
    docs = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in CASES.items()] + [("broken", "{"), ("twice", '{"asset": 1, ' + json.dumps(tileset())[1:])], "doc_id string, raw string")
    found = {}
    rows = validate_tilesets(docs).collect()
    for r in rows:
        found.setdefault(r["doc_id"], set()).add(r["code"])
    want = {k: codes for k, (_, codes) in CASES.items()} | {"broken": {"INVALID_JSON"}, "twice": set()}
    assert {k: found.get(k, set()) for k in want} == want
    first = [r for r in rows if r["doc_id"] == "content"]
    assert "/root/content/metadata/class" in {r["path"] for r in first}
    assert {r["severity"] for r in rows if r["code"] in ("UTM_EPSG_MISSING", "GROUND_ELEVATION_MISSING")} == {"warning"}


def test_extension_reported_once_at_its_first_use(spark):
    doc = root(boundingVolume={"extensions": {EXT: UTM}}, children=[{"boundingVolume": {"extensions": {EXT: UTM}}, "geometricError": 0}])
    rows = validate_tilesets(spark.createDataFrame([("a", json.dumps(doc))], "doc_id string, raw string")).collect()
    assert [(r["code"], r["path"]) for r in rows] == [("EXTENSION_NOT_DECLARED", f"/root/boundingVolume/extensions/{EXT}")]


def test_extent_alone(spark):
    rows = validate_extents(spark.createDataFrame([("a", json.dumps(UTM)), ("b", "[]")], "doc_id string, raw string")).collect()
    assert [(r["doc_id"], r["code"]) for r in rows] == [("b", "INVALID_UTM_BOUNDING_VOLUME")]


def test_flatten_contents_and_grafts(spark):
    tile = {"boundingVolume": {"box": BOX}, "geometricError": 1}
    doc = root(refine="ADD", children=[{**tile, "children": [tile, {**tile, "refine": "REPLACE", "contents": [{"uri": "x"}, {"uri": "y", "group": 1}]}]}, tile])
    docs = T.parse_documents(spark.createDataFrame([("d", "http://h/a/t.json", json.dumps(doc))], "doc_id string, uri string, raw string"))
    tiles = T.flatten(docs)
    got = {(r["tile_id"], r["parent_id"], r["depth"], r["refine"]) for r in tiles.collect()}
    assert got == {("d/root", None, 0, "ADD"), ("d/root/0", "d/root", 1, "ADD"), ("d/root/1", "d/root", 1, "ADD"), ("d/root/0/0", "d/root/0", 2, "ADD"), ("d/root/0/1", "d/root/0", 2, "REPLACE")}
    own = {(r["tile_id"], r["content_index"], r["uri"], r["group"]) for r in T.contents(tiles, F.lit("http://h/a/")).collect()}
    assert own == {("d/root", 0, "http://h/a/content", None), ("d/root/0/1", 0, "http://h/a/x", None), ("d/root/0/1", 1, "http://h/a/y", 1)}
    links = spark.createDataFrame([("d/root/0", 0, "http://h/a/t.json")], "parent_tile string, content_index int, uri string")
    both = {r["tile_id"]: r["parent_id"] for r in T.graft_external(tiles, docs.drop("doc_id"), links).collect()}
    assert len(both) == 10 and both["d/root/0/external-0"] == "d/root/0" and both["d/root/0/external-0/0/1"] == "d/root/0/external-0/0"
    typed = T.tile_columns(tiles).where("depth = 0").first()
    assert typed["box"] == BOX and typed["geometric_error"] == 0


def test_flattening_odd_documents(spark):
    tile = {"geometricError": 1}
    chain = dict(tile, refine="ADD", name='a "q" [x{ , \\', extras={"children": [{"root": 1}, [2]]})
    for i in range(30):
        chain = dict(tile, at=i, children=[dict(tile), chain, dict(tile, contents=[{"uri": "x, ]}"}])])
    docs = {"deep": {"asset": {"children": [{"z": 1}], "root": {"a": 1}}, "root": chain}, "odd": {"root": {"children": [1, {"a": 2, "children": []}, "s,]", [1, {"q": 2}], None], "x": 1}}, "five": {"root": 5}, "none": {}, "list": [1]}
    rows = [(k, json.dumps(v, indent=2 if k == "deep" else None)) for k, v in docs.items()]
    rows += [("twice", '{"root":{"no":1},"root":{"children":[{"a":1}],"refine":"ADD","\\u0063hildren" :\n[ {"b":2} , {"c":3,"children":[ ]}]}}'), ("bad", "{"), ("null", None)]
    got = {}
    for r in T.flatten(T.parse_documents(spark.createDataFrame(rows, "doc_id string, raw string"))).collect():
        assert r["tile_id"] == "/".join([r["doc_id"], "root", *map(str, r["order"])]) and r["path"] == "/root" + "".join(f"/children/{i}" for i in r["order"])
        assert (r["depth"], r["ordinal"]) == (len(r["order"]), r["order"][-1] if r["order"] else 0) and (r["parent_id"] is None) == (not r["order"])
        got[r["doc_id"], tuple(r["order"])] = (r["refine"], r["tile"] and r["tile"].toPython())
    want = {}

    def walk(doc, v, order, mode):
        mode = v.get("refine", mode) if isinstance(v, dict) else mode
        own = {k: [True] if k == "children" and x else x for k, x in v.items()} if isinstance(v, dict) else v
        want[doc, order] = (mode, own)
        for i, c in enumerate(v.get("children", ()) if isinstance(v, dict) else ()):
            walk(doc, c, (*order, i), mode)

    for k, v in docs.items():
        walk(k, v.get("root") if isinstance(v, dict) else None, (), "REPLACE")
    walk("twice", {"refine": "ADD", "children": [{"b": 2}, {"c": 3, "children": []}]}, (), "REPLACE")
    assert len(want) == 91 + 10 + 3 - 1 and got == want


def test_reading_and_writing_files(spark, tmp_path):
    text = json.dumps(tileset(), indent=1)
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "b.json").write_bytes(b"\xff{}")
    rows = {r["doc_id"][-6:]: r for r in T.read_tilesets(spark, str(tmp_path)).collect()}
    assert rows["a.json"]["error"] is None and rows["a.json"]["raw"] == text and rows["b.json"]["error"] == "INVALID_JSON"
    docs = spark.createDataFrame([("a", '{"b": 1.0, "a": [1e3, "ä"]}')], "doc_id string, raw string")
    assert docs.select(T.to_text(F.col("raw"))).first()[0] == '{"b":1,"a":[1000,"ä"]}'
    assert docs.select(T.to_text(F.col("raw"), 2)).first()[0].splitlines()[1] == '  "b": 1,'
    with pytest.raises(ValueError, match="INVALID_"):
        T.write_tilesets(docs, str(tmp_path / "out"))
    good = spark.createDataFrame([("a", json.dumps(tileset()))], "doc_id string, raw string")
    T.write_tilesets(good, str(tmp_path / "out2"))
    assert json.loads(spark.read.text(str(tmp_path / "out2")).first()[0]) == tileset()


def test_utm_tileset_is_sound(spark):
    extent = F.from_json(F.lit(json.dumps(UTM)), "epsg int, minEasting double, minNorthing double, maxEasting double, maxNorthing double, vertical struct<reference: string, direction: string, minimum: double, maximum: double>")
    docs = spark.range(1).select(F.lit("a").alias("doc_id"), T.utm_tileset(extent, extension=EXT, content_uri=F.lit('c"1')).alias("raw"))
    assert json.loads(docs.first()["raw"])["root"]["content"] == {"uri": 'c"1'} and validate_tilesets(docs).isEmpty()


def test_subtree_container(spark):
    text = '{"tileAvailability":{"bitstream":0},"childSubtreeAvailability":{"constant":0},"bufferViews":[{"buffer":0,"byteLength":1}],"buffers":[{"byteLength":1}]}'
    made = spark.range(1).select(B.encode_subtree(F.lit(text), F.unhex(F.lit("15"))).alias("content")).first()["content"]
    assert made[:4] == b"subt" and len(made) % 8 == 0 and made[-8:] == b"\x15" + b"\0" * 7
    rows = [("good", made), ("json", text.encode()), ("cut", made[:-1]), ("head", made[:20]), ("version", made[:4] + b"\2" + made[5:]), ("long", made[:8] + b"\xff" * 8 + made[16:]), ("array", b"[]"), ("broken", b"{"), ("bytes", b"\xff\xfe")]
    got = {r["uri"]: r for r in B.decode_subtrees(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "uri string, content binary")).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"good": None, "json": None, "cut": "CHUNKS_EXCEED_BYTES", "head": "TRUNCATED_HEADER", "version": "UNSUPPORTED_VERSION", "long": "LENGTH_NOT_SAFE", "array": "NOT_AN_OBJECT", "broken": "INVALID_JSON", "bytes": "INVALID_JSON"}
    assert got["good"]["chunk"] == b"\x15" + b"\0" * 7 and got["json"]["chunk"] is None


def test_loading_buffers(spark):
    text = '{"tileAvailability":{"bitstream":0},"contentAvailability":[{"bitstream":1}],"childSubtreeAvailability":{"constant":0},"bufferViews":[{"buffer":0,"byteLength":1},{"buffer":1,"byteLength":1}],"buffers":[{"byteLength":1},{"uri":"availability.bin","byteLength":%d}]}'
    made = {k: spark.range(1).select(B.encode_subtree(F.lit(text % n), F.unhex(F.lit("01"))).alias("c")).first()["c"] for k, n in (("f/a.subtree", 1), ("f/b.subtree", 9))}
    files = spark.createDataFrame([*made.items(), ("f/availability.bin", bytearray(b"\4\5")), ("g/c.subtree", made["f/a.subtree"])], "uri string, content binary")
    loaded = {r["uri"]: r for r in B.load_subtrees(B.decode_subtrees(files.where("uri LIKE '%.subtree'")).select("uri", "v", "chunk", "error"), files).collect()}
    assert [bytes(b) for b in loaded["f/a.subtree"]["subtree"]["buffers"]] == [b"\1", b"\4"] and loaded["f/a.subtree"]["error"] is None
    assert loaded["f/b.subtree"]["error"] == "BUFFER_TOO_SHORT" and loaded["g/c.subtree"]["error"] == "RESOURCE_NOT_FOUND"


def test_pyramid(spark):
    p = B.TilePyramid(0, 5, ["{z}/{x}/{y}.png"], {"region": [-3, -1, 3, 1, 0, 0]}, 100.0)
    docs = spark.createDataFrame([("p", p.tileset())], "doc_id string, raw string")
    assert validate_tilesets(docs).isEmpty()
    t = T.tile_columns(T.flatten(T.parse_documents(docs))).first()
    assert (t["available_levels"], t["subtree_levels"], t["scheme"]) == (6, 4, "QUADTREE")
    for wrong in (B.TilePyramid(1, 5, ["a"], {}, 1.0, root=(0, 0, 0)), B.TilePyramid(0, 1, [], {}, 1.0)):
        with pytest.raises(ValueError):
            wrong.tileset()
    with pytest.raises(ValueError):
        p.tileset(subtree_levels=0)
