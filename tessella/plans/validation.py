"""Structural validation of tileset documents as plans: a row for each finding.

Documents are taken apart into tiles, contents, volumes, metadata entities and extents.  Each of these has a list of
rules, each a code, a path and a predicate; all rules of a kind are evaluated in one projection.  Only what
concerns a whole document (declared extensions) needs a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geodesy import utm_from_epsg
from tessella.sources.tilesets import UTM_EXTENSION, contents, flatten, is_number, is_object, is_text, items, member, number, parse_documents
from tessella.storage import settled

# The grid's limits in metres.
EASTING_LIMIT, NORTHING_LIMIT = 1_000_000, 10_000_000

COLUMNS = ("doc_id", "order", "path", "code", "severity")


class Rule(NamedTuple):
    code: str
    suffix: str
    breaks: Column
    severity: str = "error"


class Members:
    """The members of a node as columns, each read once: what it is, its number, its text, its items.

    Every kind of column is a projection of its own above the one before; a rule then names columns and no rule reads
    the VARIANT again.
    """

    def __init__(self, nodes: DataFrame, node: str, *names: str) -> None:
        names = ("", "extensions", *names)
        self.at = {n: i for i, n in enumerate(names)}
        keep = [c for c in nodes.columns if c != node]
        out = nodes.select(*keep, *[(F.col(node) if not n else member(F.col(node), n)).alias(f"v{i}") for n, i in self.at.items()])
        out = out.select("*", *[F.schema_of_variant(f"v{i}").alias(f"k{i}") for i in self.at.values()])
        value = lambda i, kind: F.try_variant_get(F.col(f"v{i}"), "$", kind)
        numeric = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"
        out = out.select(
            "*",
            *[F.when(F.col(f"k{i}").rlike(numeric), value(i, "double")).alias(f"d{i}") for i in self.at.values()],
            *[F.when(F.col(f"k{i}") == "STRING", value(i, "string")).alias(f"t{i}") for i in self.at.values()],
            *[F.when(F.col(f"k{i}").startswith("ARRAY"), value(i, "array<variant>")).alias(f"a{i}") for i in self.at.values()],
        )
        self.rows = out.select("*", *[F.when((F.abs(f"d{i}") < float("inf")) & ~F.isnan(f"d{i}"), F.col(f"d{i}")).alias(f"n{i}") for i in self.at.values()])

    def has(self, name: str) -> Column:
        return F.col(f"v{self.at[name]}").isNotNull()

    def is_object(self, name: str = "") -> Column:
        return F.coalesce(F.col(f"k{self.at[name]}").startswith("OBJECT"), F.lit(False))

    def number(self, name: str) -> Column:
        """A finite number; null for anything else."""
        return F.col(f"n{self.at[name]}")

    def text(self, name: str) -> Column:
        return F.col(f"t{self.at[name]}")

    def items(self, name: str) -> Column:
        return F.col(f"a{self.at[name]}")

    def is_text(self, name: str) -> Column:
        return F.coalesce(self.text(name) != "", F.lit(False))

    def among(self, name: str, *values: str) -> Column:
        return F.coalesce(self.text(name).isin(*values), F.lit(False))

    def no_items(self, name: str) -> Column:
        return ~F.coalesce(F.size(self.items(name)) > 0, F.lit(False))

    def whole(self, name: str, least: int) -> Column:
        return F.coalesce((self.number(name) >= least) & (self.number(name) == F.floor(self.number(name))), F.lit(False))

    def negative(self, name: str) -> Column:
        return ~F.coalesce(self.number(name) >= 0, F.lit(False))

    def no_tuple(self, name: str, size: int) -> Column:
        return ~F.coalesce((F.size(self.items(name)) == size) & F.forall(self.items(name), lambda x: is_number(x)), F.lit(False))

    def item(self, name: str, i: int) -> Column:
        return number(F.try_element_at(self.items(name), F.lit(i + 1)))

    def findings(self, code: str, rules: Iterable[Rule]) -> DataFrame:
        """A row for each rule that a node breaks: the first is that it is an object; the others hold for objects alone."""
        mine = [Rule(code, "", ~self.is_object()), Rule("INVALID_EXTENSIONS", "/extensions", self.is_object() & self.has("extensions") & ~self.is_object("extensions"))]
        mine += [r._replace(breaks=self.is_object() & r.breaks) for r in rules]
        made = [F.when(F.coalesce(r.breaks, F.lit(False)), F.struct(F.concat("path", F.lit(r.suffix)).alias("path"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in mine]
        found = self.rows.select("doc_id", "order", F.array_compact(F.array(*made)).alias("found"))
        # outer, so that no filter with all rules in it is inferred and pushed below the projections that they share
        rows = found.select("doc_id", "order", F.explode_outer("found").alias("f")).where("f.code IS NOT NULL")
        return rows.select("doc_id", "order", "f.path", "f.code", "f.severity")


def tileset_findings(docs: DataFrame) -> DataFrame:
    m = Members(docs, "v", "asset", "asset.version", "asset.tilesetVersion", "asset.extensions", "geometricError", "schema", "schemaUri", "groups", "extensionsUsed", "extensionsRequired")
    asset = m.is_object("asset")
    texts = lambda n: ~m.no_items(n) & F.coalesce(F.forall(m.items(n), lambda x: is_text(x)), F.lit(False))
    return m.findings(
        "INVALID_TILESET",
        [
            Rule("INVALID_ASSET", "/asset", ~asset),
            Rule("INVALID_EXTENSIONS", "/asset/extensions", asset & m.has("asset.extensions") & ~m.is_object("asset.extensions")),
            Rule("INVALID_ASSET_VERSION", "/asset/version", asset & ~m.is_text("asset.version")),
            Rule("INVALID_TILESET_VERSION", "/asset/tilesetVersion", asset & m.has("asset.tilesetVersion") & m.text("asset.tilesetVersion").isNull()),
            Rule("INVALID_NON_NEGATIVE_NUMBER", "/geometricError", m.negative("geometricError")),
            Rule("SCHEMA_CARDINALITY", "", m.has("schema") & m.has("schemaUri")),
            Rule("INVALID_SCHEMA", "/schema", m.has("schema") & ~m.is_object("schema")),
            Rule("INVALID_SCHEMA_URI", "/schemaUri", m.has("schemaUri") & ~m.is_text("schemaUri")),
            Rule("INVALID_GROUPS", "/groups", m.has("groups") & m.no_items("groups")),
            *[Rule("INVALID_STRING_ARRAY", f"/{n}", m.has(n) & ~texts(n)) for n in ("extensionsUsed", "extensionsRequired")],
        ],
    )


def tile_findings(tiles: DataFrame) -> DataFrame:
    m = Members(tiles, "tile", "refine", "transform", "content", "contents", "children", "implicitTiling", "boundingVolume", "boundingVolume.sphere", "metadata", "geometricError")
    implicit = m.has("implicitTiling")
    return m.findings(
        "INVALID_TILE",
        [
            Rule("INVALID_NON_NEGATIVE_NUMBER", "/geometricError", m.negative("geometricError")),
            Rule("MISSING_ROOT_REFINEMENT", "/refine", (F.col("depth") == 0) & ~m.has("refine")),
            Rule("INVALID_REFINEMENT", "/refine", m.has("refine") & ~m.among("refine", "ADD", "REPLACE")),
            Rule("INVALID_NUMBER_TUPLE", "/transform", m.has("transform") & m.no_tuple("transform", 16)),
            Rule("CONTENT_CARDINALITY", "", m.has("content") & m.has("contents")),
            Rule("INVALID_CONTENTS", "/contents", m.has("contents") & m.no_items("contents")),
            Rule("INVALID_CHILDREN", "/children", m.has("children") & m.no_items("children")),
            Rule("IMPLICIT_CHILDREN_FORBIDDEN", "/children", implicit & m.has("children")),
            Rule("IMPLICIT_METADATA_FORBIDDEN", "/metadata", implicit & m.has("metadata")),
            Rule("IMPLICIT_SPHERE_FORBIDDEN", "/boundingVolume/sphere", implicit & m.is_object("boundingVolume") & m.has("boundingVolume.sphere")),
        ],
    )


def _template_gaps(uri: Column, octree: Column) -> list[Column]:
    """For each variable whether a template lacks it; what is no text lacks none."""
    gap = lambda k: F.coalesce(~uri.contains("{" + k + "}"), F.lit(False))
    return [*[gap(k) for k in ("level", "x", "y")], octree & gap("z")]


def implicit_findings(nodes: DataFrame) -> DataFrame:
    m = Members(nodes, "v", "subdivisionScheme", "subtreeLevels", "availableLevels", "subtrees.uri")
    return m.findings(
        "INVALID_IMPLICIT_TILING",
        [
            Rule("INVALID_SUBDIVISION_SCHEME", "/subdivisionScheme", ~m.among("subdivisionScheme", "QUADTREE", "OCTREE")),
            Rule("INVALID_POSITIVE_INTEGER", "/subtreeLevels", ~m.whole("subtreeLevels", 1)),
            Rule("INVALID_POSITIVE_INTEGER", "/availableLevels", ~m.whole("availableLevels", 1)),
            Rule("INVALID_SUBTREE_URI", "/subtrees/uri", ~m.is_text("subtrees.uri")),
            *[Rule("INVALID_IMPLICIT_TEMPLATE", "/subtrees/uri", b) for b in _template_gaps(m.text("subtrees.uri"), m.among("subdivisionScheme", "OCTREE"))],
        ],
    )


def content_findings(rows: DataFrame) -> DataFrame:
    """rows also have implicit (whether the tile is an implicit root) and scheme."""
    m = Members(rows, "content", "uri", "group", "boundingVolume")
    implicit, octree = F.col("implicit"), F.coalesce(F.col("scheme") == "OCTREE", F.lit(False))
    return m.findings(
        "INVALID_CONTENT",
        [
            Rule("INVALID_CONTENT_URI", "/uri", ~m.is_text("uri")),
            Rule("INVALID_CONTENT_GROUP", "/group", m.has("group") & ~m.whole("group", 0)),
            Rule("IMPLICIT_CONTENT_BOUNDING_VOLUME_FORBIDDEN", "/boundingVolume", implicit & m.has("boundingVolume")),
            *[Rule("INVALID_IMPLICIT_TEMPLATE", "/uri", implicit & b) for b in _template_gaps(m.text("uri"), octree)],
        ],
    )


def entity_findings(nodes: DataFrame) -> DataFrame:
    m = Members(nodes, "v", "class", "properties")
    return m.findings("INVALID_METADATA_ENTITY", [Rule("INVALID_METADATA_CLASS", "/class", ~m.is_text("class")), Rule("INVALID_METADATA_PROPERTIES", "/properties", m.has("properties") & ~m.is_object("properties"))])


def volume_findings(nodes: DataFrame) -> DataFrame:
    """nodes also have name: the volume's known extension, null if it has none."""
    m = Members(nodes, "v", "box", "region", "sphere")
    count = reduce(lambda a, b: a + b, (m.has(n).cast("int") for n in ("box", "region", "sphere")))
    wrong = (count > 1) | ((count == 0) & F.col("name").isNull())
    region, sphere = ~m.no_tuple("region", 6), ~m.no_tuple("sphere", 4)
    inside = [
        Rule("INVALID_NUMBER_TUPLE", "/box", m.has("box") & m.no_tuple("box", 12)),
        Rule("INVALID_NUMBER_TUPLE", "/region", m.has("region") & ~region),
        Rule("INVALID_REGION_LATITUDE_ORDER", "/region", region & (m.item("region", 1) > m.item("region", 3))),
        Rule("INVALID_REGION_HEIGHT_ORDER", "/region", region & (m.item("region", 4) > m.item("region", 5))),
        Rule("INVALID_NUMBER_TUPLE", "/sphere", m.has("sphere") & ~sphere),
        Rule("INVALID_SPHERE_RADIUS", "/sphere/3", sphere & (m.item("sphere", 3) < 0)),
    ]
    return m.findings("INVALID_BOUNDING_VOLUME", [Rule("BOUNDING_VOLUME_CARDINALITY", "", wrong), *[r._replace(breaks=~wrong & r.breaks) for r in inside]])


def utm_findings(nodes: DataFrame) -> DataFrame:
    corners = ("minEasting", "minNorthing", "maxEasting", "maxNorthing")
    upright = [f"vertical.{n}" for n in ("extensions", "reference", "direction", "minimum", "maximum", "epsg", "groundElevation")]
    m = Members(nodes, "v", "epsg", "zone", "hemisphere", "vertical", *corners, *upright)
    m.rows = m.rows.withColumn("known", utm_from_epsg(m.number("epsg")))
    has_epsg, has_zone, has_half = m.has("epsg"), m.has("zone"), m.has("hemisphere")
    some = has_epsg | has_zone | has_half
    zone = m.whole("zone", 1) & (m.number("zone") <= 60)
    half = m.among("hemisphere", "N", "S")
    code, known = m.whole("epsg", 1), F.col("known.zone").isNotNull()
    other = (zone & (m.number("zone") != F.col("known.zone"))) | (half & (m.text("hemisphere") != F.col("known.hemisphere")))
    e0, n0, e1, n1 = (m.number(k) for k in corners)
    placed = reduce(lambda a, b: a & b, (m.number(k).isNotNull() for k in corners))
    ground, on_ground = "vertical.groundElevation", m.among("vertical.reference", "GROUND")
    rules = [
        Rule("INVALID_EXTENSIONS", "/vertical/extensions", m.has("vertical.extensions") & ~m.is_object("vertical.extensions")),
        Rule("INVALID_VERTICAL_REFERENCE", "/vertical/reference", ~m.among("vertical.reference", "ELLIPSOID", "GEOID", "GROUND", "LOCAL")),
        Rule("INVALID_VERTICAL_DIRECTION", "/vertical/direction", ~m.among("vertical.direction", "UP", "DOWN")),
        Rule("INVALID_VERTICAL_BOUND", "/vertical/minimum", m.number("vertical.minimum").isNull()),
        Rule("INVALID_VERTICAL_BOUND", "/vertical/maximum", m.number("vertical.maximum").isNull()),
        Rule("INVALID_VERTICAL_ORDER", "/vertical", m.number("vertical.minimum") > m.number("vertical.maximum")),
        Rule("INVALID_VERTICAL_EPSG", "/vertical/epsg", m.has("vertical.epsg") & ~m.whole("vertical.epsg", 1)),
        Rule("INVALID_GROUND_ELEVATION", "/vertical/groundElevation", m.has(ground) & m.number(ground).isNull()),
        Rule("GROUND_ELEVATION_REFERENCE_MISMATCH", "/vertical/groundElevation", m.number(ground).isNotNull() & ~on_ground),
        Rule("GROUND_ELEVATION_MISSING", "/vertical", ~m.has(ground) & on_ground, "warning"),
    ]
    return m.findings(
        "INVALID_UTM_BOUNDING_VOLUME",
        [
            Rule("UTM_REFERENCE_MISSING", "", ~some),
            Rule("INVALID_UTM_EPSG", "/epsg", has_epsg & ~code),
            Rule("INVALID_UTM_ZONE", "/zone", has_zone & ~zone),
            Rule("INVALID_UTM_HEMISPHERE", "/hemisphere", has_half & ~half),
            Rule("INCOMPLETE_UTM_ZONE", "", has_zone != has_half),
            Rule("UTM_EPSG_MISSING", "", some & ~has_epsg, "warning"),
            Rule("UTM_ZONE_REQUIRED", "", code & ~known & ~has_zone & ~has_half),
            Rule("UTM_EPSG_ZONE_MISMATCH", "", code & known & other),
            *[Rule("INVALID_UTM_COORDINATE", f"/{k}", m.number(k).isNull()) for k in corners],
            Rule("INVALID_UTM_EXTENT_ORDER", "/minEasting", placed & (e0 > e1)),
            Rule("INVALID_UTM_EXTENT_ORDER", "/minNorthing", placed & (n0 > n1)),
            Rule("UTM_EASTING_OUT_OF_RANGE", "", placed & ((e0 <= 0) | (e1 >= EASTING_LIMIT)), "warning"),
            Rule("UTM_NORTHING_OUT_OF_RANGE", "", placed & ((n0 < 0) | (n1 > NORTHING_LIMIT)), "warning"),
            Rule("INVALID_VERTICAL_EXTENT", "/vertical", ~m.is_object("vertical")),
            *[r._replace(breaks=m.is_object("vertical") & r.breaks) for r in rules],
        ],
    )


def _strings(v: Column) -> Column:
    """array<string> of an array of one or more texts that are not empty; null if it is none."""
    fine = (F.size(items(v)) > 0) & F.forall(items(v), lambda s: is_text(s))
    return F.when(fine, F.try_variant_get(v, "$", "array<string>"))


def volumes(tiles: DataFrame, own_contents: DataFrame, utm_extension: str) -> DataFrame:
    """(doc_id, order, path, v, name, extension): every bounding volume, with its known extension; order also tells the slots of a tile apart."""
    slot = lambda n: F.concat("order", F.array(F.lit(n - 1000)))  # noqa: E731  before any child
    real = tiles.where(is_object(F.col("tile")))
    own = real.select("doc_id", slot(0).alias("order"), F.concat("path", F.lit("/boundingVolume")).alias("path"), F.coalesce(member(F.col("tile"), "boundingVolume"), F.parse_json(F.lit("null"))).alias("v"))
    request = real.select("doc_id", slot(1).alias("order"), F.concat("path", F.lit("/viewerRequestVolume")).alias("path"), member(F.col("tile"), "viewerRequestVolume").alias("v"))
    inner = own_contents.select("doc_id", F.concat("order", F.array(F.lit(-998), F.col("content_index"))).alias("order"), F.concat("path", F.lit("/boundingVolume")).alias("path"), member(F.col("content"), "boundingVolume").alias("v"))
    every = own.unionAll(request).unionAll(inner).where("v IS NOT NULL")
    known = F.try_variant_get(member(F.col("v"), "extensions"), "$", "map<string,variant>")
    every = every.withColumn("known", F.when(is_object(member(F.col("v"), "extensions")), known))
    every = every.withColumn("name", F.try_element_at(F.filter(F.map_keys("known"), lambda k: k.rlike(utm_extension)), F.lit(1)))
    return every.select("doc_id", "order", "path", "v", "name", F.try_element_at("known", F.col("name")).alias("extension"))


def validate_tilesets(documents: DataFrame, *, utm_extension: str = UTM_EXTENSION) -> DataFrame:
    """(doc_id, order, path, code, severity): what is wrong with each document; those without rows are sound.

    documents have doc_id and raw.  Texts that are not JSON have the one finding INVALID_JSON.
    """
    parsed = parse_documents(documents.select("doc_id", "raw"))
    none = F.array().cast("array<int>")
    broken = parsed.where("v IS NULL").select("doc_id", none.alias("order"), F.lit("").alias("path"), F.lit("INVALID_JSON").alias("code"), F.lit("error").alias("severity"))
    docs = parsed.where("v IS NOT NULL").select("doc_id", none.alias("order"), F.lit("").alias("path"), "v")
    sound = parsed.where("v IS NOT NULL").where(is_object(F.col("v")))
    tiles = settled(flatten(sound.withColumn("v", F.when(member(F.col("v"), "root").isNotNull(), F.col("v")).otherwise(F.parse_json(F.lit('{"root": null}'))))))  # each kind of rule reads them
    tile_implicit = member(F.col("tile"), "implicitTiling")
    own_contents = contents(tiles)
    # a singular content stands beside contents only in documents that are wrong already, and is looked at all the same
    both = tiles.where(member(F.col("tile"), "content").isNotNull() & member(F.col("tile"), "contents").isNotNull())
    beside = both.select("doc_id", "tile_id", "order", F.lit(-1).alias("content_index"), F.concat("path", F.lit("/content")).alias("path"), member(F.col("tile"), "content").alias("content"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("group"))
    own_contents = own_contents.unionAll(beside)
    rooted = own_contents.join(tiles.select("doc_id", "tile_id", tile_implicit.isNotNull().alias("implicit"), F.try_variant_get(tile_implicit, "$.subdivisionScheme", "string").alias("scheme")), ["doc_id", "tile_id"])
    every = volumes(tiles, own_contents, utm_extension)
    implicit = tiles.select("doc_id", "order", F.concat("path", F.lit("/implicitTiling")).alias("path"), tile_implicit.alias("v")).where("v IS NOT NULL")
    entities = (
        docs.select("doc_id", "order", F.lit("/metadata").alias("path"), member(F.col("v"), "metadata").alias("v"))
        .unionAll(tiles.select("doc_id", "order", F.concat("path", F.lit("/metadata")).alias("path"), member(F.col("tile"), "metadata").alias("v")))
        .unionAll(own_contents.select("doc_id", "order", F.concat("path", F.lit("/metadata")).alias("path"), member(F.col("content"), "metadata").alias("v")))
        .where("v IS NOT NULL")
    )
    # an extent is looked at unless its volume has a wrong number of members
    count = reduce(lambda a, b: a + b, (member(F.col("v"), k).isNotNull().cast("int") for k in ("box", "region", "sphere")))
    used = every.where("name IS NOT NULL").where(count <= 1).select("doc_id", "order", F.concat("path", F.lit("/extensions/"), F.col("name")).alias("path"), "name", (count == 0).alias("standalone"), F.col("extension").alias("v"))
    parts = [
        broken,
        tileset_findings(docs),
        tile_findings(tiles),
        content_findings(rooted),
        implicit_findings(implicit),
        entity_findings(entities),
        volume_findings(every),
        utm_findings(used),
        required_subset(docs),
        undeclared_extensions(docs, used),
    ]
    return reduce(DataFrame.unionByName, (p.select(*COLUMNS) for p in parts))


def required_subset(docs: DataFrame) -> DataFrame:
    """Required extensions that are not among the used ones; docs have doc_id and v."""
    lists = docs.select("doc_id", "order", _strings(member(F.col("v"), "extensionsUsed")).alias("used"), _strings(member(F.col("v"), "extensionsRequired")).alias("required"))
    required = lists.select("doc_id", "order", F.posexplode("required").alias("i", "name"))
    used = lists.select("doc_id", F.explode("used").alias("name"))
    return required.join(used, ["doc_id", "name"], "left_anti").select("doc_id", "order", F.concat(F.lit("/extensionsRequired/"), F.col("i").cast("string")).alias("path"), F.lit("REQUIRED_EXTENSION_NOT_USED").alias("code"), F.lit("error").alias("severity"))


def undeclared_extensions(docs: DataFrame, uses: DataFrame) -> DataFrame:
    """The first use of each volume extension that its document does not declare as it must; uses: doc_id, order, path, name, standalone."""
    lists = docs.select("doc_id", _strings(member(F.col("v"), "extensionsUsed")).alias("used"), _strings(member(F.col("v"), "extensionsRequired")).alias("required"))
    named = lambda c: F.coalesce(F.array_contains(F.col(c), F.col("name")), F.lit(False))
    code = F.when(~named("used"), "EXTENSION_NOT_DECLARED").when(F.col("standalone") & ~named("required"), "BOUNDING_VOLUME_EXTENSION_NOT_REQUIRED")
    wrong = uses.join(lists, "doc_id").withColumn("code", code).where("code IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("order", "path"))
    return wrong.withColumn("n", first).where("n = 1").select("doc_id", "order", "path", "code", F.lit("error").alias("severity"))


def validate_extents(extents: DataFrame) -> DataFrame:
    """Findings of UTM extents that stand alone: rows (doc_id, raw)."""
    nodes = parse_documents(extents).select("doc_id", F.array().cast("array<int>").alias("order"), F.lit("").alias("path"), F.coalesce("v", F.parse_json(F.lit("null"))).alias("v"))
    return utm_findings(nodes)
