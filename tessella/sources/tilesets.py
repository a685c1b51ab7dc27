"""Tileset documents: reading, taking apart, writing.

A document is a row (doc_id, uri, raw, v, error): raw is the text as it was, v its VARIANT.  Its tree is taken apart
into a row for each tile by a structural index of the text: brackets and keys say where each tile begins and ends, however deep it lies.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.tiles import tile_id
from tessella.functions.uri import base_uri, resolve_uri

INVALID_JSON = "INVALID_JSON"
#: A bounding volume extension by UTM extent, whatever vendor's prefix it has.
UTM_EXTENSION = "^[A-Z0-9]+_bounding_volume_utm$"


def member(v: Column, name: str) -> Column:
    """A member of an object: SQL null where it is missing, the variant null where it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column, empty: bool = False) -> Column:
    own = F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    return own if empty else own & (F.try_variant_get(v, "$", "string") != "")


def is_number(v: Column) -> Column:
    """A finite number."""
    value = F.try_variant_get(v, "$", "double")
    return F.coalesce(F.schema_of_variant(v).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.abs(value) < float("inf")) & ~F.isnan(value), F.lit(False))


def number(v: Column) -> Column:
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def items(v: Column) -> Column:
    """The items of an array; null if it is none."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def text_of(v: Column) -> Column:
    return F.when(is_text(v, empty=True), F.try_variant_get(v, "$", "string"))


def numbers(v: Column) -> Column:
    """array<double> of an array of numbers; null if it is none."""
    return F.when(items(v).isNotNull(), F.try_variant_get(v, "$", "array<double>"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Adds v and error to rows with raw.  Of keys that stand twice in an object the last counts."""
    documents.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = documents.withColumn("v", F.try_parse_json("raw"))
    return parsed.withColumn("error", F.when(F.col("v").isNull(), INVALID_JSON))


def read_tilesets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, uri, base_uri, raw, v, error) of the files below path; bytes that are not UTF-8 are an error, a byte order mark is left out."""
    files = spark.read.format("binaryFile").load(path)
    data = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    raw = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    return parse_documents(files.select(F.col("path").alias("doc_id"), F.col("path").alias("uri"), base_uri(F.col("path")).alias("base_uri"), raw.alias("raw")))


def with_schemas(documents: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """Adds schema_uri, schema and schema_issue to parsed documents (doc_id, base_uri, v, ...).

    schemas: (uri, v), the schema files that were read, v null where one is no JSON; None if there is nothing to read them with.  A
    document's own schema counts unless it names a file.  schema_issue is METADATA_SCHEMA_LOAD_FAILED (an error) or METADATA_SCHEMA_LOADER_MISSING (a warning).
    """
    named_file = text_of(member(F.col("v"), "schemaUri"))
    rows = documents.withColumn("schema_uri", F.when(named_file != "", resolve_uri(named_file, F.col("base_uri"))))
    own = member(F.col("v"), "schema")
    if schemas is None:
        return rows.withColumns({"schema": own, "schema_issue": F.when(F.col("schema_uri").isNotNull(), "METADATA_SCHEMA_LOADER_MISSING")})
    files = schemas.select(F.col("uri").alias("schema_uri"), F.col("v").alias("loaded"))
    joined = rows.join(files, "schema_uri", "left")
    schema = F.when(F.col("schema_uri").isNull(), own).otherwise(F.col("loaded"))
    failed = F.when(F.col("schema_uri").isNotNull() & F.col("loaded").isNull(), "METADATA_SCHEMA_LOAD_FAILED")
    return joined.select(*rows.columns, schema.alias("schema"), failed.alias("schema_issue"))


#: A string (with the colon that makes it a key), a bracket, or what lies between those.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:\s*+)?|[\[\]{}]|[^"\[\]{}]++'


def structure(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, t, level, above, tile, array, inside, free, empty): the tokens of parsed documents whose root is an object, and whose they are.

    level counts the tiles around a token, a tile's own brackets included; tile is the pos of the innermost one's bracket, above the level before the
    token.  array says that the token opens a tile's children, inside that it lies among them but in no tile of theirs, free that no bracket stands around it but those of tiles and their children, empty that an array has no items.  One scan finds the
    tokens, running counts the depths; all windows are within a document, which is a row of text to begin with.
    """
    tokens = documents.where(is_object(member(F.col("v"), "root"))).select("doc_id", F.posexplode(F.regexp_extract_all("raw", F.lit(TOKEN), F.lit(0))).alias("pos", "t"))
    doc = Window.partitionBy("doc_id").orderBy("pos")
    up, to = Window.unboundedPreceding, Window.currentRow
    opens, closes = F.col("t").isin("{", "["), F.col("t").isin("}", "]")
    tokens = tokens.withColumns({"opens": opens, "closes": closes, "key": F.when(F.col("t").startswith('"'), F.regexp_extract("t", r'(?s)^(".*")\s*:\s*$', 1))})
    # null: no key, "": a key of another name
    told = F.when(F.col("key").contains("\\"), F.try_variant_get(F.try_parse_json("key"), "$", "string")).otherwise(F.expr("substring(key, 2, length(key) - 2)"))
    tokens = tokens.withColumn("key", F.when(F.col("key") != "", F.when(told.isin("root", "children"), told).otherwise("")))
    # the depth of a bracket is that of what it encloses, at both ends
    running = F.sum(F.col("opens").cast("int") - F.col("closes").cast("int")).over(doc.rowsBetween(up, to))
    tokens = tokens.withColumn("depth", running + F.col("closes").cast("int"))
    # of keys that stand twice in an object the last counts
    which = Window.partitionBy("doc_id", "depth").orderBy("pos").rowsBetween(up, to)
    tokens = tokens.withColumn("object", F.sum(F.col("opens").cast("int")).over(which))
    last = F.max("pos").over(Window.partitionBy("doc_id", "depth", "object", "key")) == F.col("pos")
    tokens = tokens.withColumn("key", F.when(last, F.col("key")).when(F.col("key").isNotNull(), F.lit("")))
    following = F.lead("t").over(doc)
    tokens = tokens.withColumns({"named": F.lag("key").over(doc), "empty": (following == "]") | (following.rlike(r"^\s*$") & (F.lead("t", 2).over(doc) == "]"))})
    named = F.col("named")
    # brackets on the way to tiles; they are that only if no other bracket is open around them
    even = F.col("depth") % 2 == 0
    document, root = F.col("depth") == 1, (F.col("depth") == 2) & (named == "root")
    child = (F.col("depth") > 2) & even & named.isNull() & (F.col("t") == "{")
    children = (F.col("depth") > 2) & ~even & (named == "children") & (F.col("t") == "[")
    tokens = tokens.withColumn("way", F.when(F.col("opens"), F.coalesce(F.when(document, "document").when(root & (F.col("t") == "{") | child, "tile").when(children, "array"), F.lit("other"))))
    # of one depth, brackets come in pairs
    opened = F.last("way", True).over(Window.partitionBy("doc_id", "depth").orderBy("pos").rowsBetween(up, -1))
    tokens = tokens.withColumn("way", F.when(F.col("closes"), opened).otherwise(F.col("way")))
    count = lambda which, frame: F.coalesce(F.sum(F.when(which, F.when(F.col("opens"), 1).otherwise(-1))).over(doc.rowsBetween(up, frame)), F.lit(0))
    other = F.col("way") == "other"
    tokens = tokens.withColumn("free", F.greatest(count(other, to), count(other, -1)) == 0)
    tile, array = F.col("free") & (F.col("way") == "tile"), F.col("free") & (F.col("way") == "array")
    tokens = tokens.withColumns({"after": count(tile, to), "above": count(tile, -1), "arrays": F.least(count(array, to), count(array, -1))})
    tokens = tokens.withColumns({
        "tile_opens": F.coalesce(tile & F.col("opens"), F.lit(False)), "array": F.coalesce(array & F.col("opens"), F.lit(False)), "level": F.greatest("after", "above"),
        "inside": (F.col("above") > 0) & (F.col("after") == F.col("above")) & (F.col("arrays") == F.col("above")),
    })
    own = Window.partitionBy("doc_id", "level").orderBy("pos").rowsBetween(up, to)
    return tokens.select("doc_id", "pos", "t", "level", "above", F.last(F.when(F.col("tile_opens"), F.col("pos")), True).over(own).alias("tile"), "array", "inside", "free", "empty")


def flatten(documents: DataFrame, *, graft_at: Column | None = None) -> DataFrame:
    """(doc_id, tile_id, parent_id, path, depth, ordinal, order, refine, tile): a row for each tile of parsed documents (doc_id, raw, v), whose ids differ.

    order is the ordinals from the root down, so sorting by it is the order of reading.  refine is the tile's own mode, else
    its parent's, else REPLACE.  tile has the tile's own members: one that has children has an array of one placeholder instead.  Items of children
    that are no objects are rows too.  Documents without an object as root give the row of that root alone.
    """
    start = F.coalesce(graft_at, tile_id(F.col("doc_id").cast("string"), F.lit("root"))) if graft_at is not None else tile_id(F.col("doc_id").cast("string"), F.lit("root"))
    tokens = structure(documents)
    up, to = Window.unboundedPreceding, Window.currentRow
    # seen from where a child begins: its parent is the tile around the children's bracket, its ordinal the commas since then
    outer = Window.partitionBy("doc_id", "above").orderBy("pos").rowsBetween(up, to)
    commas = F.when(F.col("inside") & F.col("free") & ~F.col("t").startswith('"'), F.length("t") - F.length(F.replace("t", F.lit(","), F.lit("")))).otherwise(0)
    tokens = tokens.withColumn("commas", commas).withColumn("past", F.sum("commas").over(outer))
    tokens = tokens.withColumns({"parent": F.last(F.when(F.col("array"), F.col("tile")), True).over(outer), "base": F.last(F.when(F.col("array"), F.col("past")), True).over(outer)})
    # a token is part of the tile around it, or of what else stands among children: between which commas, of which tile's
    whole = F.struct(F.col("tile").alias("of"), F.lit(-1).cast("long").alias("ordinal"), F.when(F.col("array") & ~F.col("empty"), F.lit("[true")).otherwise(F.col("t")).alias("text"))
    runs = F.when(F.col("commas") > 0, F.split("t", ",")).otherwise(F.array("t"))
    loose = F.transform(runs, lambda x, i: F.struct(F.col("parent").alias("of"), (F.col("past") - F.col("commas") - F.col("base") + i).cast("long").alias("ordinal"), x.alias("text")))
    among = F.col("inside") & ~F.col("array")
    pieces = tokens.where("level > 0").withColumn("piece", F.explode(F.when(among, loose).otherwise(F.array(whole))))
    begins = F.col("pos") == F.col("tile")
    tiles = pieces.groupBy("doc_id", "piece.of", F.col("piece.ordinal").alias("among")).agg(
        F.min("pos").alias("pos"), (F.min("level") + F.max(among.cast("int"))).cast("int").alias("level"), F.max(F.when(begins, F.col("past") - F.col("base"))).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece.text"))), lambda x: x["text"]), "").alias("text"),
    ).where(r"text RLIKE '\\S'")
    ordinal = F.when(F.col("among") >= 0, F.col("among")).otherwise(F.coalesce("place", F.lit(0))).cast("int")
    tiles = tiles.select("doc_id", "pos", "among", "level", ordinal.alias("ordinal"), F.try_parse_json("text").alias("tile"))
    mode = text_of(member(F.col("tile"), "refine"))
    tiles = tiles.withColumn("mode", F.when(mode.isin("ADD", "REPLACE"), mode))
    # the tiles around a tile: of each level the last one that has begun
    reach = Window.partitionBy("doc_id", "at").orderBy("pos", "among").rowsBetween(up, to)
    around = tiles.select("*", F.explode(F.sequence(F.lit(1), "level")).alias("at"))
    seen = F.last(F.when(F.col("at") == F.col("level"), F.struct("at", "ordinal", "mode")), True).over(reach)
    around = around.withColumn("seen", seen).groupBy("doc_id", "pos", "among").agg(F.array_sort(F.collect_list("seen")).alias("way"), F.first(F.when(F.col("at") == F.col("level"), F.struct("level", "ordinal", "tile")), True).alias("own"))
    order = F.transform(F.slice("way", 2, 1 << 20), lambda x: x["ordinal"])
    inherited = F.element_at(F.filter(F.transform("way", lambda x: x["mode"]), lambda m: m.isNotNull()), -1)
    rows = around.select("doc_id", order.alias("order"), F.when(F.size(F.filter("way", lambda x: x["mode"].isNotNull())) > 0, inherited).otherwise("REPLACE").alias("refine"), F.col("own.tile").alias("tile"), F.col("own.ordinal").alias("ordinal"), (F.col("own.level") - 1).alias("depth"))
    starts = documents.where("v IS NOT NULL").select("doc_id", start.alias("start"))
    rows = rows.join(starts, "doc_id") if graft_at is not None else rows.withColumn("start", start)
    alone = documents.where("v IS NOT NULL").where(~is_object(member(F.col("v"), "root"))).select(
        "doc_id", F.array().cast("array<int>").alias("order"), F.lit("REPLACE").alias("refine"), member(F.col("v"), "root").alias("tile"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), start.alias("start")
    )
    rows = rows.unionByName(alone)
    below = lambda first, between, some: F.when(F.size(some) > 0, F.concat(first, F.lit(between), F.array_join(some, between))).otherwise(first)
    parents = F.slice("order", F.lit(1), F.greatest(F.size("order") - 1, F.lit(0)))
    return rows.select(
        "doc_id", below(F.col("start"), "/", F.col("order")).alias("tile_id"), F.when(F.size("order") > 0, below(F.col("start"), "/", parents)).alias("parent_id"),
        below(F.lit("/root"), "/children/", F.col("order")).alias("path"), "depth", "ordinal", "order", "refine", "tile",
    )


def contents(tiles: DataFrame, base: Column | None = None) -> DataFrame:
    """(doc_id, tile_id, order, content_index, path, content, uri, group): a row for each content of flattened tiles."""
    one, many = member(F.col("tile"), "content"), items(member(F.col("tile"), "contents"))
    every = F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one))
    rows = tiles.select("doc_id", "tile_id", "order", F.col("path").alias("at"), many.isNotNull().alias("plural"), F.posexplode(every).alias("content_index", "content"))
    path = F.when(F.col("plural"), F.concat("at", F.lit("/contents/"), F.col("content_index").cast("string"))).otherwise(F.concat("at", F.lit("/content")))
    uri = text_of(member(F.col("content"), "uri"))
    return rows.select("doc_id", "tile_id", "order", "content_index", path.alias("path"), "content", (resolve_uri(uri, base) if base is not None else uri).alias("uri"), number(member(F.col("content"), "group")).cast("int").alias("group"))


def tile_columns(tiles: DataFrame) -> DataFrame:
    """The typed members of flattened tiles: box, region, sphere, transform, geometric_error and implicit tiling."""
    t = F.col("tile")
    volume, implicit = member(t, "boundingVolume"), member(t, "implicitTiling")
    return tiles.select(
        *[c for c in tiles.columns if c != "tile"],
        *[numbers(member(volume, k)).alias(k) for k in ("box", "region", "sphere")],
        numbers(member(t, "transform")).alias("transform"),
        number(member(t, "geometricError")).alias("geometric_error"),
        text_of(member(implicit, "subdivisionScheme")).alias("scheme"),
        number(member(implicit, "subtreeLevels")).cast("int").alias("subtree_levels"),
        number(member(implicit, "availableLevels")).cast("int").alias("available_levels"),
        text_of(F.try_variant_get(implicit, "$.subtrees.uri", "variant")).alias("subtrees_uri"),
    )


def graft_external(roots: DataFrame, external: DataFrame, links: DataFrame) -> DataFrame:
    """Tiles of external documents hung below the contents that name them.

    links: (parent_tile, content_index, uri); external: parsed documents by uri.  The document's root becomes the child
    external-<content_index>, and its tiles are named below it.  roots are the tiles they join.
    """
    hung = external.join(links, "uri").withColumn("doc_id", F.concat_ws("#", "uri", "parent_tile", F.col("content_index").cast("string")))
    below = flatten(hung, graft_at=tile_id(F.col("parent_tile"), F.concat(F.lit("external-"), F.col("content_index").cast("string"))))
    parents = hung.select("doc_id", F.col("parent_tile").alias("hung_on"))
    joined = below.join(parents, "doc_id").withColumn("parent_id", F.coalesce("parent_id", "hung_on")).drop("hung_on")
    return roots.unionByName(joined.select(*roots.columns))


def indent_of(pretty: bool | int | None) -> int | None:
    """True is 4; numbers are held to 0 to 10."""
    if pretty is True:
        return 4
    return max(0, min(10, int(pretty))) if isinstance(pretty, int) and not isinstance(pretty, bool) else None


def to_text(raw: Column, pretty: bool | int | None = None) -> Column:
    """The text of a document, keys in their order, indented or compact."""
    indent = indent_of(pretty)

    @F.pandas_udf("string")
    def dumped(texts: pd.Series) -> pd.Series:
        def number(text: str):
            value = float(text)
            return int(value) if value.is_integer() and abs(value) < 1e21 else value

        def one(text):
            value = json.loads(text, parse_float=number)
            return json.dumps(value, ensure_ascii=False, indent=indent or None, separators=(",", ": ") if indent else (",", ":"))

        return texts.map(one, na_action="ignore")

    return dumped(raw)


def write_tilesets(documents: DataFrame, path: str, *, validate: bool = True, pretty: bool | int | None = None, utm_extension: str = UTM_EXTENSION) -> None:
    """Write raw documents as text, a row each; documents with errors stop the write if validate."""
    if validate:
        from tessella.plans.validation import validate_tilesets

        bad = validate_tilesets(documents, utm_extension=utm_extension).where("severity = 'error'").select("doc_id", "code").first()
        if bad:
            raise ValueError(f"document {bad['doc_id']} is not valid: {bad['code']}")
    documents.select(to_text(F.col("raw"), pretty).alias("value")).write.option("lineSep", "\n").text(path)


def utm_tileset(extent: Column, *, extension: str, geometric_error: float = 0.0, refine: str = "REPLACE", content_uri: Column | None = None) -> Column:
    """The text of a tileset with one tile whose only volume is a UTM extent struct; the extension is declared used and required."""
    volume = F.concat(F.lit(f'{{"extensions":{{"{extension}":'), F.to_json(extent), F.lit("}}"))
    content = F.concat(F.lit(',"content":{"uri":'), F.to_json(F.struct(content_uri.alias("u"))).substr(F.lit(6), F.length(F.to_json(F.struct(content_uri.alias("u")))) - 6), F.lit("}")) if content_uri is not None else F.lit("")
    declared = f'"extensionsUsed":["{extension}"],"extensionsRequired":["{extension}"]'
    return F.concat(F.lit(f'{{"asset":{{"version":"1.1"}},"geometricError":{geometric_error:g},"root":{{"boundingVolume":'), volume, F.lit(f',"geometricError":{geometric_error:g},"refine":"{refine}"'), content, F.lit(f"}},{declared}}}"))
