"""Typed metadata: scopes of a tile, joined to their classes, with defaults, normalisation, diagnostics and lookup by meaning.

Scopes are never merged: a property's value in each scope is a row.  Long tables throughout:

* scopes (snapshot, scope_ord, scope, owner, schema_id, class), one row for each entity that applies to a tile;
* properties (snapshot, scope_ord, property, ord, raw), the bag of each entity; raw is a VARIANT;
* definitions (schema_id, class, property, prop_ord, type, component_type, enum_type, is_array, count, normalized, offset, scale, no_data, default_value,
  required, semantic), offsets to defaults as VARIANTs;
* enum_values (schema_id, enum, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.handles import with_names
from tessella.sources.tilesets import is_number, is_text, items, number

# Fixed values of the format.
LENGTHS = {"VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
RANGES = {"INT8": (-(1 << 7), (1 << 7) - 1), "UINT8": (0, (1 << 8) - 1), "INT16": (-(1 << 15), (1 << 15) - 1), "UINT16": (0, (1 << 16) - 1), "INT32": (-(1 << 31), (1 << 31) - 1), "UINT32": (0, (1 << 32) - 1)}
SCOPES = ("tileset", "subtree", "ancestor-tile", "tile", "group", "content", "feature")
PRECEDENCE = ("feature", "content", "tile", "ancestor-tile", "subtree", "group", "tileset")


def normalize(value: Column, component: Column) -> Column:
    """Unsigned integers to [0, 1], signed ones to [-1, 1]; 64-bit integers and floats stay."""
    out = value
    for name, (low, high) in RANGES.items():
        own = value / float(high)
        out = F.when(component == name, F.greatest(own, F.lit(-1.0)) if low < 0 else own).otherwise(out)
    return out


def scaled(value: Column, component: Column, normalized: Column, scale: Column | None = None, offset: Column | None = None) -> Column:
    v = F.when(F.coalesce(normalized, F.lit(False)), normalize(value, component)).otherwise(value)
    v = v * (F.coalesce(scale, F.lit(1.0)) if scale is not None else 1.0)
    return v + (F.coalesce(offset, F.lit(0.0)) if offset is not None else 0.0)


def _part(v: Column, i: Column) -> Column:
    """The i-th number of an array, or the number itself."""
    return F.when(items(v).isNotNull(), number(F.try_element_at(items(v), i + 1))).otherwise(number(v))


def transformed(v: Column, component: Column, normalized: Column, scale: Column, offset: Column) -> Column:
    """A VARIANT's numbers (nested arrays stay) normalised, scaled and moved: a struct (number, numbers), both null for anything else."""
    single = scaled(number(v), component, normalized, _part(scale, F.lit(0)), _part(offset, F.lit(0)))
    many = F.transform(items(v), lambda x, i: scaled(number(x), component, normalized, _part(scale, i), _part(offset, i)))
    return F.struct(F.when(is_number(v), single).alias("number"), F.when(items(v).isNotNull(), many).alias("numbers"))


def _component_ok(v: Column, component: Column) -> Column:
    n = number(v)
    inside = F.lit(True)
    for name, (low, high) in RANGES.items():
        inside = F.when(component == name, n.between(low, high)).otherwise(inside)
    free = component.isNull() | component.startswith("FLOAT")
    return F.coalesce(is_number(v) & (free | ((n == F.floor(n)) & inside)), F.lit(False))


def value_valid(v: Column, type_: Column, component: Column, is_array: Column, count: Column, names: Column) -> Column:
    """Whether a raw value fits its definition; names are those of its enum."""

    def one(x: Column) -> Column:
        vector = F.lit(False)
        for name, n in LENGTHS.items():
            vector = F.when(type_ == name, (F.size(items(x)) == n) & F.forall(items(x), lambda e: _component_ok(e, component))).otherwise(vector)
        return F.coalesce(
            F.when(type_ == "BOOLEAN", F.schema_of_variant(x) == "BOOLEAN")
            .when(type_ == "STRING", is_text(x, empty=True))
            .when(type_ == "ENUM", is_text(x, empty=True) & F.array_contains(F.coalesce(names, F.array().cast("array<string>")), F.try_variant_get(x, "$", "string")))
            .when(type_ == "SCALAR", _component_ok(x, component))
            .otherwise(vector),
            F.lit(False),
        )

    listed = (items(v).isNotNull()) & (count.isNull() | (F.size(items(v)) == count)) & F.forall(items(v), one)
    return F.when(F.coalesce(is_array, F.lit(False)), F.coalesce(listed, F.lit(False))).otherwise(one(v))


def resolve_metadata(scopes: DataFrame, properties: DataFrame, definitions: DataFrame, enum_values: DataFrame) -> DataFrame:
    """A row for each property of each scope: what it says, what it means, whether it is a default, no data, and sound.

    Properties that are declared but absent, and absent from the schema but present, are both there (a full join).  issue is null or a code;
    values of defaults are checked and transformed as raw ones are.
    """
    entity, of = ["snapshot", "scope_ord"], ["scope", "owner", "schema_id", "class"]
    own = scopes.select(*entity, *of)
    known = [c for c in definitions.columns if c not in ("schema_id", "class", "property")]
    left = own.join(definitions, ["schema_id", "class"]).select(*entity, "property", *of, F.lit(True).alias("declared"), *known)
    said = own.join(properties, entity).select(*entity, "property", *[F.col(c).alias(f"said_{c}") for c in of], "ord", "raw")
    # either side knows its scope: nothing is looked up again
    both = left.join(said, [*entity, "property"], "full").withColumns({c: F.coalesce(c, f"said_{c}") for c in of})
    names = enum_values.groupBy("schema_id", F.col("enum").alias("enum_type")).agg(F.collect_set("name").alias("names"))
    both = both.join(names, ["schema_id", "enum_type"], "left")
    text = lambda c: F.to_json(F.col(c))
    no_data = F.col("no_data").isNotNull() & F.col("raw").isNotNull() & F.coalesce(F.when(number(F.col("raw")).isNotNull(), number(F.col("raw")) == number(F.col("no_data"))).otherwise(text("raw") == text("no_data")), F.lit(False))
    both = both.withColumn("is_no_data", no_data)
    both = both.withColumn("from_default", (F.col("raw").isNull() | F.col("is_no_data")) & F.col("default_value").isNotNull())
    source = F.when(F.col("from_default"), F.col("default_value")).when(~F.col("is_no_data"), F.col("raw"))
    both = both.withColumn("source", source)
    moved = F.when(F.col("declared"), transformed(F.col("source"), F.col("component_type"), F.col("normalized"), F.col("scale"), F.col("offset")))
    valid = value_valid(F.col("source"), F.col("type"), F.col("component_type"), F.col("is_array"), F.col("count"), F.col("names"))
    issue = (
        F.when(F.col("declared").isNull(), "METADATA_PROPERTY_UNKNOWN")
        .when(F.coalesce("required", F.lit(False)) & F.col("source").isNull(), "METADATA_PROPERTY_REQUIRED")
        .when(F.col("source").isNotNull() & ~valid, "METADATA_PROPERTY_TYPE")
    )
    return both.withColumns({"moved": moved, "issue": issue}).select(
        "snapshot", "scope_ord", "scope", "owner", "class", "property", F.coalesce("prop_ord", F.col("ord") + 1_000_000).alias("prop_ord"), "semantic", "raw",
        F.col("moved.number").alias("number"), F.col("moved.numbers").alias("numbers"), "source", "from_default", "is_no_data", "issue",
    )


def scope_issues(scopes: DataFrame, definitions: DataFrame, schemas: DataFrame) -> DataFrame:
    """(snapshot, scope_ord, code, severity): entities whose schema is not there, or does not have their class."""
    classes = definitions.select("schema_id", "class").distinct().withColumn("has_class", F.lit(True))
    rows = scopes.join(schemas.select("schema_id").distinct().withColumn("has_schema", F.lit(True)), "schema_id", "left").join(classes, ["schema_id", "class"], "left")
    code = F.when(F.col("has_schema").isNull(), "METADATA_SCHEMA_UNAVAILABLE").when(F.col("has_class").isNull(), "METADATA_CLASS_UNKNOWN")
    return rows.withColumn("code", code).where("code IS NOT NULL").select("snapshot", "scope_ord", "code", F.when(F.col("code") == "METADATA_SCHEMA_UNAVAILABLE", "warning").otherwise("error").alias("severity"))


def group_issues(contents: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, tile_id, content_index, code): contents that name a group which their document does not have."""
    known = groups.select("doc_id", F.col("group_index").alias("group"))
    named = contents.where(F.col("group").isNotNull())
    return named.join(known, ["doc_id", "group"], "left_anti").select("doc_id", "tile_id", "content_index", F.lit("METADATA_GROUP_OUT_OF_RANGE").alias("code"))


def find_by_semantic(resolved: DataFrame, semantic: str, order: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """A row for each snapshot that has a property of that meaning: the first scope kind in order, its last scope, its first property."""
    place = F.create_map(*[F.lit(v) for i, s in enumerate(order) for v in (s, i)])
    rows = resolved.where(F.col("semantic") == semantic).withColumn("__p", F.try_element_at(place, F.col("scope"))).where("__p IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("snapshot").orderBy("__p", F.desc("scope_ord"), "prop_ord"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__p", "__n")


def with_handles(resolved: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the handle of their snapshot, the table (name, handle) of all): numbers without gaps; snapshots in known keep theirs."""
    table = with_names(known, resolved.select(F.col("snapshot").alias("name")))
    return resolved.join(table.withColumnRenamed("name", "snapshot"), "snapshot", "left"), table


def collect_scopes(tiles: DataFrame, entities: DataFrame) -> DataFrame:
    """(snapshot, scope_ord, ...): the entities that apply to each tile, in the order of reading.

    tiles: (tile_id, doc_id, subtree_id, group_key, content_id); entities: (scope, owner, schema_id, class).  A tile has its tileset's, its subtree's, those of
    its ancestors from the root down, its own, its content's group's, its content's, its features'.
    """
    from tessella.operators.hierarchy import ancestors

    t = tiles.select("tile_id", "doc_id", "subtree_id", "group_key", "content_id")
    above = ancestors(t.select("tile_id")).select("tile_id", F.lit("ancestor-tile").alias("scope"), F.col("ancestor").alias("owner"), (-F.col("distance")).alias("at"))
    own = lambda scope, c: t.select("tile_id", F.lit(scope).alias("scope"), F.col(c).alias("owner"), F.lit(0).alias("at"))
    named = above.unionAll(own("tileset", "doc_id")).unionAll(own("subtree", "subtree_id")).unionAll(own("tile", "tile_id")).unionAll(own("group", "group_key")).unionAll(own("content", "content_id")).unionAll(own("feature", "tile_id"))
    e = entities.withColumn("join_scope", F.when(F.col("scope") == "tile", F.array(F.lit("tile"), F.lit("ancestor-tile"))).otherwise(F.array("scope")))
    e = e.drop("scope").withColumn("scope", F.explode("join_scope")).drop("join_scope")
    place = F.create_map(*[F.lit(v) for i, s in enumerate(SCOPES) for v in (s, i)])
    rows = named.where("owner IS NOT NULL").join(e, ["scope", "owner"])
    number_ = F.row_number().over(Window.partitionBy("tile_id").orderBy(F.try_element_at(place, F.col("scope")), "at", "owner")) - 1
    return rows.withColumn("scope_ord", number_).withColumnRenamed("tile_id", "snapshot").drop("at")
