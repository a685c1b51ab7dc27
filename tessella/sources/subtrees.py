"""Subtree files: the binary container as Column expressions, buffers joined by URI, virtual dense subtrees, pyramids.

A container is a header of 24 bytes (magic, version, two lengths), a JSON chunk and a binary chunk, both padded to 8
bytes.  It is taken apart with substrings and number conversion, so reading stays in generated code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.implicit import MAX_SAFE
from tessella.functions.uri import base_uri, resolve_uri
from tessella.sources.tilesets import is_object, items, member, number, text_of
from tessella.storage import settled

# Fixed values of the container.
HEADER, MAGIC, VERSION = 24, "73756274", 1


def _little_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number of `size` bytes as decimal(20,0), lowest byte first."""
    digits = F.hex(F.substring(data, at + 1, size))
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def decode_subtrees(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds v (VARIANT), chunk (the binary chunk, null if empty) and error to rows with bytes.

    error is null, or one of: NOT_AN_OBJECT, INVALID_JSON, TRUNCATED_HEADER, UNSUPPORTED_VERSION, LENGTH_NOT_SAFE,
    CHUNKS_EXCEED_BYTES.  Bytes without the magic are taken as JSON.
    """
    data = F.col(content)
    binary = F.hex(F.substring(data, 1, 4)) == MAGIC
    short = binary & (F.octet_length(data) < HEADER)
    whole = binary & ~short
    n_json, n_chunk = F.when(whole, _little_endian(data, 8, 8)), F.when(whole, _little_endian(data, 16, 8))
    out = files.withColumns({"__whole": whole, "__json": n_json, "__chunk": n_chunk})
    version = F.when(F.col("__whole"), _little_endian(data, 4, 4))
    unsafe = (F.col("__json") > MAX_SAFE) | (F.col("__chunk") > MAX_SAFE)
    beyond = F.col("__json") + F.col("__chunk") + HEADER > F.octet_length(data)
    first = F.when(short, "TRUNCATED_HEADER").when(version != VERSION, "UNSUPPORTED_VERSION").when(unsafe, "LENGTH_NOT_SAFE").when(beyond, "CHUNKS_EXCEED_BYTES")
    out = out.withColumn("error", first)
    body = F.when(F.col("error").isNull(), F.when(F.col("__whole"), F.substring(data, F.lit(HEADER + 1), F.col("__json").cast("int"))).otherwise(data))
    text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    out = out.withColumn("__v", F.try_parse_json(text))
    error = F.coalesce("error", F.when(F.col("__v").isNull(), "INVALID_JSON").when(~is_object(F.col("__v")), "NOT_AN_OBJECT"))
    chunk = F.when(F.col("__whole") & (F.col("__chunk") > 0), F.substring(data, (F.col("__json") + HEADER + 1).cast("int"), F.col("__chunk").cast("int")))
    out = out.withColumns({"error": error, "v": F.when(error.isNull(), F.col("__v")), "chunk": F.when(error.isNull(), chunk)})
    return out.drop("__whole", "__json", "__chunk", "__v")


def encode_subtree(text: Column, chunk: Column | None = None) -> Column:
    """The container of a JSON text and a binary chunk: the one padded with spaces, the other with zeros."""
    head = text.cast("binary")
    tail = F.coalesce(chunk, F.lit(b"")) if chunk is not None else F.lit(b"")
    fill = lambda data, byte: F.concat(data, F.unhex(F.repeat(F.lit(byte), F.pmod(-F.octet_length(data), F.lit(8)))))

    def u64(n: Column) -> Column:
        digits = F.lpad(F.hex(n.cast("long")), 16, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))]))

    a, b = fill(head, "20"), fill(tail, "00")
    return F.concat(F.unhex(F.lit(MAGIC + "01000000")), u64(F.octet_length(a)), u64(F.octet_length(b)), a, b)


AVAILABILITY = "struct<constant: int, bitstream: int, availableCount: bigint>"


def _availability(v: Column) -> Column:
    return F.when(is_object(v), F.struct(*[number(member(v, k)).cast("int" if k != "availableCount" else "long").alias(k) for k in ("constant", "bitstream", "availableCount")]))


def subtree_struct(v: Column, buffers: Column) -> Column:
    """The typed subtree that the availability functions read."""
    views = F.transform(items(member(v, "bufferViews")), lambda b: F.struct(number(member(b, "buffer")).cast("int").alias("buffer"), number(member(b, "byteOffset")).cast("long").alias("byteOffset"), number(member(b, "byteLength")).cast("long").alias("byteLength")))
    return F.struct(
        _availability(member(v, "tileAvailability")).alias("tileAvailability"),
        F.transform(items(member(v, "contentAvailability")), _availability).alias("contentAvailability"),
        _availability(member(v, "childSubtreeAvailability")).alias("childSubtreeAvailability"),
        views.alias("bufferViews"),
        buffers.alias("buffers"),
    )


def load_subtrees(decoded: DataFrame, resources: DataFrame) -> DataFrame:
    """(uri, subtree, error): decoded subtrees (uri, v, chunk, error) with their buffers.

    A buffer with a URI is the row of resources (uri, content) that it resolves to; the first without one is the
    file's own chunk.  Buffers that are missing or too short are errors; longer ones are cut to what is declared.
    """
    decoded = settled(decoded.select("uri", "v", "chunk", "error"))  # read several times, and filtered by what decoding found
    listed = decoded.where("error IS NULL").select("uri", "chunk", F.posexplode_outer(items(member(F.col("v"), "buffers"))).alias("i", "b"))
    listed = listed.where("i IS NOT NULL").select("uri", "i", "chunk", number(member(F.col("b"), "byteLength")).cast("long").alias("n"), resolve_uri(F.nullif(text_of(member(F.col("b"), "uri")), F.lit("")), base_uri(F.col("uri"))).alias("at"))
    found = listed.join(resources.select(F.col("uri").alias("at"), F.col("content").alias("external")), "at", "left")
    data = F.when(F.col("at").isNotNull(), F.col("external")).when(F.col("i") == 0, F.col("chunk"))
    error = F.when(F.col("at").isNull() & data.isNull(), "BUFFER_WITHOUT_DATA").when(data.isNull(), "RESOURCE_NOT_FOUND").when(F.octet_length(data) < F.col("n"), "BUFFER_TOO_SHORT")
    per_file = found.select("uri", "i", error.alias("e"), F.substring(data, F.lit(1), F.col("n").cast("int")).alias("data")).groupBy("uri")
    joined = per_file.agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("parts"), F.min("e").alias("buffer_error"))
    rows = decoded.join(joined, "uri", "left")
    buffers = F.coalesce(F.transform("parts", lambda p: p["data"]), F.array().cast("array<binary>"))
    return rows.select("uri", subtree_struct(F.col("v"), buffers).alias("subtree"), F.coalesce("error", "buffer_error").alias("error"))


def read_subtrees(spark: SparkSession, path: str) -> DataFrame:
    """(uri, subtree, error) of the *.subtree files below path; external buffers are looked for among the other files there."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "content")
    own = decode_subtrees(files.where("uri LIKE '%.subtree'")).select("uri", "v", "chunk", "error")
    return load_subtrees(own, files)


def dense_subtree(level: Column, subtree_levels: Column, available_levels: Column, content_count: Column) -> Column:
    """A subtree in which all is available, and further subtrees as long as levels are left."""
    one = F.from_json(F.lit('{"constant": 1}'), AVAILABILITY)
    more = F.struct(F.when(level + subtree_levels < available_levels, 1).otherwise(0).alias("constant"), F.lit(None).cast("int").alias("bitstream"), F.lit(None).cast("long").alias("availableCount"))
    return F.struct(
        one.alias("tileAvailability"),
        F.when(content_count > 0, F.array_repeat(one, content_count.cast("int"))).alias("contentAvailability"),
        more.alias("childSubtreeAvailability"),
        F.lit(None).cast("array<struct<buffer: int, byteOffset: bigint, byteLength: bigint>>").alias("bufferViews"),
        F.array().cast("array<binary>").alias("buffers"),
    )


def subtree_bytes(text: Column, buffers: Column) -> Column:
    """What a loaded subtree is reckoned to weigh: its buffers and its JSON."""
    return F.octet_length(text) + F.aggregate(buffers, F.lit(0).cast("long"), lambda a, b: a + F.octet_length(b))


@dataclass(frozen=True)
class TilePyramid:
    """A pyramid of web map or elevation tiles: its levels, its root, its URL templates and the volume of its root."""

    min_lod: int
    max_lod: int
    templates: Sequence[str]
    volume: dict
    geometric_error: float
    root: tuple[int, int, int] | None = None
    metadata: dict | None = None
    extra: dict = field(default_factory=dict)
    #: (level, x, y) -> (lod, x, y) Columns of a tile in the pyramid; by default below the root, rows unturned.
    address: Callable[[Column, Column, Column], tuple[Column, Column, Column]] | None = None

    def address_of(self, level: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
        if self.address:
            return self.address(level, x, y)
        lod, rx, ry = self.root or (self.min_lod, 0, 0)
        scale = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
        return F.lit(lod) + level, F.lit(rx) * scale + x, F.lit(ry) * scale + y

    def tileset(self, subtree_levels: int = 4, refine: str = "REPLACE") -> str:
        """The text of the implicit quadtree tileset that the pyramid is."""
        if (self.root or (self.min_lod, 0, 0))[0] != self.min_lod:
            raise ValueError("the root's level must be the pyramid's lowest")
        if not self.templates:
            raise ValueError("a pyramid needs a URL template")
        if not isinstance(subtree_levels, int) or subtree_levels < 1:
            raise ValueError("subtree levels must be a positive integer")
        uris = [{"uri": t.replace("{z}", "{level}").replace("{lod}", "{level}")} for t in self.templates]
        tile = {"boundingVolume": self.volume, "geometricError": self.geometric_error, "refine": refine}
        if self.metadata:
            tile["metadata"] = self.metadata
        tile |= {"content": uris[0]} if len(uris) == 1 else {"contents": uris}
        tile["implicitTiling"] = {"subdivisionScheme": "QUADTREE", "subtreeLevels": subtree_levels, "availableLevels": self.max_lod - self.min_lod + 1, "subtrees": {"uri": "virtual-subtrees/{level}/{x}/{y}.subtree"}}
        return json.dumps({"asset": {"version": "1.1"}, "geometricError": self.geometric_error, "root": tile} | self.extra)
