"""Implicit quadtrees and octrees as Column expressions: addresses, Morton indices, children, bounds.

A tile is (level, x, y) or (level, x, y, z).  All functions take and return Columns and stay in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.spatial import let

#: Integers that a double holds exactly; results beyond are an error, as for readers of the format that have doubles only.
MAX_SAFE = (1 << 53) - 1
QUADTREE, OCTREE = "QUADTREE", "OCTREE"
TAU = 2 * math.pi

#: (shift, mask) steps that put one or two zero bits between the bits of an integer.
_SPREAD_2 = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_SPREAD_3 = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def dimensions(scheme: str) -> int:
    if scheme not in (QUADTREE, OCTREE):
        raise ValueError(f"unknown subdivision scheme {scheme!r}")
    return 3 if scheme == OCTREE else 2


def branching_factor(scheme: Column) -> Column:
    """8 for OCTREE, else 4."""
    return F.when(scheme == OCTREE, 8).otherwise(4)


def safe(value: Column, what: str) -> Column:
    return F.when(value.between(-MAX_SAFE, MAX_SAFE), value).otherwise(F.raise_error(F.lit(f"{what} exceeds the safe integer range")).cast("long"))


def two_to(level: Column) -> Column:
    """2**level as a long; level must be below 53."""
    return F.when(level.between(0, 52), F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))).otherwise(F.raise_error(F.lit("the level exceeds the safe coordinate range")).cast("long"))


def _spread(v: Column, steps: tuple) -> Column:
    for shift, mask in steps:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """The bits of x, y (and z) interleaved, x lowest; only the lowest `level` bits are read."""
    n, most = (3, 21) if z is not None else (2, 31)
    axes = [x, y] if z is None else [x, y, F.coalesce(z, F.lit(0))]
    low = F.least(level, F.lit(most)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1
    parts = [F.shiftleft(_spread(a.cast("long").bitwiseAND(mask), _SPREAD_3 if n == 3 else _SPREAD_2), i) for i, a in enumerate(axes)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.bitwiseOR(p)
    # bits beyond what a long can interleave make the index unsafe anyway
    over = F.lit(False)
    for a in axes:
        over = over | ((level > most) & (F.shiftright(a.cast("long"), most) != 0))
    return safe(F.when(over, F.lit(MAX_SAFE + 1)).otherwise(whole), "the Morton index")


def level_offset(level: Column, branching: int | Column) -> Column:
    """Tiles above a level: (b**level - 1) / (b - 1)."""
    bits = F.when(F.lit(branching) == 8, 3).otherwise(2) if isinstance(branching, int) else F.when(branching == 8, 3).otherwise(2)
    b = F.lit(branching) if isinstance(branching, int) else branching
    shift = (bits * level).cast("int")
    whole = F.call_function("div", F.call_function("shiftleft", F.lit(1).cast("long"), F.least(shift, F.lit(62))) - 1, b - 1)
    return safe(F.when(shift > 62, F.lit(MAX_SAFE + 1)).otherwise(whole), "the availability level offset")


def availability_index(level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    return level_offset(level, 4 if z is None else 8) + morton(level, x, y, z)


def expand_template(template: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """Every {level}, {x}, {y} and {z} replaced; z is 0 where there is none."""
    for name, value in (("{level}", level), ("{x}", x), ("{y}", y), ("{z}", F.coalesce(z, F.lit(0)) if z is not None else F.lit(0))):
        template = F.replace(template, F.lit(name), value.cast("string"))
    return template


def child_coordinates(level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """An array of structs (child, level, x, y[, z]): bit 0 of the child's number goes to x, bit 1 to y, bit 2 to z."""
    count = 4 if z is None else 8

    def child(i: int) -> Column:
        fields = [F.lit(i).alias("child"), (level + 1).alias("level"), (x * 2 + (i & 1)).alias("x"), (y * 2 + (i >> 1 & 1)).alias("y")]
        return F.struct(*fields, *([] if z is None else [(F.coalesce(z, F.lit(0)) * 2 + (i >> 2 & 1)).alias("z")]))

    return F.array(*[child(i) for i in range(count)])


def local_coordinate(value: Column, level: Column, root: Column, root_level: Column) -> Column:
    """One coordinate relative to a subtree's root."""
    return value - root * two_to(level - root_level)


def ancestor(value: Column, levels: Column | int) -> Column:
    """One coordinate of the ancestor so many levels up."""
    return F.call_function("shiftright", value, F.lit(levels).cast("int") if isinstance(levels, int) else levels.cast("int"))


def normalize_longitude(value: Column) -> Column:
    """Wrapped to [-pi, pi); exactly pi stays."""
    return F.when(value == math.pi, value).otherwise(((value + math.pi) % TAU + TAU) % TAU - math.pi)


def subdivide_region(region: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """West, south, east, north, lowest and highest of a tile of a region; heights are split where z is given."""
    west, south, east, north, low, high = (region[i] for i in range(6))
    scale = two_to(level).cast("double")
    wide = (F.when(east < west, east + TAU).otherwise(east) - west) / scale
    tall = (north - south) / scale
    w = west + wide * x
    if z is not None:
        deep = (high - low) / scale
        low = low + deep * z
        high = low + deep
    return F.array(normalize_longitude(w), south + tall * y, normalize_longitude(w + wide), south + tall * (y + 1), low, high)


def subdivide_box(box: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """Centre and half axes of a tile of a box; the third axis is split where z is given."""
    scale = two_to(level).cast("double")
    at = [F.lit(-1.0) + (2 * c + 1) / scale for c in (x, y)] + [F.lit(0.0) if z is None else F.lit(-1.0) + (2 * z + 1) / scale]
    axes = [[box[3 + 3 * a + i] for i in range(3)] for a in range(3)]
    centre = [box[i] + axes[0][i] * at[0] + axes[1][i] * at[1] + axes[2][i] * at[2] for i in range(3)]
    halves = [axes[a][i] / (scale if a < 2 or z is not None else F.lit(1.0)) for a in range(3) for i in range(3)]
    return F.array(*centre, *halves)


def subdivide_utm(extent: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """A tile of a UTM extent (minEasting, minNorthing, maxEasting, maxNorthing, vertical ...).

    z grows upward, so depths that are measured downward are split from their maximum.
    """
    scale = two_to(level).cast("double")
    wide, tall = (extent["maxEasting"] - extent["minEasting"]) / scale, (extent["maxNorthing"] - extent["minNorthing"]) / scale
    e, n = extent["minEasting"] + wide * x, extent["minNorthing"] + tall * y
    out = extent.withField("minEasting", e).withField("minNorthing", n).withField("maxEasting", e + wide).withField("maxNorthing", n + tall)
    if z is None:
        return out
    low, high, down = extent["vertical"]["minimum"], extent["vertical"]["maximum"], extent["vertical"]["direction"] == "DOWN"
    deep = (high - low) / scale
    off = deep * z
    out = out.withField("vertical.minimum", F.when(down, high - off - deep).otherwise(low + off))
    return out.withField("vertical.maximum", F.when(down, high - off).otherwise(low + off + deep))


def subdivide_sphere(sphere: Column) -> Column:
    """A sphere has no implicit tiles."""
    return F.raise_error(F.lit("implicit tiling needs a box, a region or a UTM extent")).cast("array<double>")


def implicit_error(root_error: Column, level: Column) -> Column:
    return root_error / two_to(level).cast("double")


# availability ----------------------------------------------------------------------------------------------------


def _bit(buffer: Column, start: Column, length: Column, index: Column) -> Column:
    """Bit `index` of the bytes of a view: the one byte it lies in is read, and nothing else is copied."""
    byte = F.conv(F.hex(F.substring(buffer, (start + F.call_function("div", index, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = (index >= 0) & (index < length * 8)
    bit = F.call_function("shiftright", byte, (index % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(inside, bit).otherwise(F.raise_error(F.concat(F.lit("availability bit "), index.cast("string"), F.lit(" is outside the buffer view"))).cast("boolean"))


def get_bit(buffer: Column, index: Column) -> Column:
    """Bit `index` of a binary, lowest bit of a byte first; beyond the end is an error."""
    return _bit(buffer, F.lit(0), F.octet_length(buffer), index)


def read_availability(availability: Column, views: Column, buffers: Column, index: Column) -> Column:
    """A bit of an availability struct (constant, bitstream): the constant wins; missing views or buffers are errors.

    views is an array of structs (buffer, byteOffset, byteLength), buffers an array of binaries.
    """
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    view = F.try_element_at(views, (availability["bitstream"] + 1).cast("int"))

    def looked_up(g: Column) -> Column:
        start = F.coalesce(g["view"]["byteOffset"], F.lit(0).cast("long"))
        return (
            F.when(g["buffer"].isNull(), fail("a buffer view references an unloaded buffer"))
            .when((start < 0) | (start + g["view"]["byteLength"] > F.octet_length(g["buffer"])), fail("a buffer view exceeds its buffer"))
            .otherwise(_bit(g["buffer"], start, g["view"]["byteLength"], g["index"]))
        )

    def found(v: Column) -> Column:
        buffer = F.try_element_at(buffers, (v["buffer"] + 1).cast("int"))
        return F.when(v.isNull(), fail("availability references a missing buffer view")).otherwise(let(F.struct(v.alias("view"), buffer.alias("buffer"), index.alias("index")), looked_up))

    return F.when(availability["constant"].isNotNull(), availability["constant"] == 1).when(availability["bitstream"].isNull(), fail("availability must have a constant or a bitstream")).otherwise(let(view, found))


def _at(level: Column, x: Column, y: Column, z: Column | None, index) -> Column:
    """index(level, x, y[, z]) of coordinates that are computed once."""
    fields = [level.cast("long").alias("level"), x.alias("x"), y.alias("y")] + ([] if z is None else [z.alias("z")])
    return let(F.struct(*fields), lambda c: index(c["level"], c["x"], c["y"], None if z is None else c["z"]))


def tile_available(subtree: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    return read_availability(subtree["tileAvailability"], subtree["bufferViews"], subtree["buffers"], _at(level, x, y, z, availability_index))


def content_available(subtree: Column, content: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """False where the subtree says nothing of that content."""
    own = F.try_element_at(subtree["contentAvailability"], (content + 1).cast("int"))
    return let(own, lambda a: F.when(a.isNull(), F.lit(False)).otherwise(read_availability(a, subtree["bufferViews"], subtree["buffers"], _at(level, x, y, z, availability_index))))


def child_subtree_available(subtree: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """By the Morton index alone: this bitstream has no levels."""
    return read_availability(subtree["childSubtreeAvailability"], subtree["bufferViews"], subtree["buffers"], _at(level, x, y, z, morton))
