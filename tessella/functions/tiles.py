"""Names of tiles and web map addresses as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.implicit import two_to

#: Metres around the globe on the web map grid.
WEB_EQUATOR = 2 * math.pi * 6378137.0


def tile_id(parent: Column, segment: Column) -> Column:
    return F.concat(parent, F.lit("/"), segment.cast("string"))


def content_id(tile: Column, index: Column) -> Column:
    return F.concat(tile, F.lit("/content-"), index.cast("string"))


def subtree_key(context: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    last = F.coalesce(z, F.lit(0)) if z is not None else F.lit(0)
    return F.concat_ws(":", F.lit("subtree"), context, *[c.cast("string") for c in (level, x, y, last)])


def quadtree_key(namespace: Column, lod: Column, x: Column, y: Column, face: Column | None = None) -> Column:
    """namespace, then face (left out where null or 0), lod, x and y parted by slashes."""
    own = F.concat_ws("/", *([] if face is None else [F.when(F.coalesce(face, F.lit(0)) != 0, face.cast("string"))]), lod.cast("string"), x.cast("string"), y.cast("string"))
    return F.concat(namespace, own)


def address_of(level: Column, x: Column, y: Column, root_lod: Column, root_x: Column, root_y: Column) -> tuple[Column, Column, Column]:
    """(lod, x, y) in the pyramid of an implicit tile below a root: implicit rows grow north, the pyramid's south."""
    scale = two_to(level)
    return root_lod + level, root_x * scale + x, root_y * scale + (scale - 1 - y)


def web_corner(lod: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in radians of a web map tile's north-west corner."""
    n = two_to(lod).cast("double")
    return F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n))), x / n * (2 * math.pi) - math.pi


def web_ground_resolution(latitude: Column, lod: Column, tile_pixels: int = 256) -> Column:
    """Metres of a pixel on the web map."""
    return F.cos(latitude) * WEB_EQUATOR / (two_to(lod) * tile_pixels)
