"""Geometry in earth-centred metres as Column expressions: transforms, bounds, culling, screen-space error, view figures.

Points are `Vec`s of three Columns; matrices are lists of sixteen Columns (or one array Column taken apart), column by
column.  Bounds are structs (min, max, center, radius).  Nothing here leaves generated code.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEWPORT_HEIGHT, VERTICAL_FOV = 1080.0, math.pi / 3
IDENTITY = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a Column is a tree, so a value used twice would be written out twice."""
    return F.transform(F.array(value), use)[0]


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, struct: Column) -> Vec:
        return cls(struct["x"], struct["y"], struct["z"])

    @classmethod
    def lit(cls, x: float, y: float, z: float) -> Vec:
        return cls(*(F.lit(float(v)) for v in (x, y, z)))

    def plus(self, o: Vec) -> Vec:
        return Vec(*(a + b for a, b in zip(self, o)))

    def minus(self, o: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self, o)))

    def times(self, k: Column | float) -> Vec:
        return Vec(*(a * k for a in self))

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


# transforms ------------------------------------------------------------------------------------------------------


def matrix_of(transform: Column) -> list[Column]:
    """The sixteen numbers of a transform; the identity where it is null."""
    return [F.coalesce(transform[i], F.lit(float(IDENTITY[i]))) for i in range(16)]


def multiply(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """a times b, both column by column."""
    return [reduce(lambda s, t: s + t, (a[k * 4 + r] * b[c * 4 + k] for k in range(4))) for c in range(4) for r in range(4)]


def transform_point(m: Sequence[Column], p: Vec) -> Vec:
    return Vec(*(m[r] * p.x + m[4 + r] * p.y + m[8 + r] * p.z + m[12 + r] for r in range(3)))


def transform_vector(m: Sequence[Column], v: Vec) -> Vec:
    return Vec(*(m[r] * v.x + m[4 + r] * v.y + m[8 + r] * v.z for r in range(3)))


def max_scale(m: Sequence[Column]) -> Column:
    """The greatest length of a matrix's first three columns."""
    return F.greatest(*[Vec(*m[4 * c : 4 * c + 3]).length() for c in range(3)])


# bounds ----------------------------------------------------------------------------------------------------------


def bounds(low: Vec, high: Vec, centre: Vec, radius: Column) -> Column:
    return F.struct(low.struct().alias("min"), high.struct().alias("max"), centre.struct().alias("center"), radius.alias("radius"))


def bounds_of_box(box: Column, m: Sequence[Column]) -> Column:
    """Centre and half axes under a transform: the box around it, and the sphere through its farthest corner."""
    centre = transform_point(m, Vec(box[0], box[1], box[2]))
    a, b, c = (transform_vector(m, Vec(box[i], box[i + 1], box[i + 2])) for i in (3, 6, 9))
    reach = Vec(*(F.abs(i) + F.abs(j) + F.abs(k) for i, j, k in zip(a, b, c)))
    # opposite corners are equally far: four of the eight suffice
    radius = F.greatest(*[a.plus(b.times(s)).plus(c.times(t)).length() for s in (-1, 1) for t in (-1, 1)])
    return bounds(centre.minus(reach), centre.plus(reach), centre, radius)


def bounds_of_sphere(sphere: Column, m: Sequence[Column]) -> Column:
    centre = transform_point(m, Vec(sphere[0], sphere[1], sphere[2]))
    radius = sphere[3] * max_scale(m)
    reach = Vec(radius, radius, radius)
    return bounds(centre.minus(reach), centre.plus(reach), centre, radius)


def bounds_of_points(points: Column) -> Column:
    """The bounds of an array of structs (x, y, z): the box, and the sphere about its middle to the farthest point."""

    def ends(some: Column) -> Column:
        axis = lambda name: F.transform(some, lambda p: p[name])
        low, high = (Vec(*(f(axis(name)) for name in "xyz")) for f in (F.array_min, F.array_max))
        return F.struct(low.struct().alias("low"), high.struct().alias("high"), some.alias("points"))

    def around(e: Column) -> Column:
        low, high = Vec.of(e["low"]), Vec.of(e["high"])
        centre = low.plus(high).times(0.5)
        return bounds(low, high, centre, F.array_max(F.transform(e["points"], lambda p: Vec.of(p).minus(centre).length())))

    return let(let(points, ends), around)


def widened(b: Column, margin: Column | float) -> Column:
    """Bounds grown on all sides; margins of zero or less change nothing."""
    m = F.greatest(F.lit(float(margin)) if isinstance(margin, (int, float)) else margin, F.lit(0.0))

    def grown(g: Column) -> Column:
        own, reach = g["b"], Vec(g["m"], g["m"], g["m"])
        return bounds(Vec.of(own["min"]).minus(reach), Vec.of(own["max"]).plus(reach), Vec.of(own["center"]), own["radius"] + g["m"])

    return let(F.struct(b.alias("b"), m.alias("m")), grown)


# culling ---------------------------------------------------------------------------------------------------------


def boxes_intersect(a_min: Vec, a_max: Vec, b_min: Vec, b_max: Vec) -> Column:
    """Closed boxes: touching counts."""
    return reduce(lambda s, t: s & t, [(ah >= bl) & (al <= bh) for al, ah, bl, bh in zip(a_min, a_max, b_min, b_max)])


def outside_plane(centre: Vec, radius: Column, plane: Column) -> Column:
    """A sphere that lies wholly behind a plane struct (x, y, z, w)."""
    return plane["x"] * centre.x + plane["y"] * centre.y + plane["z"] * centre.z + plane["w"] < -radius


def below_horizon_plane(centre: Vec, radius: Column, camera: Vec, occluder: Column | float) -> Column:
    """Conservative: a sphere beyond the tangent plane of the occluding ball; never for a camera inside it."""
    far = camera.length()
    ball = F.lit(float(occluder)) if isinstance(occluder, (int, float)) else occluder
    return (far > ball) & (centre.dot(camera) + radius * far < ball * ball)


def _one(ratio: Column) -> Column:
    """A sine or cosine, held to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))


def beyond_horizon(centre: Vec, radius: Column, camera: Vec, body: Column | float, lowest_terrain: Column | float, low: Column | None = None, high: Column | None = None) -> Column:
    """Whether nothing of a tile rises over the horizon of a ball that no terrain reaches below.

    low and high are the tile's heights over the body's radius; where they are null, those of its sphere count.  A camera inside the
    ball, or a tile around its centre, hides nothing.
    """
    number = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else v
    height = lambda measured, otherwise: otherwise if measured is None else F.coalesce(number(body) + measured, otherwise)
    to_tile, to_camera = centre.length(), camera.length()
    foot, summit = height(low, to_tile - radius), height(high, to_tile + radius)
    ball = F.least(number(body), number(body) + number(lowest_terrain), foot)
    # a line of sight that touches the ball has covered one arc since the camera and covers another up to the summit
    camera_arc, summit_arc = F.acos(ball / to_camera), F.acos(ball / F.greatest(ball, summit))
    apart = F.atan2(centre.cross(camera).length(), centre.dot(camera))
    has_horizon = (ball > 0) & (ball < to_camera) & (radius < to_tile)
    return F.coalesce(has_horizon & (apart - F.asin(radius / to_tile) > camera_arc + summit_arc), F.lit(False))


def inside_view(b: Column, camera: Column, planes: Column, occluder: Column | float | None = None) -> Column:
    """Whether bounds may be seen: the camera's clip box, then the horizon, then the planes.

    camera is a struct (position, clip_min, clip_max ...); null bounds are never culled, null clip boxes and planes cull nothing.
    """
    centre, radius = Vec.of(b["center"]), b["radius"]
    clipped = camera["clip_min"].isNotNull() & ~boxes_intersect(Vec.of(b["min"]), Vec.of(b["max"]), Vec.of(camera["clip_min"]), Vec.of(camera["clip_max"]))
    hidden = F.lit(False) if occluder is None else below_horizon_plane(centre, radius, Vec.of(camera["position"]), occluder)
    behind = F.exists(planes, lambda p: outside_plane(centre, radius, p))
    return F.coalesce(b.isNull() | ~(F.coalesce(clipped, F.lit(False)) | hidden | F.coalesce(behind, F.lit(False))), F.lit(True))


def in_periphery(b: Column, camera: Column, planes: Column, occluder: Column | float | None = None) -> Column:
    """The same test with the wider planes; false without them."""
    return planes.isNotNull() & inside_view(b, camera, planes, occluder)


# what a pixel covers ---------------------------------------------------------------------------------------------


def metres_per_pixel(distance: Column, viewport: Column | None = None, fov: Column | None = None, tan_half: Column | None = None, *, viewport_default=VIEWPORT_HEIGHT, fov_default=VERTICAL_FOV) -> Column:
    """Ground length of a pixel at a distance; NaN where the field of view is not in (0, pi)."""
    none = F.lit(None).cast("double")
    height = F.when(viewport > 0, viewport).otherwise(F.lit(viewport_default)) if viewport is not None else F.lit(viewport_default)
    tan = F.coalesce(none if tan_half is None else tan_half, F.tan(F.coalesce(none if fov is None else fov, F.lit(fov_default)) / 2))
    usable = (tan > 0) & (tan < float("inf")) & ~F.isnan(tan)
    return F.when(usable, 2 * tan * distance / height).otherwise(F.lit(float("nan")))


def screen_space_error(error: Column, b: Column, camera: Vec, **view) -> Column:
    """Pixels that a tile's error spans, at the distance from the camera to its sphere's surface.

    0 for errors of zero or less, infinite where a pixel has no size; tiles without bounds are as far as the origin.
    """
    gap = F.when(b.isNull(), camera.length()).otherwise(camera.minus(Vec.of(b["center"])).length() - b["radius"])
    pixel = metres_per_pixel(F.greatest(gap, F.lit(sys.float_info.epsilon)), **view)
    return F.when(error <= 0, F.lit(0.0)).when(F.isnan(pixel) | (pixel <= 0), F.lit(float("inf"))).otherwise(F.try_divide(error, pixel))


def ray_sphere(origin: Vec, direction: Vec, radius: Column) -> Column:
    """The nearest distance of zero or more at which a unit ray meets a ball about the origin; null if it does not.

    The ray passes the centre at its nearest point; the ball cuts half a chord off on either side of that.
    """
    nearest = -origin.dot(direction)
    square = radius * radius - (origin.dot(origin) - nearest * nearest)
    half = F.sqrt(F.when(square >= 0, square))
    return F.when(nearest >= half, nearest - half).when(nearest + half >= 0, nearest + half)


def local_frame(up: Vec) -> tuple[Vec, Vec, Vec]:
    """(east, north, up) as unit vectors: east is square to the axis of rotation; at a pole it is that of longitude 0."""
    across = F.sqrt(up.x * up.x + up.y * up.y)
    east = Vec(F.coalesce(F.try_divide(-up.y, across), F.lit(0.0)), F.coalesce(F.try_divide(up.x, across), F.lit(1.0)), F.lit(0.0))
    return east, up.cross(east), up


def describe_view(position: Vec, up: Vec, height: Column, forward: Vec | None = None, ground: Column | None = None, target: Column | None = None, **view) -> Column:
    """Latitude, longitude, height, altitude, heading, pitch (degrees), target distance and metres per pixel of a camera.

    up and height come from a vertical frame (vertical_frame_*).  The direction of view is turned into the local frame of east, north and
    up; its components are the heading and the pitch.  What is looked at is, unless given, where the line of sight meets the ball through the
    ground below the camera.  Figures that cannot be told are null.
    """
    none = F.lit(None).cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    look = forward if forward is not None else Vec(none, none, none)
    given = {"position": position.struct(), "up": up.struct(), "look": look.struct(), "length": look.length(), "height": height, "altitude": height - finite(ground) if ground is not None else none, "target": target if target is not None else none}

    def turned(g: Column) -> Column:
        direction = Vec(*(F.when(g["length"] > 0, F.try_divide(a, g["length"])) for a in Vec.of(g["look"])))
        local = Vec(*(axis.dot(direction) for axis in local_frame(Vec.of(g["up"]))))
        return F.struct(g.alias("given"), direction.struct().alias("direction"), local.struct().alias("local"))

    def sighted(t: Column) -> Column:
        g, direction = t["given"], Vec.of(t["direction"])
        foot = Vec.of(g["position"]).minus(Vec.of(g["up"]).times(F.coalesce(g["altitude"], g["height"])))
        reach = finite(F.coalesce(g["target"], ray_sphere(Vec.of(g["position"]), direction, foot.length())))
        return F.struct(t["given"].alias("given"), t["local"].alias("local"), F.when(direction.x.isNotNull() & (reach > 0), reach).alias("reach"))

    def figures(s: Column) -> Column:
        g, local, top = s["given"], Vec.of(s["local"]), Vec.of(s["given"]["up"])
        level = F.sqrt(local.x * local.x + local.y * local.y)
        pixel = metres_per_pixel(s["reach"], **view)
        return F.struct(
            F.degrees(F.asin(_one(top.z))).alias("latitude"),
            F.degrees(F.atan2(top.y, top.x)).alias("longitude"),
            g["height"].alias("height"),
            g["altitude"].alias("altitude"),
            F.when(level > 0, F.pmod(F.degrees(F.atan2(local.x, local.y)), F.lit(360.0))).alias("heading"),
            F.degrees(F.asin(_one(local.z))).alias("pitch"),
            s["reach"].alias("target_distance"),
            F.when((pixel > 0) & ~F.isnan(pixel), pixel).alias("metres_per_pixel"),
        )

    return let(let(let(F.struct(*[c.alias(k) for k, c in given.items()]), turned), sighted), figures)


# vertical scale --------------------------------------------------------------------------------------------------


def vertical_displacement(anchor: Vec, height: Column, up: Vec, scale: Column | float) -> Vec:
    """How far a vertical scale moves an anchor: its height times (scale - 1), upward; the body's centre does not move."""
    factor = (F.lit(float(scale)) if isinstance(scale, (int, float)) else scale) - 1
    still = anchor.x.isNull() | ((anchor.x == 0) & (anchor.y == 0) & (anchor.z == 0)) | (factor == 0)
    return Vec(*(F.when(still, F.lit(0.0)).otherwise(u * height * factor) for u in up))


def place_vertically(b: Column, placed_object: Vec, frame, scale: Column | float) -> Column:
    """Bounds under a vertical scale.

    placed_object is the first position from the root down to the tile (nulls: none): such a tile moves rigidly
    with it.  Other tiles move with their centre and grow by radius times |scale - 1|.  frame(point) gives a struct (height, up).
    """
    factor = (F.lit(float(scale)) if isinstance(scale, (int, float)) else scale) - 1
    is_object = placed_object.x.isNotNull()
    anchor = Vec(*(F.when(is_object, o).otherwise(c) for o, c in zip(placed_object, Vec.of(b["center"])))).struct()

    def shift(a: Column) -> Column:
        return let(frame(Vec.of(a)), lambda f: vertical_displacement(Vec.of(a), f["height"], Vec.of(f["up"]), scale).struct())

    def moved(g: Column) -> Column:
        own, by = g["b"], Vec.of(g["by"])
        margin = F.when(g["object"], F.lit(0.0)).otherwise(own["radius"] * F.abs(factor))
        reach = Vec(margin, margin, margin)
        return bounds(Vec.of(own["min"]).plus(by).minus(reach), Vec.of(own["max"]).plus(by).plus(reach), Vec.of(own["center"]).plus(by), own["radius"] + margin)

    return let(F.struct(b.alias("b"), let(anchor, shift).alias("by"), is_object.alias("object")), moved)
