"""Ellipsoids, UTM grids and heights as Column expressions.

Angles are radians.  Ellipsoids are axes of revolution (a, b); nothing is assumed about datum, geoid or terrain: what is
not given is an error or an unplaced extent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.spatial import Vec, bounds_of_points, let, widened

TAU = 2 * math.pi
HALF_PI = math.pi / 2

# UTM codes of the EPSG registry as (first, last, zone offset, hemisphere, datum).
EPSG_RANGES = (
    (32601, 32660, 32600, "N", "WGS 84"),
    (32701, 32760, 32700, "S", "WGS 84"),
    (26901, 26923, 26900, "N", "NAD83"),
    (25828, 25838, 25800, "N", "ETRS89"),
)
# The NAD83(CSRS) codes, which are not contiguous, and their zones.
CSRS_ZONES = {3154: 7, 3155: 8, 3156: 9, 3157: 10, 2955: 11, 2956: 12, 2957: 13, 3158: 14, 3159: 15, 3160: 16, 2958: 17, 2959: 18, 2960: 19, 2961: 20, 2962: 21, 3761: 22}


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    b: float

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2

    @property
    def minimum_radius(self) -> float:
        return min(self.a, self.b)


#: WGS 84, for callers who say so; no function takes it by default.
WGS84 = Ellipsoid(6378137.0, 6356752.314245179)


def to_ecef(latitude: Column, longitude: Column, height: Column, e: Ellipsoid) -> Vec:
    sin, cos = F.sin(latitude), F.cos(latitude)
    n = e.a / F.sqrt(1 - e.e2 * sin * sin)
    return Vec((n + height) * cos * F.cos(longitude), (n + height) * cos * F.sin(longitude), (n * (1 - e.e2) + height) * sin)


def to_geodetic(p: Vec, e: Ellipsoid, rounds: int = 5) -> Column:
    """Struct (latitude, longitude, height) of a point, by Bowring's latitude refined a fixed number of times."""
    ratio, second = e.b / e.a, (e.a / e.b) ** 2 - 1

    def solved(q: Column) -> Column:
        r, z = q["r"], q["z"]

        def latitude(beta: Column) -> Column:
            return F.atan2(z + second * e.b * F.pow(F.sin(beta), 3), r - e.e2 * e.a * F.pow(F.cos(beta), 3))

        lat = let(F.atan2(z, r * ratio), latitude)
        for _ in range(rounds if e.e2 else 0):
            lat = let(let(lat, lambda v: F.atan2(ratio * F.sin(v), F.cos(v))), latitude)

        def placed(v: Column) -> Column:
            sin, cos = F.sin(v), F.cos(v)
            root = 1 - e.e2 * sin * sin
            return F.struct(v.alias("latitude"), F.atan2(q["y"], q["x"]).alias("longitude"), (r * cos + z * sin - e.a * F.sqrt(root)).alias("height"))

        return let(lat, placed)

    return let(F.struct(F.sqrt(p.x * p.x + p.y * p.y).alias("r"), p.x.alias("x"), p.y.alias("y"), p.z.alias("z")), solved)


def vertical_frame_radial(radius: float):
    """Heights over a ball, along the radius: a function of a point that gives a struct (height, up)."""

    def frame(p: Vec) -> Column:
        length = p.length()
        some = F.when(length > 0, length).otherwise(F.lit(1.0))
        return F.struct((length - radius).alias("height"), Vec(*(a / some for a in p)).struct().alias("up"))

    return frame


def vertical_frame_geodetic(e: Ellipsoid):
    """Heights along the ellipsoid's normal."""

    def frame(p: Vec) -> Column:
        def upright(g: Column) -> Column:
            lat, lon = g["latitude"], g["longitude"]
            return F.struct(g["height"].alias("height"), Vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)).struct().alias("up"))

        return let(to_geodetic(p, e), upright)

    return frame


# regions ---------------------------------------------------------------------------------------------------------


def angle_within(angle: Column, west: Column, east: Column) -> Column:
    """Whether an angle lies in [west, east] modulo a full turn: it is no further east of west than east is.

    A full turn from -pi to pi has no span, so only the angle at its ends lies within; readers of the format agree on this.
    """
    eastward = lambda a: F.pmod(a - west, F.lit(TAU))
    return eastward(angle) <= eastward(east)


def bounds_of_region(region: Column, e: Ellipsoid) -> Column:
    """Bounds of west, south, east, north, lowest, highest: its corners, middles, cardinal meridians and the equator as samples."""
    west, south, east, north, low, high = (region[i] for i in range(6))
    middle = (west + F.when(east < west, east + TAU).otherwise(east)) / 2
    cardinal = [F.when(angle_within(F.lit(v), west, east), F.lit(v)) for v in (-math.pi, -HALF_PI, 0.0, HALF_PI, math.pi)]
    longitudes = F.array_compact(F.array(west, east, middle, *cardinal))
    latitudes = F.array_compact(F.array(south, north, (south + north) / 2, F.when((south <= 0) & (north >= 0), F.lit(0.0))))
    points = F.flatten(F.transform(longitudes, lambda lon: F.flatten(F.transform(latitudes, lambda lat: F.array(to_ecef(lat, lon, low, e).struct(), to_ecef(lat, lon, high, e).struct())))))
    return bounds_of_points(points)


# UTM -------------------------------------------------------------------------------------------------------------


def utm_from_epsg(epsg: Column) -> Column:
    """Struct (zone, hemisphere, datum, epsg) of a UTM code; null for any other."""

    def found(zone: Column, hemisphere: str, datum: str) -> Column:
        return F.struct(zone.cast("int").alias("zone"), F.lit(hemisphere).alias("hemisphere"), F.lit(datum).alias("datum"), epsg.cast("int").alias("epsg"))

    whole = epsg == F.floor(epsg)
    out = None
    for first, last, offset, hemisphere, datum in EPSG_RANGES:
        hit = whole & epsg.between(first, last)
        out = (out.when if out is not None else F.when)(hit, found(epsg - offset, hemisphere, datum))
    zone = F.try_element_at(F.create_map(*[F.lit(v) for kv in CSRS_ZONES.items() for v in kv]), F.when(whole, epsg).cast("int"))
    return out.when(zone.isNotNull(), found(zone, "N", "NAD83(CSRS)"))


def utm_resolve(extent: Column) -> Column:
    """The projection of an extent: that of a known code, else its zone and hemisphere if both are stated, else null."""
    none = F.lit(None).cast("string")
    stated = F.struct(extent["zone"].cast("int").alias("zone"), extent["hemisphere"].alias("hemisphere"), none.alias("datum"), extent["epsg"].cast("int").alias("epsg"))
    return F.coalesce(utm_from_epsg(extent["epsg"]), F.when(extent["zone"].isNotNull() & extent["hemisphere"].isNotNull(), stated))


def utm_to_geodetic(easting: Column, northing: Column, zone: Column, north: Column, e: Ellipsoid) -> Column:
    """Struct (latitude, longitude) by Krueger's series for the inverse transverse Mercator, to the fourth order in n."""
    n = (e.a - e.b) / (e.a + e.b)
    rectifying = e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    xi = (northing - F.when(north, F.lit(0.0)).otherwise(F.lit(1e7))) / (0.9996 * rectifying)
    eta = (easting - 5e5) / (0.9996 * rectifying)

    def conformal(v: Column) -> Column:
        x, y = v["xi"], v["eta"]
        for j, b in enumerate(beta, 1):
            x = x - b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            y = y - b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct(x.alias("xi"), y.alias("eta"))

    def sphere(v: Column) -> Column:
        return F.struct(F.asin(F.sin(v["xi"]) / F.cosh(v["eta"])).alias("chi"), F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])).alias("east"))

    def latitude(v: Column) -> Column:
        out = v["chi"]
        for j, d in enumerate(delta, 1):
            out = out + d * F.sin(2 * j * v["chi"])
        return F.struct(out.alias("latitude"), ((zone * 6 - 183) * (math.pi / 180) + v["east"]).alias("longitude"))

    return let(let(let(F.struct(xi.alias("xi"), eta.alias("eta")), conformal), sphere), latitude)


@dataclass(frozen=True)
class UtmPlacement:
    """What an application says about datums, geoid and terrain.

    accuracies: metres by datum name ("" for extents whose datum is unknown); datums that are not named are not placed.
    ellipsoids: by datum name, where it is not the body's.  geoid: (latitude, longitude) -> undulation Column.
    """

    accuracies: dict[str, float] = field(default_factory=dict)
    ellipsoids: dict[str, Ellipsoid] = field(default_factory=dict)
    geoid_margin: float | None = None
    geoid: object = None
    unknown_ground: tuple[float, float] | None = None


def upward_interval(vertical: Column) -> tuple[Column, Column]:
    """(low, high) measured upward: depths that count downward are negative heights.  Ends are taken as they are given: a null or reversed end stays so."""
    down = vertical["direction"] == "DOWN"
    return F.when(down, -vertical["maximum"]).otherwise(vertical["minimum"]), F.when(down, -vertical["minimum"]).otherwise(vertical["maximum"])


def vertical_model(vertical: Column, rules: UtmPlacement) -> dict[str, Column]:
    """origin, low, high and orthometric of a vertical extent; unknown ground without an envelope is an error."""
    kind, ground, envelope = vertical["reference"], vertical["groundElevation"], rules.unknown_ground
    if envelope is not None and all(map(math.isfinite, envelope)) and envelope[0] <= envelope[1]:
        terrain = [F.lit(float(v)) for v in envelope]
    else:
        terrain = [F.raise_error(F.lit("a terrain height envelope must be given")).cast("double")] * 2
    zero = F.lit(0.0)
    # what heights are counted from: its name, when it applies, the lowest and highest it may lie, whether it is a height over the geoid
    origins = (
        ("ellipsoid", kind == "ELLIPSOID", zero, zero, False),
        ("geoid", kind == "GEOID", zero, zero, True),
        ("ground-elevation", (kind == "GROUND") & ground.isNotNull(), ground, ground, True),
        ("assumed-terrain", F.lit(True), *terrain, False),
    )
    first = lambda of: F.coalesce(*[F.when(o[1], of(o)) for o in origins])
    low, high = upward_interval(vertical)
    return {"origin": first(lambda o: F.lit(o[0])), "low": low + first(lambda o: o[2]), "high": high + first(lambda o: o[3]), "orthometric": first(lambda o: F.lit(o[4]))}


def _geoid_margin(rules: UtmPlacement) -> Column:
    m = rules.geoid_margin
    if m is None or not math.isfinite(m) or m < 0:
        return F.raise_error(F.lit("a geoid margin of zero or more, or a geoid model, must be given")).cast("double")
    return F.lit(float(m))


def ellipsoidal_height_range(vertical: Column, rules: UtmPlacement) -> Column:
    """[lowest, highest] over the ellipsoid, heights over the geoid widened by the margin."""
    model = vertical_model(vertical, rules)
    margin = F.when(model["orthometric"], _geoid_margin(rules)).otherwise(F.lit(0.0))
    return F.array(model["low"] - margin, model["high"] + margin)


def bounds_of_utm(extent: Column, e: Ellipsoid, rules: UtmPlacement) -> Column:
    """Struct (status, bounds, zone, hemisphere, datum, origin, horizontal_margin, vertical_margin, low, high).

    status is placed, unresolved-projection or unresolved-datum; only placed extents have bounds: those of a grid of
    three by three samples at both heights, widened by the datum's accuracy.
    """
    table = F.create_map(*[F.lit(v) for k, a in rules.accuracies.items() for v in (k, float(a))]) if rules.accuracies else None

    def with_projection(p: Column) -> Column:
        datum = F.coalesce(p["datum"], F.lit(""))
        accuracy = F.try_element_at(table, datum) if table is not None else F.lit(None).cast("double")
        placed = p["zone"].isNotNull() & accuracy.isNotNull()
        model = vertical_model(extent["vertical"], rules)
        margin = F.when(model["orthometric"], F.lit(0.0) if rules.geoid else _geoid_margin(rules)).otherwise(F.lit(0.0))
        fields = {"zone": p["zone"], "hemisphere": p["hemisphere"], "datum": p["datum"], "accuracy": accuracy, "placed": placed}
        # heights are looked at only where the extent is placed: what they lack is no error elsewhere
        fields |= {"origin": F.when(placed, model["origin"]), "margin": F.when(placed, margin), "low": F.when(placed, model["low"]), "high": F.when(placed, model["high"]), "over_geoid": F.when(placed, model["orthometric"])}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    def report(g: Column) -> Column:
        low, high = g["low"] - g["margin"], g["high"] + g["margin"]

        def sample(k: Column, source: Ellipsoid) -> Column:
            i, j = F.floor(k / 3) / 2, (k % 3) / 2
            easting = extent["minEasting"] + (extent["maxEasting"] - extent["minEasting"]) * i
            northing = extent["minNorthing"] + (extent["maxNorthing"] - extent["minNorthing"]) * j

            def both(at: Column) -> Column:
                up = F.when(g["over_geoid"], rules.geoid(at["latitude"], at["longitude"])).otherwise(F.lit(0.0)) if rules.geoid else F.lit(0.0)
                return F.array(*[to_ecef(at["latitude"], at["longitude"], h + up, e).struct() for h in (low, high)])

            return let(utm_to_geodetic(easting, northing, g["zone"], g["hemisphere"] == "N", source), both)

        grid = lambda source: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: sample(k, source)))
        points = grid(e)
        for name, source in rules.ellipsoids.items():
            points = F.when(F.coalesce(g["datum"], F.lit("")) == name, grid(source)).otherwise(points)
        return F.struct(
            F.when(g["zone"].isNull(), "unresolved-projection").when(~g["placed"], "unresolved-datum").otherwise("placed").alias("status"),
            F.when(g["placed"], widened(bounds_of_points(points), g["accuracy"])).alias("bounds"),
            g["zone"].alias("zone"),
            g["hemisphere"].alias("hemisphere"),
            g["datum"].alias("datum"),
            g["origin"].alias("origin"),
            F.coalesce(F.when(g["placed"], g["accuracy"]), F.lit(0.0)).alias("horizontal_margin"),
            F.coalesce(g["margin"], F.lit(0.0)).alias("vertical_margin"),
            low.alias("low"),
            high.alias("high"),
        )

    resolved = utm_resolve(extent)
    flat = let(F.struct(resolved.alias("p")), lambda r: F.struct(*[r["p"][c].alias(c) for c in ("zone", "hemisphere", "datum", "epsg")]))
    return let(let(flat, with_projection), report)
