import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import geodesy as G
from tessella.functions import spatial as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def point(p):
    return (p["x"], p["y"], p["z"])


def identity():
    return [F.lit(float(v)) for v in S.IDENTITY]


MARS = G.Ellipsoid(3_396_190.0, 3_376_200.0)


def test_sphere_under_transform(spark):
    scaled = [F.lit(float(v)) for v in (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 10, 20, 30, 1)]
    b = one(spark, b=S.bounds_of_sphere(arr(1, 2, 3, 4), scaled), k=S.max_scale(scaled))
    assert point(b["b"]["center"]) == (12, 24, 36) and b["b"]["radius"] == 8
    assert point(b["b"]["min"]) == (4, 16, 28) and point(b["b"]["max"]) == (20, 32, 44)
    assert 5 * b["k"] == 10


def test_matrices(spark):
    rng = random.Random(3)
    a, b = ([rng.uniform(-2, 2) for _ in range(16)] for _ in range(2))
    m = one(spark, m=F.array(*S.multiply([F.lit(v) for v in a], [F.lit(v) for v in b])))["m"]
    for c in range(4):
        for r in range(4):
            assert m[c * 4 + r] == pytest.approx(sum(a[k * 4 + r] * b[c * 4 + k] for k in range(4)))
    r = one(spark, i=F.array(*S.matrix_of(F.lit(None).cast("array<double>"))))
    assert tuple(r["i"]) == S.IDENTITY


def test_box_bounds(spark):
    b = one(spark, b=S.bounds_of_box(arr(1, 2, 3, 1, 1, 0, -2, 2, 0, 0, 0, 3), identity()))["b"]
    assert point(b["max"]) == (4, 5, 6) and b["radius"] == pytest.approx(math.sqrt(9 + 1 + 9))


def test_screen_space_error_and_clip(spark):
    b = S.bounds_of_sphere(arr(0, 0, 0, 1), identity())
    camera = F.struct(S.Vec.lit(11, 0, 0).struct().alias("position"), S.Vec.lit(100, 100, 100).struct().alias("clip_min"), S.Vec.lit(101, 101, 101).struct().alias("clip_max"))
    planes = F.lit(None).cast("array<struct<x: double, y: double, z: double, w: double>>")
    sse = lambda error, tan: S.screen_space_error(F.lit(error), b, S.Vec.lit(11, 0, 0), viewport=F.lit(1000.0), tan_half=F.lit(tan))
    r = one(spark, s=sse(2.0, 1.0), zero=sse(0.0, 1.0), far=sse(2.0, -1.0), v=S.inside_view(b, camera, planes))
    assert r["s"] == pytest.approx(100) and r["zero"] == 0 and r["far"] == math.inf and not r["v"]


def test_planes_and_periphery(spark):
    b = S.bounds(S.Vec.lit(100, 0, 0), S.Vec.lit(100, 0, 0), S.Vec.lit(100, 0, 0), F.lit(0.0))
    camera = F.struct(S.Vec.lit(0, 0, 0).struct().alias("position"), F.lit(None).cast("struct<x: double, y: double, z: double>").alias("clip_min"), F.lit(None).cast("struct<x: double, y: double, z: double>").alias("clip_max"))
    below = lambda x: F.array(F.struct(F.lit(-1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(float(x)).alias("w")))
    none = F.lit(None).cast("array<struct<x: double, y: double, z: double, w: double>>")
    r = one(spark, v=S.inside_view(b, camera, below(50)), p=S.in_periphery(b, camera, below(200)), n=S.in_periphery(b, camera, none), all=S.inside_view(b, camera, none))
    assert (r["v"], r["p"], r["n"], r["all"]) == (False, True, False, True)


def test_aabb_touching_counts(spark):
    hit = lambda x: S.boxes_intersect(S.Vec.lit(0, 0, 0), S.Vec.lit(1, 1, 1), S.Vec.lit(x, 0, 0), S.Vec.lit(x + 1, 1, 1))
    r = one(spark, a=hit(1), b=hit(1.01), c=hit(-1))
    assert (r["a"], r["b"], r["c"]) == (True, False, True)


def test_horizons(spark):
    R = 1_738_100.0
    camera = S.Vec.lit(R + 50, 0, 0)

    def at(angle, height, radius=10.0):
        return S.Vec.lit((R + height) * math.cos(angle), (R + height) * math.sin(angle), 0), F.lit(radius)

    def hidden(angle, height, lowest=0.0, low=None, high=None):
        c, r = at(angle, height)
        return S.beyond_horizon(c, r, camera, R, lowest, F.lit(float(low)) if low is not None else None, F.lit(float(high)) if high is not None else None)

    reach = math.acos(R / (R + 50))
    r = one(spark, near=hidden(0.5 * reach, 0), far=hidden(3 * reach, 0), summit=hidden(3 * reach, 0, 0.0, 0, 10_000), deep=hidden(3 * reach, 0, -20_000.0), plane_far=S.below_horizon_plane(*at(3 * reach, 0), camera, R), plane_near=S.below_horizon_plane(*at(0.5 * reach, 0), camera, R), inside=S.below_horizon_plane(*at(3 * reach, 0), S.Vec.lit(R / 2, 0, 0), R))
    assert (r["near"], r["far"], r["summit"], r["deep"]) == (False, True, False, False)
    assert (r["plane_far"], r["plane_near"], r["inside"]) == (True, False, False)


def test_view_description(spark):
    R = 1000.0
    frame = G.vertical_frame_radial(R)

    def view(position, forward, ground=None):
        p = S.Vec.lit(*position)
        f = frame(p)
        return S.describe_view(p, S.Vec.of(f["up"]), f["height"], S.Vec.lit(*forward), F.lit(ground) if ground is not None else None, viewport=F.lit(1000.0), tan_half=F.lit(1.0))

    r = one(spark, down=view((R + 5000, 0, 0), (-1, 0, 0), 1000.0), **{d: view((0, R + 100, 0), f) for d, f in {"n": (0, -1, 1), "e": (-1, -1, 0), "s": (0, -1, -1), "w": (1, -1, 0)}.items()})
    d = r["down"]
    assert d["pitch"] == pytest.approx(-90) and d["heading"] is None and d["target_distance"] == pytest.approx(4000) and d["metres_per_pixel"] == pytest.approx(8)
    assert d["altitude"] == pytest.approx(4000)
    for k, want in {"n": 0, "e": 90, "s": 180, "w": 270}.items():
        assert r[k]["heading"] == pytest.approx(want, abs=1e-9) and r[k]["pitch"] == pytest.approx(-45) and r[k]["longitude"] == pytest.approx(90)


def test_metres_per_pixel_without_field_of_view(spark):
    r = one(spark, bad=S.metres_per_pixel(F.lit(10.0), fov=F.lit(-1.0)), fine=S.metres_per_pixel(F.lit(1080.0)))
    assert math.isnan(r["bad"]) and r["fine"] == pytest.approx(2 * math.tan(math.pi / 6))


def test_ecef_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-1.57, 1.57), rng.uniform(-3.14, 3.14), rng.uniform(-5000, 9000)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lat double, lon double, h double")
    for e in (G.WGS84, MARS, G.Ellipsoid(1000.0, 1000.0)):
        back = G.to_geodetic(G.to_ecef(F.col("lat"), F.col("lon"), F.col("h") / 1e6 * e.a, e), e)
        for r in df.select("lat", "lon", (F.col("h") / 1e6 * e.a).alias("h"), back.alias("g")).collect():
            g = r["g"]
            assert g["latitude"] == pytest.approx(r["lat"], abs=1e-10) and g["longitude"] == pytest.approx(r["lon"], abs=1e-12) and g["height"] == pytest.approx(r["h"], abs=1e-4)


def test_regions(spark):
    small = arr(-0.01, -0.01, 0.01, 0.01, 0, 0)
    r = one(spark, p=G.bounds_of_region(arr(0, 0, 0, 0, 0, 0), MARS), a=G.bounds_of_region(small, G.Ellipsoid(1000, 1000)), b=G.bounds_of_region(small, G.Ellipsoid(2000, 2000)), turn=G.angle_within(F.lit(0.0), F.lit(-math.pi), F.lit(math.pi)), half=G.angle_within(F.lit(0.0), F.lit(-1.0), F.lit(1.0)))
    assert point(r["p"]["center"]) == (MARS.a, 0, 0) and r["p"]["radius"] == 0
    assert r["b"]["radius"] == pytest.approx(2 * r["a"]["radius"]) and r["b"]["center"]["x"] == pytest.approx(2 * r["a"]["center"]["x"])
    assert r["turn"] is False and r["half"] is True


def test_utm_codes(spark):
    codes = {26918: ("NAD83", 18, "N"), 2959: ("NAD83(CSRS)", 18, "N"), 32631: ("WGS 84", 31, "N"), 32718: ("WGS 84", 18, "S"), 25832: ("ETRS89", 32, "N"), 26718: None}
    for code, want in codes.items():
        got = one(spark, u=G.utm_from_epsg(F.lit(float(code))))["u"]
        assert (got and (got["datum"], got["zone"], got["hemisphere"])) == want


def test_inverse_mercator_at_known_points(spark):
    # the central meridian, the equator, and a place whose coordinates are widely published
    zero = G.utm_to_geodetic(F.lit(500000.0), F.lit(0.0), F.lit(31), F.lit(True), G.WGS84)
    tower = G.utm_to_geodetic(F.lit(448251.795), F.lit(5411932.678), F.lit(31), F.lit(True), G.WGS84)
    r = one(spark, z=zero, t=tower)
    assert r["z"]["latitude"] == pytest.approx(0) and math.degrees(r["z"]["longitude"]) == pytest.approx(3)
    assert math.degrees(r["t"]["latitude"]) == pytest.approx(48.8582, abs=1e-4) and math.degrees(r["t"]["longitude"]) == pytest.approx(2.2945, abs=1e-4)


EXTENT = '{"epsg":%s,"zone":null,"hemisphere":null,"minEasting":400000,"minNorthing":5000000,"maxEasting":401000,"maxNorthing":5001000,"vertical":{"reference":"%s","direction":"%s","minimum":10,"maximum":20,"groundElevation":%s}}'
KIND = "epsg int, zone int, hemisphere string, minEasting double, minNorthing double, maxEasting double, maxNorthing double, vertical struct<reference: string, direction: string, minimum: double, maximum: double, groundElevation: double>"


def extent(epsg=26918, reference="GEOID", direction="UP", ground="null"):
    return F.from_json(F.lit(EXTENT % (epsg, reference, direction, ground)), KIND)


def test_heights(spark):
    rules = G.UtmPlacement(geoid_margin=3, unknown_ground=(-500, 9000))
    rng = lambda e, r=rules: one(spark, h=G.ellipsoidal_height_range(e["vertical"], r))["h"]
    assert rng(extent()) == [7, 23]
    assert rng(extent(reference="GROUND", direction="DOWN", ground="100")) == [77, 93]
    assert rng(extent(reference="LOCAL")) == [-490, 9020] and rng(extent(reference="ELLIPSOID")) == [10, 20]
    with pytest.raises(Exception, match="geoid"):
        rng(extent(), G.UtmPlacement())
    with pytest.raises(Exception, match="envelope"):
        rng(extent(reference="LOCAL"), G.UtmPlacement())


def test_utm_bounds(spark):
    rules = G.UtmPlacement(accuracies={"NAD83": 4.0}, geoid_margin=3)
    r = one(spark, b=G.bounds_of_utm(extent(), G.WGS84, rules), d=G.bounds_of_utm(extent(epsg=32618), G.WGS84, rules), p=G.bounds_of_utm(extent(epsg=999), G.WGS84, rules))
    assert (r["b"]["status"], r["d"]["status"], r["p"]["status"]) == ("placed", "unresolved-datum", "unresolved-projection")
    assert r["d"]["bounds"] is None and r["b"]["low"] == 7 and r["b"]["horizontal_margin"] == 4
    assert r["b"]["bounds"]["radius"] == pytest.approx(math.hypot(500, 500) + 4, rel=0.02)


def test_vertical_scale(spark):
    R = 1_737_400.0
    frame = G.vertical_frame_radial(R)
    b = S.bounds(S.Vec.lit(R + 990, -10, -10), S.Vec.lit(R + 1010, 10, 10), S.Vec.lit(R + 1000, 0, 0), F.lit(10.0))
    whole = S.bounds(S.Vec.lit(-2 * R, 0, 0), S.Vec.lit(2 * R, 0, 0), S.Vec.lit(0, 0, 0), F.lit(2 * R))
    none = F.lit(None).cast("double")
    r = one(spark, o=S.place_vertically(b, S.Vec.lit(R + 1000, 0, 0), frame, 4), w=S.place_vertically(whole, S.Vec(none, none, none), frame, 2), same=S.place_vertically(b, S.Vec.lit(R + 1000, 0, 0), frame, 1))
    assert r["o"]["center"]["x"] == pytest.approx(R + 4000) and r["o"]["radius"] == 10
    assert point(r["w"]["center"]) == (0, 0, 0) and r["w"]["radius"] == pytest.approx(4 * R)
    assert r["same"]["center"]["x"] == pytest.approx(R + 1000)
