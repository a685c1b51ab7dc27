import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import implicit as I
from tessella.functions.tiles import address_of, quadtree_key, web_corner, web_ground_resolution
from tessella.functions.uri import base_uri, resolve_uri


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def L(v):
    return F.lit(v).cast("long")


def interleaved(level, *axes):
    out = 0
    for bit in range(level):
        for i, a in enumerate(axes):
            out |= (a >> bit & 1) << (len(axes) * bit + i)
    return out


def test_morton_and_offsets(spark):
    rows = [(2, 2, 3), (0, 0, 0), (5, 31, 17), (26, (1 << 26) - 1, 12345), (3, 255, 255)]
    df = spark.createDataFrame(rows, "level int, x long, y long")
    for r in df.select("*", I.morton(F.col("level"), F.col("x"), F.col("y")).alias("m")).collect():
        assert r["m"] == interleaved(r["level"], r["x"], r["y"])
    df = spark.createDataFrame([(4, 9, 5, 14), (17, 99999, 131071, 1)], "level int, x long, y long, z long")
    for r in df.select("*", I.morton(*[F.col(c) for c in ("level", "x", "y", "z")]).alias("m")).collect():
        assert r["m"] == interleaved(r["level"], r["x"], r["y"], r["z"])
    r = one(spark, m=I.morton(F.lit(2), L(2), L(3)) , a=I.availability_index(F.lit(2), L(3), L(0)), q=I.level_offset(F.lit(3), 4), o=I.level_offset(F.lit(2), 8))
    assert (r["m"], r["a"], r["q"], r["o"]) == (14, 10, 21, 9)


def test_indices_beyond_doubles_are_errors(spark):
    for wrong in (I.morton(F.lit(28), L((1 << 28) - 1), L(0)), I.level_offset(F.lit(28), 4), I.two_to(F.lit(53)), I.morton(F.lit(40), L(1 << 35), L(0))):
        with pytest.raises(Exception, match="safe"):
            one(spark, w=wrong)


def test_children_local_and_templates(spark):
    r = one(spark, c=I.child_coordinates(F.lit(1), L(1), L(0)), o=I.child_coordinates(F.lit(0), L(0), L(0), L(0)), t=I.expand_template(F.lit("{level}/{x}/{y}/{z}-{x}"), F.lit(3), L(5), L(6)), l=I.local_coordinate(L(13), F.lit(4), L(3), F.lit(2)))
    assert [(c["child"], c["level"], c["x"], c["y"]) for c in r["c"]] == [(0, 2, 2, 0), (1, 2, 3, 0), (2, 2, 2, 1), (3, 2, 3, 1)]
    assert [(c["x"], c["y"], c["z"]) for c in r["o"]] == [(i & 1, i >> 1 & 1, i >> 2) for i in range(8)]
    assert r["t"] == "3/5/6/0-5" and r["l"] == 1


def test_subdivision(spark):
    box = F.array(*[F.lit(float(v)) for v in (0, 0, 0, 8, 0, 0, 0, 8, 0, 0, 0, 8)])
    region = F.array(*[F.lit(float(v)) for v in (3.0, -1, -3.0, 1, 0, 100)])
    r = one(spark, b=I.subdivide_box(box, F.lit(1), L(1), L(0), L(1)), flat=I.subdivide_box(box, F.lit(1), L(1), L(0)), w=I.subdivide_region(region, F.lit(1), L(1), L(0)), h=I.subdivide_region(region, F.lit(1), L(0), L(1), L(1)))
    assert r["b"] == [4, -4, 4, 4, 0, 0, 0, 4, 0, 0, 0, 4]
    assert r["flat"][2] == 0 and r["flat"][11] == 8
    assert abs(r["w"][0]) == pytest.approx(math.pi) and r["w"][2] == pytest.approx(-3.0) and r["w"][4:] == [0, 100]
    assert r["h"][4:] == [50, 100] and r["h"][1:4:2] == [0, 1]
    with pytest.raises(Exception, match="box"):
        one(spark, s=I.subdivide_sphere(F.array(F.lit(1.0))))
    extent = F.from_json(F.lit('{"minEasting":0,"minNorthing":0,"maxEasting":8,"maxNorthing":4,"vertical":{"reference":"GROUND","direction":"DOWN","minimum":0,"maximum":100}}'), "minEasting double, minNorthing double, maxEasting double, maxNorthing double, vertical struct<reference: string, direction: string, minimum: double, maximum: double>")
    u = one(spark, u=I.subdivide_utm(extent, F.lit(2), L(1), L(3), L(0)))["u"]
    assert (u["minEasting"], u["maxEasting"], u["minNorthing"], u["maxNorthing"]) == (2, 4, 3, 4)
    assert (u["vertical"]["minimum"], u["vertical"]["maximum"]) == (75, 100)  # z grows upward, depths downward


def test_bits(spark):
    views = F.from_json(F.lit('[{"buffer":0,"byteOffset":1,"byteLength":1},{"buffer":0,"byteLength":9}]'), "array<struct<buffer: int, byteOffset: bigint, byteLength: bigint>>")
    buffers = F.array(F.unhex(F.lit("FF0B")))
    av = lambda s: F.from_json(F.lit(s), "constant int, bitstream int")
    bits = [one(spark, b=I.read_availability(av('{"bitstream":0}'), views, buffers, L(i)))["b"] for i in range(8)]
    assert bits == [True, True, False, True, False, False, False, False]
    assert one(spark, b=I.read_availability(av('{"constant":1,"bitstream":7}'), views, buffers, L(99)))["b"]
    for s, i in (('{"bitstream":0}', 8), ('{"bitstream":1}', 0), ('{"bitstream":2}', 0), ("{}", 0)):
        with pytest.raises(Exception, match="vailability|buffer"):
            one(spark, b=I.read_availability(av(s), views, buffers, L(i)))


def test_addresses(spark):
    lod, x, y = address_of(F.lit(2), L(1), L(0), F.lit(3), L(2), L(5))
    r = one(spark, k=quadtree_key(F.lit("a:"), lod, x, y), f=quadtree_key(F.lit(""), F.lit(1), F.lit(0), F.lit(1), F.lit(2)), z=quadtree_key(F.lit(""), F.lit(1), F.lit(0), F.lit(1), F.lit(0)))
    assert (r["k"], r["f"], r["z"]) == ("a:5/9/23", "2/1/0/1", "1/0/1")
    lat, lon = web_corner(F.lit(1), L(1), L(1))
    r = one(spark, lat=lat, lon=lon, g=web_ground_resolution(F.lit(0.0), F.lit(0)))
    assert r["lat"] == pytest.approx(0) and r["lon"] == pytest.approx(0) and r["g"] == pytest.approx(156543.03392804097)


@pytest.mark.parametrize(
    "ref,base,want",
    [
        ("a.json", "http://h/x/y.json", "http://h/x/a.json"),
        ("../a.json", "http://h/x/y/z", "http://h/x/a.json"),
        ("/r/./b", "http://h/x/y", "http://h/r/b"),
        ("?q=1", "http://h/x/y?p", "http://h/x/y?q=1"),
        ("#f", "http://h/x/y?p#g", "http://h/x/y?p#f"),
        ("", "http://h/x/y?p#g", "http://h/x/y?p"),
        ("//o/p", "https://h/x", "https://o/p"),
        ("http://other/a/../b", "http://h/", "http://other/b"),
        ("data:text/plain,hi", "http://h/", "data:text/plain,hi"),
        ("tile", "", "tile"),
        ("tile", "folder", "folder/tile"),
        ("tile", "folder/", "folder/tile"),
        ("../../..", "http://h/a/b/c", "http://h/"),
    ],
)
def test_resolve_uri(spark, ref, base, want):
    assert one(spark, u=resolve_uri(F.lit(ref), F.lit(base)))["u"] == want


def test_base_uri(spark):
    for uri, want in (("http://h/a/b.json?x#y", "http://h/a/"), ("http://h", "http://h/"), ("a/b/c", "a/b/"), ("a\\b", "a\\"), ("c", "")):
        assert one(spark, u=base_uri(F.lit(uri)))["u"] == want
