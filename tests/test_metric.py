import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import geodesy as G
from tessella.operators.selection import Rules, select_active
from tessella.plans.metric import EcefMetric, refined_heights
from tessella.sources import tilesets as T

R = 1000.0
BALL = G.Ellipsoid(R, R)
PLANE = "struct<x: double, y: double, z: double, w: double>"
CAMERA = f"view string, camera struct<position: struct<x: double, y: double, z: double>, clip_min: struct<x: double, y: double, z: double>, clip_max: struct<x: double, y: double, z: double>, viewport_height: double, vertical_fov: double, tan_half_fov: double>, planes array<{PLANE}>, periphery_planes array<{PLANE}>"


def shift(x, y, z):
    return [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z, 1]


@pytest.fixture(scope="module")
def tiles(spark):
    child = lambda x: {"boundingVolume": {"sphere": [R, 0, 0, 10]}, "geometricError": 1, "transform": shift(0, x, 0)}
    doc = {"root": {"boundingVolume": {"box": [R, 0, 0, 50, 0, 0, 0, 50, 0, 0, 0, 50]}, "geometricError": 40, "refine": "REPLACE", "children": [{"boundingVolume": {"region": [-0.01, -0.01, 0.01, 0.01, 0, 5]}, "geometricError": 8}, {"boundingVolume": {"sphere": [R, 0, 0, 30]}, "geometricError": 8, "transform": shift(0, 20, 0), "children": [child(5), child(-5)]}]}}
    return T.flatten(T.parse_documents(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, raw string")))


def test_derive_and_see(spark, tiles):
    metric = EcefMetric(BALL)
    placed = metric.derive(tiles).cache()
    got = {r["tile_id"]: r for r in placed.collect()}
    assert got["d/root/1/0"]["bounds"]["center"]["y"] == 25 and got["d/root/1/0"]["world"][13] == 25
    assert got["d/root/0"]["bounds"]["center"]["x"] == pytest.approx(R, abs=5) and got["d/root"]["error"] == 40
    none = None
    cameras = spark.createDataFrame([("near", ((R + 200.0, 0.0, 0.0), none, none, 1000.0, none, 1.0), none, none), ("back", ((-R - 200.0, 0.0, 0.0), none, none, 1000.0, none, 1.0), none, [(1.0, 0.0, 0.0, 1e9)])], CAMERA)
    seen = metric.seen(placed, cameras)
    rows = {(r["view"], r["tile_id"]): r for r in seen.collect()}
    assert rows[("near", "d/root")]["visible"] and not rows[("back", "d/root/0")]["visible"]
    distance = math.dist((R + 200, 0, 0), (R, 0, 0)) - math.hypot(50, 50, 50)
    assert rows[("near", "d/root")]["sse"] == pytest.approx(40 / (2 * distance / 1000))
    state = seen.withColumns({c: F.lit(v) for c, v in {"potential": True, "ready": True, "subtree_ready": True, "was_refining": False, "selected_before": False}.items()})
    cut = {r["tile_id"] for r in select_active(state, Rules(max_error=20.0)).where("selected AND view = 'near'").collect()}
    assert cut == {"d/root/0", "d/root/1/0", "d/root/1/1"}


def test_vertical_scale_moves_objects_rigidly(tiles):
    got = {r["tile_id"]: r["bounds"] for r in EcefMetric(BALL, scale=2.0).derive(tiles).collect()}
    same = {r["tile_id"]: r["bounds"] for r in EcefMetric(BALL).derive(tiles).collect()}
    move = lambda k: [got[k]["center"][a] - same[k]["center"][a] for a in "xyz"]
    assert move("d/root/1") == pytest.approx(move("d/root/1/0")) and got["d/root/1/0"]["radius"] == same["d/root/1/0"]["radius"]
    assert got["d/root"]["radius"] == pytest.approx(2 * same["d/root"]["radius"])


def test_another_scale_starts_from_the_first(tiles):
    at = lambda df: {r["tile_id"]: r["bounds"] for r in df.collect()}
    metric = EcefMetric(BALL)
    placed = metric.derive(tiles)
    assert at(metric.at_scale(placed, 2.0)) == at(EcefMetric(BALL, scale=2.0).derive(tiles)) != at(placed) == at(metric.at_scale(placed, 1.0))


def test_arguments():
    for wrong in ({"ellipsoid": None}, {"horizon": "x"}, {"viewport_height": 0}, {"vertical_fov": 4.0}, {"scale": -1.0}):
        with pytest.raises((TypeError, ValueError)):
            EcefMetric(**{"ellipsoid": BALL, **wrong})


def test_heights_from_content_and_parent(spark):
    tiles = spark.createDataFrame([("r", None, 0), ("r/0", "r", 0), ("r/1", "r", 1)], "tile_id string, parent_id string, ordinal int")
    measured = spark.createDataFrame([("r", 0.0, 400.0), ("r/0", 7.0, 8.0)], "tile_id string, low double, high double")
    half = lambda p, i: F.struct((p["low"] + 100.0 * i).alias("low"), (p["low"] + 100.0 * i + 50).alias("high"))
    got = {r["tile_id"]: (r["height_min"], r["height_max"]) for r in refined_heights(tiles, measured, half).collect()}
    assert got == {"r": (0, 400), "r/0": (7, 8), "r/1": (100, 150)}
