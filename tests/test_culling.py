"""Cameras that go down a tree against every camera on every tile."""

import math
import random

from pyspark.sql import functions as F

from tessella.functions import geodesy as G
from tessella.operators import culling
from tessella.operators.culling import HOT_PART, enclosures, joined_at
from tessella.operators.selection import Rules, select_active
from tessella.plans.metric import EcefMetric
from tessella.storage import settled
from tests.test_metric import CAMERA

POINT = "struct<x: double, y: double, z: double>"
TILES = f"tile_id string, parent_id string, depth int, bounds struct<min: {POINT}, max: {POINT}, center: {POINT}, radius: double>, error double"
BALL = G.Ellipsoid(5.0, 5.0)


def tile(rng, id_, parent, depth, spread, size):
    c = [rng.uniform(-spread, spread) for _ in range(3)]
    r = size * rng.random()
    ends = [tuple(v + s * r for v in c) for s in (-1, 1)]
    bounds = None if rng.random() < 0.02 else (*ends, tuple(c), math.nan if rng.random() < 0.01 else r)
    return (id_, parent, depth, bounds, 10.0 / (1 + depth))


def forest(rng, roots, deep=4):
    """Children lie anywhere, also outside their parents."""
    out, front = [], []
    for i in range(roots):
        front.append(tile(rng, f"r{i}", None, 0, 40, 4))
    while front:
        out += front
        front = [tile(rng, f"{t[0]}/{i}", t[0], t[2] + 1, 40, 4 / (1 + t[2])) for t in front if t[2] < deep for i in range(rng.choice((0, 1, 2, 3)))]
    return out


def planes(rng, wide):
    out = []
    for _ in range(3):
        n = [rng.gauss(0, 1) for _ in range(3)]
        k = rng.choice((0.3, 1.0, 4.0)) / math.hypot(*n)
        out.append((*(v * k for v in n), k * (rng.uniform(-5, 25) + wide)))
    return out


def cameras(rng, n):
    rows = []
    for i in range(n):
        p = tuple(rng.uniform(-30, 30) for _ in range(3))
        clip = (None, None) if rng.random() < 0.4 else (tuple(v - 15 for v in p), tuple(v + 15 for v in p))
        rows.append((f"c{i}", (p, *clip, 1000.0, None, 1.0), None if rng.random() < 0.1 else planes(rng, 0), None if rng.random() < 0.3 else planes(rng, 4)))
    return rows


def flags(rows):
    return {(r["view"], r["tile_id"]): (r["visible"], r["periphery"], r["sse"]) for r in rows.where("visible OR periphery").collect()}


def test_all_that_is_seen_is_looked_at(spark):
    for seed, roots, metric in ((1, 1, EcefMetric(BALL, horizon="tile-heights")), (2, 90, EcefMetric(BALL))):
        rng = random.Random(seed)
        placed = spark.createDataFrame(forest(rng, roots, deep=3), TILES)
        cams = spark.createDataFrame(cameras(rng, 60), CAMERA)
        found = metric.looked_at(placed, cams).cache()
        assert flags(found) == flags(metric.seen(placed, cams))
        assert found.count() == found.select("view", "tile_id").distinct().count()


def test_selections_agree(spark):
    rng = random.Random(5)
    placed = spark.createDataFrame(forest(rng, 3, deep=3), TILES)
    cams = spark.createDataFrame(cameras(rng, 25), CAMERA)
    mark = lambda *k: F.pmod(F.xxhash64("tile_id", *[F.lit(v) for v in k]), F.lit(10))
    state = {"refine": F.when(mark("a") < 2, "ADD").otherwise("REPLACE"), "potential": mark("p") < 8, "ready": (mark("p") < 8) & (mark("r") < 7), "subtree_ready": F.lit(True), "was_refining": mark("w") < 4, "selected_before": mark("s") < 3}
    metric, rules = EcefMetric(BALL), Rules(max_error=60.0)
    cut = lambda rows: {(r["view"], r["tile_id"]) for r in select_active(rows.withColumns(state), rules).where("selected").collect()}
    # a root that is not looked at is not active either, and each is a tree of its own
    some = cut(metric.looked_at(placed, cams))
    assert some == cut(metric.seen(placed, cams)) and some


def test_work_follows_what_is_seen(spark):
    """A full quadtree over a plane; every camera has a small box of it in view."""
    side, deep = 64.0, 5
    rows = []
    for lod in range(deep + 1):
        size = side / (1 << lod)
        for x in range(1 << lod):
            for y in range(1 << lod):
                low, high = (x * size, y * size, 0.0), ((x + 1) * size, (y + 1) * size, 0.0)
                rows.append((f"{lod}/{x}/{y}", f"{lod - 1}/{x // 2}/{y // 2}" if lod else None, lod, (low, high, tuple((a + b) / 2 for a, b in zip(low, high)), size / math.sqrt(2)), 1.0))
    placed = spark.createDataFrame(rows, TILES)
    n = 3000
    rng = random.Random(7)
    at = [(rng.uniform(0, side), rng.uniform(0, side)) for _ in range(n)]
    cams = spark.createDataFrame([(f"c{i}", ((x, y, 1.0), (x - 0.5, y - 0.5, -1.0), (x + 0.5, y + 0.5, 1.0), 1000.0, None, 1.0), None, None) for i, (x, y) in enumerate(at)], CAMERA)
    found = EcefMetric(BALL, horizon_culling=False).looked_at(placed, cams).cache()
    per_camera = found.count() / n
    assert per_camera < 100 and len(rows) > 1000
    assert found.where("visible").count() == sum(1 for x, y in at for r in rows if r[3][0][0] <= x + 0.5 and r[3][1][0] >= x - 0.5 and r[3][0][1] <= y + 0.5 and r[3][1][1] >= y - 0.5)


def test_pairs_of_small_levels_are_not_written(spark, monkeypatch):
    """What looked_at writes does not grow with what is seen; with levels that count as large it does, and finds the same."""
    rng = random.Random(11)
    placed = spark.createDataFrame(forest(rng, 9, deep=4), TILES)
    many = [(v, c, None if p is None else p * 3, q) for v, c, p, q in cameras(rng, 80)]  # up to nine planes, more than have columns of their own
    cams, metric = spark.createDataFrame(many, CAMERA), EcefMetric(BALL)
    written = []

    def counted(df):
        found = settled(df)
        written.append(found.count())
        return found

    monkeypatch.setattr(culling, "settled", counted)
    want = flags(metric.seen(placed, cams))
    assert flags(metric.looked_at(placed, cams)) == want and max(written) <= max(len(many), placed.count())
    for few, steps in ((0, 8), (12, 8), (20_000, 1)):
        monkeypatch.setattr(culling, "FEW_TILES", few)
        monkeypatch.setattr(culling, "STEPS", steps)
        found = metric.looked_at(placed, cams).cache()
        assert flags(found) == want and found.count() == found.select("view", "tile_id").distinct().count()


def test_empty_tables(spark):
    metric = EcefMetric(BALL)
    none, one = spark.createDataFrame([], TILES), spark.createDataFrame(forest(random.Random(1), 2), TILES)
    cams = spark.createDataFrame(cameras(random.Random(1), 2), CAMERA)
    assert metric.looked_at(none, cams).isEmpty() and metric.looked_at(one, cams.limit(0)).isEmpty()
    assert enclosures(none) == []


def test_hot_nodes_are_shared_and_nothing_is_lost(spark):
    rows = spark.range(3 * HOT_PART).select(F.col("id").alias("view"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), F.col("id"))).otherwise("hot").alias("parent"))
    level = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("n0", "c"), (None, "d")], "parent string, node string")
    got = joined_at(rows, level, "parent")
    assert got.count() == 2 * 2 * HOT_PART + 1 and got.where("node = 'a'").select("view").distinct().count() == 2 * HOT_PART
