import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import quadtree as Q

COLUMNS = "ns string, lod int, x long, y long"


def cut(spark, *tiles, ns=""):
    return spark.createDataFrame([(ns, *map(int, t.split("/"))) for t in tiles] or [], COLUMNS)


def keys(df):
    return {f"{r['ns']}{r['lod']}/{r['x']}/{r['y']}" for r in df.collect()}


def test_refinements(spark):
    got = keys(Q.balance_refinements(cut(spark, "4/7/3")))
    assert {"2/2/0", "1/1/0", "0/0/0"} <= got and not {"3/4/1", "2/2/1"} & got
    assert "1/1/0" not in keys(Q.balance_refinements(cut(spark, "3/0/0")))
    assert "1/1/0" in keys(Q.balance_refinements(cut(spark, "3/0/0"), wrap_x=True))
    assert all(k.startswith("a:") for k in keys(Q.balance_refinements(cut(spark, "4/7/3", ns="a:"))))


def test_imbalances(spark):
    rows = Q.imbalances(cut(spark, "3/3/1", "1/1/0", "2/1/1")).collect()
    assert [(r["lod"], r["x"], r["y"], r["coarse_lod"]) for r in rows] == [(3, 3, 1, 1)]


def test_touches(spark):
    seen = cut(spark, "3/4/4")
    yes = ["3/5/4", "3/4/3", "3/5/5", "4/10/8", "6/40/35", "5/20/20"]
    no = ["4/11/8", "6/41/35", "3/6/4", "2/3/2", "3/4/4"]
    assert keys(Q.touching(cut(spark, *yes, *no), seen)) == set(yes)


def test_admission(spark):
    tiles = cut(spark, "4/7/7", "2/2/1", "1/1/1")
    done, blocked = Q.refine_cut(tiles)
    got = keys(done)
    assert blocked.isEmpty() and Q.imbalances(done).isEmpty() and "4/7/7" in got and any(k.startswith("3/4/") for k in got)
    ready = cut(spark, "2/2/1", "2/2/2", "2/2/3", "2/3/2", "2/3/3", "0/0/0")
    done, blocked = Q.refine_cut(tiles, ready)
    assert keys(blocked) == {"1/1/1", "2/2/1", "4/7/7"}


def balanced_by_hand(leaves):
    """Split one tile at a time."""
    leaves = set(leaves)
    while True:
        for lod, x, y in sorted(leaves, reverse=True):
            for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                nx, ny = x + dx, y + dy
                if not (0 <= nx < 1 << lod and 0 <= ny < 1 << lod):
                    continue
                up = next(((lod - k, nx >> k, ny >> k) for k in range(lod + 1) if (lod - k, nx >> k, ny >> k) in leaves), None)
                if up and up[0] < lod - 1:
                    leaves.remove(up)
                    leaves |= {(up[0] + 1, up[1] * 2 + i, up[2] * 2 + j) for i in (0, 1) for j in (0, 1)}
                    break
            else:
                continue
            break
        else:
            return leaves


def test_rounds_reach_the_same_cut_as_single_splits(spark):
    rng, rows, want = random.Random(5), [], set()
    for n in range(12):
        leaves = {(0, 0, 0)}
        for _ in range(6):
            lod, x, y = rng.choice(sorted(t for t in leaves if t[0] < 5))
            leaves.remove((lod, x, y))
            leaves |= {(lod + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)}
        rows += [(f"{n}:", *t) for t in leaves]
        want |= {f"{n}:{a}/{b}/{c}" for a, b, c in balanced_by_hand(leaves)}
    done, blocked = Q.refine_cut(spark.createDataFrame(rows, COLUMNS))
    assert keys(done) == want and blocked.isEmpty()
    assert abs(sum(0.25 ** int(k.split(":")[1].split("/")[0]) for k in keys(done)) - 12) < 1e-12


def test_holds(spark):
    unbalanced = spark.createDataFrame([("", 4, 7, 3, 1)], COLUMNS + ", coarse_lod int")
    tiles = spark.createDataFrame([("", 2, 1, 0, True), ("", 1, 0, 0, True), ("", 3, 3, 1, True)], COLUMNS + ", ready boolean")
    assert keys(Q.held_refinements(unbalanced, tiles, cut(spark))) == {"2/1/0"}
    assert keys(Q.held_refinements(unbalanced, tiles, cut(spark, "2/1/0"))) == set()
    assert keys(Q.held_refinements(unbalanced, tiles.where("lod <> 2"), cut(spark))) == {"1/0/0"}


def meeting(tiles, corners_of):
    """{tile: those that share a corner point with it}, by looking at all pairs."""
    points = {t: set(corners_of(t)) for t in tiles}
    return {t: {o for o in tiles if o != t and points[t] & points[o]} for t in tiles}


def found_neighbors(spark, tiles, seams, corners=True):
    df = spark.createDataFrame(tiles, "ns string, lod int, x long, y long")
    got = {t: [] for t in tiles}
    for r in Q.neighbors(df, corners=corners, seams=seams).collect():
        got[r["ns"], r["lod"], r["x"], r["y"]].append((r["nns"], r["lod"], r["nx"], r["ny"]))
    return got


@pytest.mark.parametrize("lod", [0, 1, 3])
def test_neighbours_over_the_faces_of_a_cube(spark, lod):
    side = 1 << lod
    faces = {s + "xyz"[a]: (a, side if s == "+" else 0) for a in range(3) for s in "+-"}

    def corners_of(tile):
        ns, _, x, y = tile
        axis, wall = faces[ns]
        for i in (x, x + 1):
            for j in (y, y + 1):
                p = {axis: wall, (axis + 1) % 3: i, (axis + 2) % 3: j}
                yield p[0], p[1], p[2]

    tiles = [(ns, lod, x, y) for ns in faces for x in range(side) for y in range(side)]
    got = found_neighbors(spark, tiles, Q.cube_seams(spark))
    assert {t: set(n) for t, n in got.items()} == meeting(tiles, corners_of)
    across = found_neighbors(spark, tiles, Q.cube_seams(spark), corners=False)
    points = {t: set(corners_of(t)) for t in tiles}
    assert all(len(n) == 4 == len(set(n)) and all(len(points[t] & points[o]) == 2 + 2 * (side == 0) for o in n) for t, n in across.items())


def test_neighbours_over_roots_in_a_plane(spark):
    """Four roots around a point, one of them upside down: tiles there meet at a corner alone."""
    roots = {"a": (0, 0), "b": (4, 0), "c": (0, 4), "d": (4, 4)}
    seams = [("a", 2, "b", 1, False), ("a", 3, "c", 0, False), ("b", 3, "d", 3, True), ("c", 2, "d", 2, True)]
    seams += [(o, oe, n, e, f) for n, e, o, oe, f in seams]
    seams = spark.createDataFrame(seams, "ns string, edge int, other string, other_edge int, flipped boolean")

    def corners_of(tile):
        ns, _, x, y = tile
        if ns == "d":
            x, y = 3 - x, 3 - y
        return [(roots[ns][0] + x + i, roots[ns][1] + y + j) for i in (0, 1) for j in (0, 1)]

    tiles = [(ns, 2, x, y) for ns in roots for x in range(4) for y in range(4)]
    assert {t: set(n) for t, n in found_neighbors(spark, tiles, seams).items()} == meeting(tiles, corners_of)


def test_a_cube_is_balanced_across_its_edges(spark):
    seams = Q.cube_seams(spark)
    fine = [("+x", 4, x, y) for x in range(16) for y in range(16)]
    cut = spark.createDataFrame([*fine, *[(ns, 0, 0, 0) for ns in ("-x", "+y", "-y", "+z", "-z")]], "ns string, lod int, x long, y long")
    assert Q.imbalances(cut).isEmpty() and Q.imbalances(cut, seams=seams).count() == 60
    balanced, blocked = Q.refine_cut(cut, seams=seams)
    assert blocked.isEmpty() and Q.imbalances(balanced, seams=seams).isEmpty()
    area = {r["ns"]: r["a"] for r in balanced.groupBy("ns").agg(F.sum(F.pow(F.lit(4.0), -F.col("lod"))).alias("a")).collect()}
    assert area == dict.fromkeys(area, 1.0) and len(area) == 6
    held = spark.createDataFrame([("+y", 0, 0, 0)], "ns string, lod int, x long, y long")
    ready = spark.createDataFrame([(n, 0, 0, 0) for n in ("-y", "+z", "-z", "-x")], held.schema)
    _, stuck = Q.refine_cut(cut, ready.unionByName(balanced.where("lod > 0")), seams=seams)
    assert {r["ns"] for r in stuck.collect()} >= {"+x", "+y"}  # both sides of the seam
