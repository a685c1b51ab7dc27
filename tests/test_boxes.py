"""Joins of boxes against all pairs."""

import random

from tessella.operators import boxes as X

KIND = "id int, low struct<x: double, y: double, z: double>, high struct<x: double, y: double, z: double>"


def made(rng, n, spread):
    rows = []
    for i in range(n):
        size = 10.0 ** rng.uniform(-4, 2)
        low = [rng.uniform(-spread, spread) for _ in range(3)]
        rows.append((i, tuple(low), tuple(v + size * rng.random() for v in low)))
    return rows


def met(a, b):
    inside_out = lambda r: r[1] is None or r[2] is None or not all(x <= y for x, y in zip(r[1], r[2]))
    return sorted((x[0], y[0]) for x in a for y in b if not inside_out(x) and not inside_out(y) and all(h >= l and m <= g for h, l, m, g in zip(x[2], y[1], x[1], y[2])))


def joined(spark, a, b):
    found = X.box_join(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND))
    return sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect())


def test_boxes_that_meet(spark):
    rng = random.Random(3)
    far, nan = float("inf"), float("nan")
    odd = [
        (900, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)), (901, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), (902, (1.0, 1.0, 1.0), (2.0, 2.0, 2.0)), (903, (-far,) * 3, (far,) * 3),
        (904, None, (1.0,) * 3), (905, (nan, 0.0, 0.0), (1.0,) * 3), (906, (5.0,) * 3, (4.0,) * 3), (907, (-far, 0.0, 0.0), (0.5, 0.5, 0.5)), (908, (1e12,) * 3, (1e12 + 1,) * 3), (901, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)),
    ]
    a, b = made(rng, 250, 60) + odd, made(rng, 200, 60) + odd
    assert joined(spark, a, b) == met(a, b)
    assert joined(spark, a, []) == [] == joined(spark, [], b)
    points = [(i, (float(i % 7),) * 3, (float(i % 7),) * 3) for i in range(70)]
    assert joined(spark, points, points) == met(points, points)


def test_candidates_grow_with_the_boxes_not_their_square(spark):
    rng = random.Random(4)
    counts = {}
    for n in (500, 2000):
        rows = [(i, (i + rng.random(), rng.random(), rng.random()), None) for i in range(n)]
        rows = [(i, low, tuple(v + rng.choice((0.1, 1.0, 6.0)) for v in low)) for i, low, _ in rows]
        df = spark.createDataFrame(rows, KIND)
        counts[n] = X.candidates(df, df).count(), X.box_join(df, df).count()
        assert counts[n][0] <= 6 * counts[n][1]
    assert counts[2000][0] <= 4.5 * counts[500][0]
