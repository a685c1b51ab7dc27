"""Selections against a descent that walks the tree as it is described, on random trees; and small scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import selection as S
from tessella.operators.balancing import close_base_cut, select_balanced

SCHEMA = "view string, tile_id string, depth int, refine string, sse double, visible boolean, periphery boolean, potential boolean, ready boolean, subtree_ready boolean, was_refining boolean, selected_before boolean, held boolean, delayed boolean, balance boolean"
RULES = S.Rules(max_error=10.0, hysteresis=0.2)


class Tile:
    def __init__(self, id_, depth, parent, rng):
        self.id, self.depth, self.parent, self.children = id_, depth, parent, []
        chance = lambda p: rng.random() < p
        self.refine = "ADD" if chance(0.2) else "REPLACE"
        self.sse, self.visible, self.periphery = rng.choice([2.0, 8.5, 9.0, 12.0, 30.0]), chance(0.8), chance(0.3)
        self.potential = chance(0.85)
        self.ready = self.potential and chance(0.7)
        self.subtree_ready = chance(0.95)
        self.was_refining, self.selected_before = chance(0.4), chance(0.25)
        self.held, self.delayed, self.balance = chance(0.1), chance(0.1), chance(0.1)

    def row(self, view):
        return (view, self.id, self.depth, self.refine, self.sse, self.visible, self.periphery, self.potential, self.ready, self.subtree_ready, self.was_refining, self.selected_before, self.held, self.delayed, self.balance)

    def below(self):
        for c in self.children:
            yield c
            yield from c.below()

    def above(self):
        at = self.parent
        while at:
            yield at
            at = at.parent


def tree(rng, n=60, deepest=5):
    """A random tree; one deeper than usual grows mostly from the tile that came last."""
    root = Tile("r", 0, None, rng)
    tiles = [root]
    while len(tiles) < n:
        parent = tiles[-1] if deepest > 5 and rng.random() < 0.7 else rng.choice(tiles)
        if len(parent.children) < 4 and parent.depth < deepest:
            child = Tile(f"{parent.id}/{len(parent.children)}", parent.depth + 1, parent, rng)
            parent.children.append(child)
            tiles.append(child)
    for t in tiles:
        if not t.subtree_ready:  # no children are known below
            for b in list(t.below()):
                tiles.remove(b)
            t.children = []
    return root, tiles


def effective(t):
    return 10 * 0.8 if t.was_refining else 10


def cover(t, base):
    def covered(c):
        if c.selected_before or not c.visible:
            return True
        if base and not c.children and c.subtree_ready and not c.potential:
            return True
        return bool(c.children) and all(covered(x) for x in c.children)

    return bool(t.children) and all(covered(c) for c in t.children)


def walk_active(root):
    chosen, refining = set(), set()
    active = lambda t: t.visible or t.periphery

    def front(t):
        if not t.visible:
            return True
        if not t.subtree_ready:
            return False
        if t.potential:
            return t.ready
        return all([front(c) for c in t.children])

    def retained(t):
        return {c.id for c in t.below() if c.selected_before and active(c)}

    def up(t):
        return next((a.id for a in [t, *t.above()] if a.ready), None)

    def visit(t):
        if not active(t):
            return
        if not t.subtree_ready:
            chosen.add(t.id)
            return
        required = t.sse > effective(t) or not t.potential or t.balance
        wants = not (t.held and t.potential) and (required or t.delayed) and bool(t.children) and (t.visible or any(active(c) for c in t.children))
        if not wants:
            if t.potential and not t.ready:
                if retained(t):
                    chosen.update(retained(t))
                    return
                if not t.visible:
                    return
                found = up(t.parent) if t.parent else None
                if found:
                    chosen.add(found)
                    return
            chosen.add(t.id)
            return
        refining.add(t.id)
        if t.refine == "ADD":
            chosen.add(t.id)
        elif not all([front(c) for c in t.children]):
            if t.balance and cover(t, False) and retained(t):
                chosen.update(retained(t))
            elif up(t):
                chosen.add(up(t))
            elif retained(t):
                chosen.update(retained(t))
            else:
                chosen.add(t.id)
            return
        for c in t.children:
            visit(c)

    visit(root)
    return chosen, refining


def walk_base(root, tiles):
    named, blocked = set(), []
    by_id = {t.id: t for t in tiles}

    def front(t):
        if not t.subtree_ready:
            return False
        return t.ready if t.potential else all([front(c) for c in t.children])

    def ladder(t, retain):
        kept = {c.id for c in t.below() if c.selected_before and c.visible and c.ready}
        if (retain or not t.ready) and cover(t, True):
            named.update(kept)
        elif retain and kept:
            blocked.append(t.id)
        elif t.ready:
            named.add(t.id)
        else:
            for a in t.above():
                if a.refine == "ADD":
                    break
                if a.ready:
                    named.add(a.id)
                    break

    def visit(t):
        if not t.visible:
            return
        if not t.subtree_ready:
            ladder(t, False)
            return
        wants = (t.sse > effective(t) or not t.potential or t.balance or t.delayed) and bool(t.children)
        if not wants:
            if t.potential:
                ladder(t, False)
            return
        if t.refine == "ADD":
            if t.ready:
                named.add(t.id)
        elif not all([front(c) for c in t.children]):
            ladder(t, True)
            return
        for c in t.children:
            visit(c)

    visit(root)
    if blocked:
        return {t.id for t in tiles if t.selected_before and t.ready}
    out = set()
    for id_ in named:
        for a in by_id[id_].above():
            if a.refine == "ADD":
                out.add(id_)
                break
            if a.id in named:
                break
        else:
            out.add(id_)
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(11)
    trees = {f"v{i}": tree(rng) for i in range(150)}
    rows = spark.createDataFrame([t.row(v) for v, (_, tiles) in trees.items() for t in tiles], SCHEMA)
    return trees, rows


def test_deep_trees_level_by_level(spark, monkeypatch):
    """25 levels, without the short way that few rows take."""
    monkeypatch.setattr(S, "FEW_ROWS", 0)
    rng, trees = random.Random(23), {}
    while len(trees) < 12:
        root, tiles = tree(rng, n=90, deepest=25)
        if len(trees) > 5 or max(t.depth for t in tiles) > 20:
            trees[f"v{len(trees)}"] = root, tiles
    rows = spark.createDataFrame([t.row(v) for v, (_, tiles) in trees.items() for t in tiles], SCHEMA)
    got = S.select_active(rows, RULES)
    assert got.count() == rows.count()
    cuts = by_view(got, "selected")
    for view, (root, _) in trees.items():
        assert cuts.get(view, set()) == walk_active(root)[0], view


def by_view(rows, name):
    out = {}
    for r in rows.where(name).collect():
        out.setdefault(r["view"], set()).add(r["tile_id"])
    return out


def test_active_equals_the_descent(forest):
    trees, rows = forest
    got = S.select_active(rows, RULES).cache()
    cuts, refining = by_view(got, "selected"), by_view(got, "refining")
    for view, (root, _) in trees.items():
        want, deep = walk_active(root)
        assert cuts.get(view, set()) == want, view
        assert refining.get(view, set()) == deep, view


def test_base_equals_the_descent(forest):
    trees, rows = forest
    got = by_view(S.select_base(rows, RULES), "selected")
    for view, (root, tiles) in trees.items():
        assert got.get(view, set()) == walk_base(root, tiles), view


def small(spark, *tiles, **common):
    base = {"refine": "REPLACE", "sse": 1.0, "visible": True, "periphery": False, "potential": True, "ready": True, "subtree_ready": True, "was_refining": False, "selected_before": False, "held": False, "delayed": False, "balance": False}
    rows = [("v", id_, id_.count("/"), *({**base, **common, **own}[k] for k in list(base))) for id_, own in tiles]
    return spark.createDataFrame(rows, SCHEMA)


def chosen(rows):
    return {r["tile_id"] for r in rows.where("selected").collect()}


def test_a_cold_child_keeps_the_parent(spark):
    cold = lambda ready: small(spark, ("r", {"sse": 20.0}), ("r/0", {}), ("r/1", {"ready": ready}))
    assert chosen(S.select_active(cold(False), RULES)) == {"r"} and chosen(S.select_active(cold(True), RULES)) == {"r/0", "r/1"}
    asked = {(r["tile_id"], r["priority"]) for r in S.requests(S.select_active(cold(False), RULES), RULES).collect()}
    assert asked == {("r/1", 1.0)}


def test_hysteresis_and_threshold_scale(spark):
    at = lambda sse, was, rules: chosen(S.select_active(small(spark, ("r", {"sse": sse, "was_refining": was}), ("r/0", {})), rules))
    assert at(16.0, False, RULES) == {"r/0"} and at(9.6, True, RULES) == {"r/0"} and at(7.84, True, RULES) == {"r"}
    held_back = S.Rules(max_error=10.0, hysteresis=0.2, threshold_scale=4)
    assert at(16.0, False, held_back) == {"r"} and at(16.0, True, held_back) == {"r/0"}
    with pytest.raises(ValueError):
        S.Rules(hysteresis=1.0)
    assert at(16.0, False, S.Rules(max_error=10.0, by_depth={0: 20.0})) == {"r"}


def test_changes(spark):
    cut = lambda *ids: spark.createDataFrame([("v", i) for i in ids], "view string, tile_id string")
    got = {(r["tile_id"], r["change"]) for r in S.cut_changes(cut("a", "b"), cut("b", "c")).collect()}
    assert got == {("a", "leave"), ("b", "stay"), ("c", "enter")}


def test_readiness(spark):
    rows = [("a", "renderable", "ready", True), ("a", "empty", "ready", False), ("b", "renderable", "ready", False), ("c", "unknown", "queued", False), ("d", "external", "ready", False)]
    contents = spark.createDataFrame(rows, "tile_id string, kind string, status string, has_handle boolean")
    got = {r["tile_id"]: (r["potential"], r["ready"]) for r in S.presentation_ready(contents).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (True, False), "d": (False, False)}


def grid_tiles(spark, deep, levels=4, **common):
    """A full quadtree that refines towards one corner of its middle."""
    rows = []
    for lod in range(levels + 1):
        for x in range(1 << lod):
            for y in range(1 << lod):
                path = "/".join(["g", *(str((x >> (lod - k) & 1) + 2 * (y >> (lod - k) & 1)) for k in range(1, lod + 1))])
                sse = 20.0 if (x, y) == (deep[0] >> (levels - lod), deep[1] >> (levels - lod)) else 1.0
                rows.append(("v", path, lod, "REPLACE", sse, True, False, True, common.get("ready", lambda *_: True)(lod, x, y), True, False, common.get("before", lambda *_: False)(lod, x, y), False, False, False, "", lod, x, y))
    return spark.createDataFrame(rows, SCHEMA + ", ns string, lod int, x long, y long")


def test_balanced_selection(spark):
    chosen_, unbalanced = select_balanced(grid_tiles(spark, (7, 7)), RULES)
    cut = [(r["lod"], r["x"], r["y"]) for r in chosen_.where("selected").collect()]
    assert unbalanced.isEmpty() and abs(sum(0.25**t[0] for t in cut) - 1) < 1e-12 and (4, 7, 7) in cut
    plain = S.select_active(grid_tiles(spark, (7, 7)), RULES).where("selected").count()
    assert len(cut) > plain


def test_base_cut_is_admitted_or_gives_way(spark):
    whole = close_base_cut(S.select_base(grid_tiles(spark, (7, 7)), RULES))
    ids = {r["tile_id"] for r in whole.collect()}
    assert abs(sum(0.25 ** i.count("/") for i in ids) - 1) < 1e-12
    cold = grid_tiles(spark, (7, 7), ready=lambda lod, x, y: not (lod == 2 and (x, y) == (2, 0)), before=lambda lod, x, y: lod == 1)
    kept = {r["tile_id"] for r in close_base_cut(S.select_base(cold, RULES)).collect()}
    assert abs(sum(0.25 ** i.count("/") for i in kept) - 1) < 1e-12 and max(i.count("/") for i in kept) < 4


def test_periphery(spark):
    rows = small(spark, ("r", {}), ("r/0", {"visible": False, "periphery": True, "ready": False, "sse": 20.0}), ("r/0/0", {"visible": False, "periphery": True, "ready": False, "sse": 3.0}), ("r/1", {"visible": False, "ready": False}))
    got = {r["tile_id"]: r["priority"] for r in S.periphery_requests(rows, RULES).collect()}
    assert got == {"r/0": pytest.approx(-1 / 21), "r/0/0": pytest.approx(-1 / 4)}
