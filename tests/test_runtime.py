import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import cache as C
from tessella.operators import hierarchy as H
from tessella.operators import metadata as M
from tessella.operators import metrics as X
from tessella.operators import runtime as O
from tessella.sources.subtrees import dense_subtree


def test_delay_needs_frames_in_a_row(spark):
    rows = [("a", 1, 0, True), ("a", 2, 100, False), ("a", 3, 350, False), ("a", 4, 450, False), ("b", 1, 0, True), ("b", 2, 100, False), ("b", 4, 350, False), ("b", 5, 450, False), ("c", 1, 0, True), ("c", 2, 200, False), ("c", 3, 250, True), ("c", 4, 450, False)]
    df = spark.createDataFrame(rows, "tile string, frame long, clock_ms long, required boolean")
    got = {(r["tile"], r["frame"]): (r["refining"], r["delayed"], r["wake_ms"]) for r in O.coarsening_delay(df, key=["tile"]).collect()}
    assert got[("a", 2)] == (True, True, 400) and got[("a", 3)] == (True, True, 400) and got[("a", 4)] == (False, False, None)
    assert got[("b", 4)] == (True, True, 650) and got[("b", 5)][0] and got[("c", 4)] == (True, True, 750)


def test_delay_is_a_fold_without_collecting(spark):
    rng = random.Random(4)
    rows = [(k, i, 100 * i + rng.randrange(150), rng.random() < 0.3) for k in "abcd" for i in range(200) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "tile string, frame long, clock_ms long, required boolean")
    out = O.coarsening_delay(df, key=["tile"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want, state = set(), {}
    for k, f, c, q in rows:
        refining, since, last = state.get(k, (False, None, None))
        begun = None if q or not refining else since if since is not None and last >= f - 1 else c
        delayed = begun is not None and c < begun + 300
        state[k] = (q or delayed, begun, f)
        want.add((k, f, q or delayed, delayed, begun + 300 if delayed else None))
    assert {tuple(r) for r in out.select("tile", "frame", "refining", "delayed", "wake_ms").collect()} == want


def test_hysteresis_by_window(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.uniform(0, 20)) for k in "abc" for i in range(60)]
    got = {(r["k"], r["i"]): r["refining"] for r in O.hysteresis(spark.createDataFrame(rows, "k string, i int, sse double"), key=["k"], order=["i"], threshold=10.0, ratio=0.3, scale=1.2).collect()}
    state = {}
    for k, i, sse in rows:
        state[k] = sse > (7 if state.get(k) else 12)
        assert got[(k, i)] == state[k]


def test_schedule(spark):
    rows = [("r", "a", 1.0, 1), ("r", "b", 5.0, 2), ("r", "a", 9.0, 3), ("r", "c", 5.0, 4), ("r", "d", 7.0, 5), ("q", "a", 1.0, 1)]
    asked = spark.createDataFrame(rows, "key string, resource string, priority double, ord long")
    running = spark.createDataFrame([("r", "d")], "key string, resource string")
    got = [(r["key"], r["resource"]) for r in O.schedule(asked, key=["key"], slots=3, running=running).orderBy("key", "rank").collect()]
    assert got == [("q", "a"), ("r", "a"), ("r", "b")]


def test_frames_and_late_results(spark):
    cams = spark.createDataFrame([("r", 1, 1, 5.0, 1), ("r", 1, 2, 6.0, 4), ("r", 2, 3, 7.0, 8)], "runtime string, batch int, ord int, x double, change_flags int")
    got = {r["batch"]: (r["x"], r["change_flags"], r["pushed"]) for r in O.coalesce_frames(cams, key=["runtime"], batch="batch", order="ord").collect()}
    assert got == {1: (6.0, 5, 2), 2: (7.0, 8, 1)}
    results = spark.createDataFrame([("t", 1, False), ("t", 2, False), ("t", 2, True)], "tile string, activation_id int, aborted boolean")
    assert O.drop_late(results, spark.createDataFrame([("t", 2)], "tile string, activation_id int"), key=["tile"]).count() == 1
    loads = spark.createDataFrame([("t", "content", "failed", 1), ("t", "content", "cancelled", 2), ("u", "subtree", "cancelled", 1), ("u", "subtree", "failed", 2), ("u", "subtree", "failed", 3), ("w", "content", "failed", 1), ("w", "content", "evicted", 2), ("w", "content", "failed", 3)], "tile string, kind string, outcome string, ord int")
    got = {r["tile"]: (r["attempts"], r["may_retry"]) for r in O.counted_attempts(loads, key=["tile"]).collect()}
    assert got == {"t": (1, True), "u": (3, False), "w": (1, True)}


def swept(rows, budgets):
    """One entry after another, the least recently used first."""
    n, cpu, gpu = len(rows), sum(r[4] for r in rows), sum(r[5] for r in rows)
    out = {}
    for id_, touched, seq, stale, c, g, protected in sorted(rows, key=lambda r: (r[1], r[2])):
        if protected:
            continue
        why = "stale" if stale else "entry-budget" if n > budgets.max_contents else "cpu-budget" if cpu > budgets.max_cpu_bytes else "gpu-budget" if gpu > budgets.max_gpu_bytes else None
        if why:
            out[id_] = why
            n, cpu, gpu = n - 1, cpu - c, gpu - g
    return out


def test_sweeps_equal_going_one_by_one(spark):
    rng = random.Random(4)
    budgets = C.Budgets(max_contents=20, max_cpu_bytes=900, max_gpu_bytes=500)
    data, want = [], {}
    for key in range(40):
        limit = rng.randrange(12)
        rows = [(f"{key}-{i}", t := rng.randrange(12), i, t < limit // 3, rng.randrange(80), rng.randrange(40), rng.random() < 0.3) for i in range(rng.randrange(5, 45))]
        data += [(key, *r) for r in rows]
        want |= swept(rows, budgets)
    df = spark.createDataFrame(data, "key int, content_id string, touched int, seq int, stale boolean, cpu long, gpu long, protected boolean")
    assert {r["content_id"]: r["reason"] for r in C.evict_contents(df, key=["key"], budgets=budgets).collect()} == want
    forced = C.evict_contents(df, key=["key"], budgets=budgets, force=True)
    assert forced.count() == sum(not r[-1] for r in data)
    after = C.evict_effects(df.withColumns({"status": F.lit("ready"), "attempts": F.lit(2)}), forced, key=["key"])
    assert after.where("status = 'idle' AND cpu = 0 AND attempts = 0").count() == forced.count()
    with pytest.raises(ValueError):
        C.Budgets(max_contents=-1)


def test_branches(spark):
    rows = [(1, "a", "r", 1, 5, True, False), (1, "b", "r", 1, 9, False, True), (1, "a/0", "a", 2, 4, True, False), (1, "b/0", "b", 2, 2, False, False), (1, "b/1", "b", 2, 3, False, False)]
    df = spark.createDataFrame(rows, "key int, tile_id string, parent_id string, depth int, touched int, stale boolean, protected boolean")
    got = {(r["tile_id"], r["reason"]) for r in C.prune_branches(df, budgets=C.Budgets(max_tiles=4)).collect()}
    assert got == {("b", "node-budget"), ("a", "stale")}


def test_figures(spark):
    rows = spark.createDataFrame([("m", 1, 2.0), ("m", 2, 8.0), ("m", 3, 5.0)], "name string, seq int, value double")
    r = X.metric_aggregate(rows).first()
    assert (r["count"], r["sum"], r["min"], r["max"], r["latest"]) == (3, 15, 2, 8, 5)
    errors = spark.createDataFrame([("r", "content.load", "x"), ("r", "hook", "y")], "key string, phase string, message string")
    assert sorted((e["name"], e["for_hooks"]) for e in X.error_events(errors).collect()) == [("content.error", True), ("runtime.error", False), ("runtime.error", True)]


def test_dense_hierarchy_grafts_and_ancestors(spark):
    roots = spark.createDataFrame([(0, 0, 0), (2, 0, 0), (2, 3, 3)], "level int, x long, y long")
    subtrees = roots.withColumn("subtree", dense_subtree(F.col("level"), F.lit(2), F.lit(3), F.lit(1)))
    got = H.materialize(subtrees, subtree_levels=2, available_levels=3)
    assert got.count() == 1 + 4 + 16
    uris = {r["uri"] for r in H.implicit_contents(got.where("level = 1"), subtrees, ["{level}/{x}/{y}"]).collect()}
    assert uris == {"1/0/0", "1/0/1", "1/1/0", "1/1/1"}
    assert H.missing_subtrees(got, subtrees).count() == 14
    base = spark.createDataFrame([(level, x, y) for level in range(4) for x in range(1 << level) for y in range(1 << level)], "level int, x long, y long")
    out = H.grafted(base, spark.createDataFrame([(1, 0, 0)], "level int, x long, y long"), 2)
    assert out.where("context IS NULL AND level = 3").count() == 48 and out.where("context IS NOT NULL AND level = 1").count() == 4
    up = {(r["ancestor"], r["distance"]) for r in H.ancestors(spark.createDataFrame([("a/b/c",)], "tile_id string")).collect()}
    assert up == {("a/b", 1), ("a", 2)}
    tiles = spark.createDataFrame([("r", None, 0, [2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 1.0]), ("r/0", "r", 1, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 1.0]), ("r/1", "r", 1, None)], "tile_id string, parent_id string, depth int, transform array<double>")
    world = {r["tile_id"]: r["world"] for r in H.world_transforms(tiles).collect()}
    assert world["r/0"][12] == 7 and world["r/1"][12] == 1
    over = H.overridden(tiles.select("tile_id", "depth"), spark.createDataFrame([("r", 9, "x")], "tile_id string, depth int, note string"), ["tile_id"])
    assert {(r["tile_id"], r["depth"], r["note"]) for r in over.collect()} == {("r", 9, "x"), ("r/0", 1, None), ("r/1", 1, None)}


DEFINITIONS = [
    ("s", "Deposit", "grade", 0, "SCALAR", "UINT8", None, False, None, True, "1", "10", None, None, True, "ORE_GRADE"),
    ("s", "Deposit", "status", 1, "ENUM", None, "Status", False, None, False, None, None, None, None, False, None),
    ("s", "Deposit", "quality", 2, "SCALAR", "FLOAT32", None, False, None, False, None, None, "-1", "42", False, None),
    ("s", "Deposit", "label", 3, "STRING", None, None, False, None, False, None, None, None, '"Unnamed"', False, None),
    ("s", "Deposit", "place", 4, "VEC3", "INT16", None, False, None, True, "[1, 2, 3]", "[10, 10]", None, None, False, None),
    ("s", "Deposit", "list", 5, "SCALAR", "UINT8", None, True, 2, False, None, None, None, None, False, None),
]
KIND = "schema_id string, class string, property string, prop_ord int, type string, component_type string, enum_type string, is_array boolean, count int, normalized boolean, offset string, scale string, no_data string, default_value string, required boolean, semantic string"


def test_metadata(spark):
    definitions = spark.createDataFrame(DEFINITIONS, KIND).withColumns({c: F.parse_json(c) for c in ("offset", "scale", "no_data", "default_value")})
    bags = [{"grade": 255, "status": "OPEN", "quality": -1, "place": [32767, -32768, 0], "list": [1, 2]}, {"grade": 300, "status": "GONE", "extra": 1, "place": [1, 2], "list": [1]}, {"grade": 64}]
    scopes = spark.createDataFrame([(1, i, s, "o", "s", "Deposit") for i, s in enumerate(("tile", "content", "feature"))] + [(1, 3, "feature", "o", "s", "Other"), (1, 4, "feature", "o", "none", "Deposit")], "snapshot int, scope_ord int, scope string, owner string, schema_id string, class string")
    said = spark.createDataFrame([(1, i, k, n, json.dumps(v)) for i, b in enumerate(bags) for n, (k, v) in enumerate(b.items())], "snapshot int, scope_ord int, property string, ord int, raw string").withColumn("raw", F.parse_json("raw"))
    enums = spark.createDataFrame([("s", "Status", "OPEN")], "schema_id string, enum string, name string")
    rows = M.resolve_metadata(scopes, said, definitions, enums)
    got = {(r["scope_ord"], r["property"]): r for r in rows.drop("raw").withColumn("source", F.to_json("source")).collect()}
    assert got[(0, "grade")]["number"] == 11 and got[(0, "quality")]["number"] == 42 and got[(0, "quality")]["from_default"] and got[(0, "quality")]["is_no_data"]
    assert got[(0, "place")]["numbers"] == [pytest.approx(11), pytest.approx(-8), pytest.approx(3)] and got[(0, "label")]["source"] == '"Unnamed"'
    issues = {k: r["issue"] for k, r in got.items() if r["issue"]}
    assert issues == {(1, "grade"): "METADATA_PROPERTY_TYPE", (1, "status"): "METADATA_PROPERTY_TYPE", (1, "extra"): "METADATA_PROPERTY_UNKNOWN", (1, "place"): "METADATA_PROPERTY_TYPE", (1, "list"): "METADATA_PROPERTY_TYPE"}
    assert M.find_by_semantic(rows, "ORE_GRADE").first()["scope_ord"] == 2
    wrong = {(r["scope_ord"], r["code"], r["severity"]) for r in M.scope_issues(scopes, definitions, spark.createDataFrame([("s",)], "schema_id string")).collect()}
    assert wrong == {(3, "METADATA_CLASS_UNKNOWN", "error"), (4, "METADATA_SCHEMA_UNAVAILABLE", "warning")}
    contents = spark.createDataFrame([("d", "t", 0, 1), ("d", "t", 1, 0), ("d", "u", 0, None)], "doc_id string, tile_id string, content_index int, group int")
    assert M.group_issues(contents, spark.createDataFrame([("d", 0)], "doc_id string, group_index int")).count() == 1


def test_scopes_in_order(spark):
    tiles = spark.createDataFrame([("r/0/1", "doc", None, "doc#0", "r/0/1/content-0")], "tile_id string, doc_id string, subtree_id string, group_key string, content_id string")
    entities = spark.createDataFrame([("tileset", "doc", "s", "A"), ("tile", "r", "s", "B"), ("tile", "r/0", "s", "C"), ("tile", "r/0/1", "s", "D"), ("content", "r/0/1/content-0", "s", "E"), ("group", "doc#0", "s", "F")], "scope string, owner string, schema_id string, class string")
    got = [(r["scope"], r["class"]) for r in M.collect_scopes(tiles, entities).orderBy("scope_ord").collect()]
    assert got == [("tileset", "A"), ("ancestor-tile", "B"), ("ancestor-tile", "C"), ("tile", "D"), ("group", "F"), ("content", "E")]
