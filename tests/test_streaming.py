from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tessella.streaming import cuts as C
from tessella.streaming import runtime as S


def run(spark, stream_of, batches, schema, tmp_path, out_schema):
    """The rows that a stream writes for batches of input, one micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
    stream_of(source).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out_schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect()


def test_refinement_across_batches(spark, tmp_path):
    schema = "runtime string, tile_id string, frame long, clock_ms long, sse double, required boolean"
    frame = lambda n, ms, sse: [("r", "t", n, ms, sse, False), ("r", "u", n, ms, 1.0, False)]
    batches = [frame(1, 0, 16.0), frame(2, 100, 9.6), frame(3, 200, 7.8), frame(4, 450, 7.8), frame(5, 550, 7.8), frame(6, 600, 7.8)]
    rows = run(spark, lambda s: S.refinement_stream(s, threshold=10.0, hysteresis=0.2, delay_ms=300), batches, schema, tmp_path, S.REFINEMENT)
    got = {r["frame"]: (r["refining"], r["delayed"], r["changed"]) for r in rows if r["tile_id"] == "t"}
    assert got == {1: (True, False, True), 2: (True, False, False), 3: (True, True, False), 4: (True, True, False), 5: (False, False, True), 6: (False, False, False)}
    assert not any(r["refining"] for r in rows if r["tile_id"] == "u")


def test_load_queue(spark, tmp_path):
    schema = "runtime string, resource string, event string, priority double, attempts int, ord long"
    event = lambda o, name, kind, p=0.0: ("r", name, kind, p, 0, o)
    batches = [[event(1, "a", "request", 1.0), event(2, "b", "request", 1.0), event(3, "c", "request", 2.0), event(4, "b", "request", 5.0)], [event(5, "a", "ready")], [event(6, "b", "failed", 1.0)], [event(7, "c", "cancel"), event(8, "c", "ready")]]
    rows = run(spark, lambda s: S.load_stream(s, slots=1, most_attempts=3), batches, schema, tmp_path, S.LOADS)
    got = [(r["resource"], r["event"]) for r in rows]
    assert got.count(("a", "start")) == 1 and ("a", "ready") in got and ("b", "retry") in got and ("c", "start") in got
    assert ("c", "aborted") in got and ("c", "ready") not in got and got.count(("b", "start")) == 2


def test_latest_camera_of_a_batch(spark):
    rows = spark.createDataFrame([("r", 1, 5.0, 1), ("r", 2, 6.0, 4)], "runtime string, clock_ms long, x double, change_flags int")
    r = S.latest_cameras(rows).first()
    assert (r["x"], r["change_flags"], r["clock_ms"]) == (6.0, 5, 2)


def test_sinks(spark, tmp_path):
    spark.createDataFrame([("v", "a", "enter"), ("v", "b", "leave"), ("v", "c", "stay")], "view string, tile_id string, change string").write.parquet(f"{tmp_path}/in")
    seen = {}
    source = spark.readStream.schema("view string, tile_id string, change string").parquet(f"{tmp_path}/in")
    note = lambda name: lambda df: seen.setdefault(name, []).extend(r["tile_id"] for r in df.collect())
    S.present(source, f"{tmp_path}/state", show=note("show"), hide=note("hide")).awaitTermination()
    assert seen == {"show": ["a"], "hide": ["b"]}
    metrics = spark.createDataFrame([("m", 1.0, 0), ("m", 3.0, 5)], "name string, value double, s long").select("name", "value", F.timestamp_seconds("s").alias("ts"))
    metrics.write.parquet(f"{tmp_path}/metrics")
    stream = S.metric_stream(spark.readStream.schema(metrics.schema).parquet(f"{tmp_path}/metrics"))
    stream.writeStream.format("memory").queryName("figures").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    r = spark.table("figures").first()
    assert (r["count"], r["sum"], r["latest"]) == (2, 4.0, 3.0)


def test_shown_tiles_survive_a_restart(spark, tmp_path):
    """Frames in several micro-batches, with the stream stopped in between: each change is told once, late and repeated frames not at all."""
    from tessella.plans.lod import lod_cut

    depth = 3
    tiles = spark.createDataFrame([(level, x, y) for level in range(depth + 1) for x in range(1 << level) for y in range(1 << level)], "level int, x long, y long")
    spot = lambda n: (n * 1.7 % 8, n * 0.9 % 8)
    frames = [[("a", 1), ("b", 1)], [("a", 2), ("a", 3)], [("a", 3), ("a", 2), ("b", 5)], [("a", 4), ("a", 7), ("b", 6)], [("b", 40)]]
    runs = []

    def run(some):
        for rows in some:
            made = [(v, f, *(spot(f + (v == "b")) if f < 40 else (1e9, 1e9))) for v, f in rows]
            spark.createDataFrame(made, "view string, frame long, cx double, cy double").coalesce(1).write.parquet(f"{tmp_path}/in/{len(runs)}")
            runs.append(rows)
        source = spark.readStream.schema("view string, frame long, cx double, cy double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
        C.cut_stream(source, tiles, depth=depth, threshold=60.0, pixels=2.0).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()

    run(frames[:2])
    run(frames[2:])  # a new query on the same checkpoint
    got = sorted(tuple(r) for r in spark.read.schema(C.CHANGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect())
    cut = lambda cx, cy: {(r["level"], r["x"], r["y"]) for r in lod_cut(tiles, depth=depth, camera=(cx, cy), threshold=60.0, pixels=2.0).collect()}
    want = []
    for view, seen in (("a", [1, 2, 3, 4, 7]), ("b", [1, 5, 6, 40])):
        before = set()
        for f in seen:
            now = cut(*(spot(f + (view == "b")) if f < 40 else (1e9, 1e9)))
            want += [(view, f, *t, c) for c, some in (("enter", now - before), ("stay", now & before), ("leave", before - now)) for t in some]
            before = now
    assert got == sorted(want) and sum(r[5] == "leave" for r in got) > 10


class Remembered:
    """State of one view, kept in memory."""

    def __init__(self):
        self.kept = {}

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: "last" in self.kept, get=lambda: self.kept["last"], update=lambda v: self.kept.update(last=v))

    def getMapState(self, *_):  # noqa: N802
        own = self.kept.setdefault("shown", {})
        return SimpleNamespace(iterator=lambda: iter(list(own.items())), removeKey=own.pop, updateValue=own.__setitem__)


def test_state_meets_a_row_for_each_frame():
    """Frames without their tiles come out in order, each with the camera before it; only the last one's tiles are kept."""
    state = Remembered()
    names = ["view", "frame", "cx", "cy", "level", "x", "y"]

    def handled(*rows):
        p = C.ShownTiles()
        p.init(state)
        parts = [pd.DataFrame([("v", *r)], columns=names) for r in rows]
        return [tuple(r) for out in p.handleInputRows(("v",), iter(parts), None) for r in out.drop(columns="view").itertuples(index=False)]

    mark = lambda f, at: (f, at, 0.0, -1, 0, 0)
    got = handled(mark(3, 3.0), mark(1, 1.0), (3, 3.0, 0.0, 2, 1, 0), mark(2, 2.0), (3, 3.0, 0.0, 2, 1, 1), (2, 2.0, 0.0, 1, 0, 0))
    assert [(r[0], r[1], r[5]) for r in got] == [(1, 1.0, []), (2, 2.0, None), (3, 3.0, None)] and [r[3] for r in got[1:]] == [1.0, 2.0]
    assert set(state.kept["shown"]) == {(2, 1, 0), (2, 1, 1)} and state.kept["last"] == (3,)
    got = handled(mark(3, 9.0), mark(5, 5.0), (5, 5.0, 0.0, 2, 1, 1))
    assert [(r[0], r[1], r[5]) for r in got] == [(5, 5.0, ["2/1/0", "2/1/1"])] and set(state.kept["shown"]) == {(2, 1, 1)}


def test_newest_frames_are_marked():
    frames = [("a", 1), ("b", 7), ("a", 4), (None, 2), ("a", 3), ("b", 7), (None, 1)]
    parts = [pd.DataFrame(frames[i : i + 2], columns=["view", "frame"]).assign(cx=0.0, cy=0.0) for i in range(0, len(frames), 2)]
    got = pd.concat(C.newest_marked(iter(parts)))
    rows = sorted(((v if isinstance(v, str) else ""), f, bool(n)) for v, f, n in zip(got["view"], got["frame"], got["newest"]))
    assert rows == [("", 1, False), ("", 2, True), ("a", 1, False), ("a", 3, False), ("a", 4, True), ("b", 7, True), ("b", 7, True)]


def test_tiles_that_come_and_go_between_restarts(spark, tmp_path):
    """The state keeps what a view shows, also where the table of tiles is another one after a restart; a frame without a camera shows nothing."""
    schema = "view string, frame long, cx double, cy double"
    tiles = lambda *t: spark.createDataFrame(list(t), "level int, x long, y long")
    near = [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    runs = [([("v", 1, 1.0, 1.0), ("v", 2, 1.0, 1.0)], near[:3]), ([("v", 3, 1.0, 1.0), ("v", 4, 1.0, 1.0), ("v", 5, None, 1.0)], near[1:])]
    for i, (rows, some) in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
        C.cut_stream(source, tiles((0, 0, 0), *some), depth=1, threshold=60.0).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r)[1:] for r in spark.read.schema(C.CHANGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect())
    want = [(f, *t, c) for f, c, some in ((1, "enter", near[:3]), (2, "stay", near[:3]), (3, "stay", near[1:3]), (3, "leave", near[:1]), (3, "enter", near[3:]), (4, "stay", near[1:]), (5, "leave", near[1:])) for t in some]
    assert got == sorted(want)


def test_durations_of_streams(spark, tmp_path):
    at = lambda s: 1_700_000_000 + s
    batches = [
        [("load", 1, at(0), True), ("load", 1, at(0), True), ("load", 2, at(5), True), ("load", 1, at(7), False), ("show", 1, at(9), True)],
        [("load", 1, at(8), False), ("load", 2, at(1000), False), ("load", 3, at(990), True), ("show", 1, at(20), False)],
        [("load", 3, at(995), False), ("load", 5, at(980), True), ("load", 5, at(970), False)],
        [("load", 4, at(10), True)],
        [("end", 0, at(90_000), True), ("end", 9, at(90_000), False)],
    ]
    schema = "name string, key long, s long, starts boolean"
    timed = lambda df: df.select("name", "key", F.timestamp_seconds("s").alias("ts"), "starts")
    for i, rows in enumerate(batches):
        timed(spark.createDataFrame(rows, schema)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(timed(spark.createDataFrame([], schema)).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = C.duration_stream(source.where("starts"), source.where("NOT starts"), late="60 seconds", longest="30 seconds")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
    found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["name"], r["key"], r["seconds"]) for r in spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect())
    # told twice: once; an end too long after, or before its start: none; a start 980 seconds behind the newest: lost
    assert [g for g in got if g[0] != "end"] == sorted([("load", 1, 7.0), ("show", 1, 11.0), ("load", 2, None), ("load", 3, 5.0), ("load", 5, None)], key=lambda g: g[:2])
