"""Every training-data operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from xxhash import xxh64_intdigest

from tessella.llm import decontaminate, kdtree, licenses, media, mixing, quality, simhash, tokencount, tokenstore, warc
from tessella.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node int, key string"
LONG = "word " * 30_000 + "Released under the MIT License. " + "tail " * 20_000
ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", "a", 0),
    (9003, " \t\n", None, "b", 3),
    (9004, "É’ÄÖ ß ñandú 你好 世界 🙂", "xx", None, 9),
    (9005, LONG, "en", "hot", len(LONG)),
    (9006, "the same text in two rows", "en", "hot", 1),
    (9006, "the same text in two rows", "en", "hot", 1),
    (9007, "the same text in two rows", "en", "hot", 1),
    (9008, "Upper UPPER CASE Words of Five and more in THIS one", "en", "hot", 1),
]


@pytest.fixture(scope="module")
def rows(spark, data):
    base = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    return [(*r, 1, 2, "clash") for r in [*base, *ODD]]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(text):
    return (text or "").encode()


def pairs(items):
    """Sorted, for comparing rows whose ids repeat."""
    return sorted(items, key=repr)


# media -----------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, none, rows):
    got = media.round_trip(docs).collect()
    want = []
    for r in rows:
        text = utf8(r[1])
        payload = text.ljust(max(192, -(-len(text) // 192) * 192), b" ")
        want.append((r[0], len(text), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert pairs((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == pairs(want)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert all("continuity=0;tables=0;damaged=0" in r["feature"] and r["media_bytes"] % 188 == 0 for r in got)
    assert media.round_trip(none).count() == 0


def test_media_damage_is_found():
    payload = bytes(range(256)) * 60
    stream = media.mux(payload)
    whole = media.demux(stream)
    assert whole.payload == payload and whole.programs == {1: media.PMT_PID} and list(whole.streams) == [media.ES_PID]
    assert len(whole.access_points) == -(-len(whole.pts) // media.GROUP) and whole.pts[1] - whole.pts[0] == media.UNIT * media.TICKS // media.RATE
    lost = media.demux(stream[: 188 * 5] + stream[188 * 6 :])
    assert lost.continuity_errors == 1 and lost.damaged == 1 and lost.payload != payload
    twice = media.demux(stream[: 188 * 6] + stream[188 * 5 :])
    assert twice.continuity_errors == 0 and twice.payload == payload
    bad = bytearray(stream)
    bad[20] ^= 1  # in the association table
    assert media.demux(bytes(bad)).table_errors == 1
    bad = bytearray(stream)
    bad[188 * 4] = 0
    assert media.demux(bytes(bad)).damaged >= 1
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7


# quality ---------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality(documents, labels).collect()}
    assert len(got) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    flipped = labels.withColumn("quality", 1 - labels.quality).where(quality.held_out(labels.doc_id)).unionByName(labels.where(~quality.held_out(labels.doc_id)))
    again = {r["doc_id"]: r["score"] for r in quality.quality(documents, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}  # held-out labels are not looked at, and reruns agree


def test_quality_on_odd_rows(spark, docs, none, rows):
    labels = spark.createDataFrame([(0, 1), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got}) == 1  # one class alone: the same score for all
    assert quality.quality(none, labels).count() == 0
    kept = quality.good_documents(docs, spark.createDataFrame([], "doc_id long, quality int"), threshold=0.4)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_attention_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    net = quality.Network.new()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.random((6, quality.WIDTH))
    loss = lambda: -np.mean([np.log(s if t else 1 - s) for s, t in zip(net.forward(x, counts)["score"], y)])
    grad = net.gradient(x, counts, y)
    for k, at in (("E", (3, 4)), ("V", (2, 1)), ("U", (5, 3)), ("w", (2,)), ("o", (7,)), ("c", (0,)), ("e", (6,))):
        net.weights[k][at] += 1e-5
        up = loss()
        net.weights[k][at] -= 2e-5
        down = loss()
        net.weights[k][at] += 1e-5
        assert grad[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    assert net.forward(x, counts)["a"][1:4].sum() == pytest.approx(1)


def test_passages_do_not_depend_on_what_stands_beside():
    import numpy as np

    texts = [b"one two three", b"", b"word " * 500, b"a | b | c\nd", LONG.encode()]
    together, counts = quality.passages(texts)
    assert np.array_equal(together, np.concatenate([quality.passages([t])[0] for t in texts]))
    assert counts.tolist() == [1, 1, 13, 1, -(-50_005 // 40)]


def plain_passages(text):
    """The features of each passage, a byte after another."""
    from math import log, sqrt

    spaces = b" \t\n\x0b\x0c\r"
    words = [(m.start(), m[0]) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text)]
    n = max(1, -(-len(words) // 40))
    pairs_of, begun = [defaultdict(int) for _ in range(n)], 0
    starts = {at for at, _ in words}
    for i, byte in enumerate(text):
        begun += i in starts
        follows = text[i + 1] if i + 1 < len(text) else 10
        pairs_of[max(begun - 1, 0) // 40][(quality.KIND[byte], quality.KIND[follows])] += 1
    out = []
    for k in range(n):
        own = [w for _, w in words[40 * k : 40 * k + 40]]
        total, row = sum(pairs_of[k].values()), [0.0] * quality.WIDTH
        for (a, b), count in pairs_of[k].items():
            row[a * quality.KINDS + b] = sqrt(count / total)
        some = max(1, len(own))
        row[-5:] = [len(set(own)) / some, sum(a == b for a, b in zip(own, own[1:])) / some, sum(map(len, own)) / some / 10, log(1 + len(own)) / 4, float(not own)]
        out.append(row)
    assert all(text[at - 1 : at] in (b"", *[bytes([c]) for c in spaces]) for at in starts)
    return out


def test_quality_against_plain_loops():
    from math import exp, tanh

    import numpy as np

    texts = [b"One two  two three.\n42 | x", b"", b" \t", "É ñandú 你好, ok".encode(), b"word other " * 130 + b"end", b"a " * 40 + b"tail"]
    net, (found, counts) = quality.Network.new(7), quality.passages(texts)
    want = [plain_passages(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and np.allclose(found, np.array([row for w in want for row in w]), atol=1e-6)
    p = {k: v.astype(float) for k, v in net.weights.items()}
    squash = lambda v: 1 / (1 + exp(-v))
    for score, bag in zip(net.scores(texts), want):
        hidden = [[max(0.0, sum(x * p["E"][i][j] for i, x in enumerate(row)) + p["e"][j]) for j in range(quality.HIDDEN)] for row in bag]
        gate = [sum(tanh(sum(h[i] * p["V"][i][j] for i in range(quality.HIDDEN))) * squash(sum(h[i] * p["U"][i][j] for i in range(quality.HIDDEN))) * p["w"][j] for j in range(quality.GATE)) for h in hidden]
        weights = [exp(g) / sum(map(exp, gate)) for g in gate]
        assert score == pytest.approx(squash(sum(a * h[j] * p["o"][j] for a, h in zip(weights, hidden) for j in range(quality.HIDDEN)) + p["c"][0]), abs=1e-5)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT_BYTES", 50)
    text = b"word " * 30 + b"x" * 270 + b" tail"
    parts = quality.segments(text)
    assert b"".join(parts) == text and all(p.lstrip().startswith((b"word", b"x", b"tail")) for p in parts) and max(map(len, parts)) <= 100
    assert quality.segments(b"") == [b""] and quality.passages([text])[1][0] == len(parts)


def test_fitting_takes_whole_documents_up_to_a_bound(spark):
    rows = [(i, ("good words here " if i % 2 else "| # | ") * (15 if i else 40_000)) for i in range(120)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.quality(documents, labels, sample_passages=500).collect()}
    assert got == {i: i % 2 for i in range(120)}


# mixing ----------------------------------------------------------------------------------------------------------


def test_mix(docs, none, rows):
    got = mixing.taken(docs).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert pairs((r["doc_id"], r["size"]) for r in got) == pairs((r[0], size(r[1])) for r in rows)
    source = {}
    for r in rows:
        source[r[3]] = source.get(r[3], 0) + size(r[1])
    names = sorted((s for s in source if s is not None)) + ([None] if None in source else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(source.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * source[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * source[s]
            left -= target[s]
        open_ -= over
    of = {(r[0], size(r[1])): r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = of[(r["doc_id"], r["size"])]
        assert r["source_size"] == source[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    block = max(1, -(-int(sum(target.values())) // mixing.SLOTS))
    for s in names:
        assert abs(taken[s] - target[s]) <= 40 * block + 2
    assert pairs(map(tuple, mixing.taken(docs).collect())) == pairs(map(tuple, got))
    assert mixing.taken(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(none).count() == 0


def test_mix_of_tiny_sources_in_large_blocks(spark):
    small = [(None, 3), ("a", 1), ("b", 7), ("c", 40), ("d", 260)]
    rows = [(i, "w " * 50, "hot") for i in range(2000)]
    rows += [(10_000 + 100 * k + i, "w " * min(5, n - 5 * i), s) for k, (s, n) in enumerate(small) for i in range(-(-n // 5))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(frame, slots=64).join(frame.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) // 64 > 1000
    for s in (None, "a", "b", "c", "d", "hot"):
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.01, abs=0.5)
    slots = [r["slot"] for r in mixing.mix(frame, slots=64).where("slot IS NOT NULL").select("slot", "at").distinct().collect()]
    assert sorted(slots) == list(range(len(slots)))
    assert {r["source"] for r in mixing.mixed_documents(frame, slots=64).collect()} == {s for s, _ in small} | {"hot"}


def test_mix_follows_its_schedule(spark):
    """Every stretch of the schedule holds the sources in proportion to their targets, and another sequence gives another mix."""
    rows = [(i, "w " * (1 + i % 90), "aaaaaaabbc"[i % 10]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = mixing.source_targets(frame.selectExpr("source", "1L + doc_id % 90 AS size"))
    total = targets.agg({"total": "max"}).first()[0]
    share = {r["at"]: r["target"] / total for r in targets.collect()}
    slots, _ = mixing.schedule(targets, total, 2000)
    order = [r["at"] for r in slots.orderBy("slot").collect()]
    seen = dict.fromkeys(share, 0)
    for n, at in enumerate(order, 1):
        seen[at] += 1
        assert all(abs(seen[s] - n * share[s]) <= 6 for s in share)  # a random order would be off by 20
    assert [r["rank"] for r in slots.where("at = 1").orderBy("slot").collect()] == list(range(seen[1]))
    points = [int(f"{i:032b}"[::-1], 2) / 2**32 for i in range(len(order))]
    ends = [sum(share[a] for a in sorted(share) if a <= s) for s in sorted(share)]
    drawn = [next(s for s, e in zip(sorted(share), ends) if p < e) for p in points]
    assert sum(a == b for a, b in zip(order, drawn)) > 0.5 * len(order) and order[:50] == drawn[:50]
    first = lambda **more: {r["doc_id"]: r["first_slot"] for r in mixing.taken(frame, slots=2000, **more).collect()}
    mine, other = first(), first(point=lambda i: (i * 0.6180339887498949) % 1.0)
    assert mine != other and sum(v is not None for v in mine.values()) == sum(v is not None for v in other.values())
    kept = [r["doc_id"] for p in mixing.mixed_documents(frame, slots=2000).rdd.glom().collect() for r in p]
    firsts = [mine[d] for i, d in enumerate(kept) if d not in kept[:i]]
    assert firsts == sorted(firsts) and len(firsts) > 1000  # rows stand in the order of slots


def test_mixed_documents_are_those_taken(spark):
    rows = [(i % 40 if i % 7 else None, f"text {i % 25} " * (i % 6), "abc"[i % 3] if i % 11 else None, i, "k") for i in range(300)] + [(5, "one row thrice", "a", 1, "k")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, key long, again string")
    taken = mixing._taken(mixing.mix(frame), 2).collect()
    times = defaultdict(int)
    for r in taken:
        times[r["key"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    keyed = frame.withColumn("k", mixing.row_key(frame.doc_id, frame.source, frame.text, "mix"))
    names = {r["k"]: (r["doc_id"], r["text"], r["source"]) for r in keyed.collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(frame).collect():
        got[(r["doc_id"], r["text"], r["source"])] += 1
    assert got == {names[k]: n for k, n in times.items() if n} and sum(got.values()) > 200
    by_row = defaultdict(int)
    for r in mixing.mixed_documents(frame).collect():
        by_row[tuple(r)] += 1
    assert set(by_row) <= set(rows)


# archives --------------------------------------------------------------------------------------------------------


def test_archives(spark, data):
    fake = "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 7\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 5\r\n\r\nab\r\n\r\n\r\n\r\n"
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    pages += [(5001, "http://a\r\nb", fake), (5002, None, None), (5003, "u", ""), (5004, "u", "short"), (5005, "u", "short"), (5006, "u", "é" * 60), (5007, "v", "é" * 60), (None, "w", "é" * 60), (5001, "u", fake)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int")
    got = [tuple(r) for r in warc.round_trip(frame, file_bytes=200_000).collect()]
    first = {}
    for i, _, h in pages:
        if len(utf8(h)) >= 100 and i is not None:
            first[utf8(h)] = min(i, first.get(utf8(h), i))
    want = []
    for i, _, h in pages:
        at = first.get(utf8(h))
        again = at is not None and i != at
        want.append((i, len(utf8(h)), sha256(utf8(h)).hexdigest(), "revisit" if again else "response", at if again else None))
    assert pairs(got) == pairs(want)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_archives_of_long_urls(spark, tmp_path):
    pages = [(i, "http://a/" + "u" * (200_000 if i % 3 == 1 else 9), f"{i % 7} " * 200) for i in range(20)]
    pages += [(20, "WARC/1.1", "a WARC/1.1\r\nContent-Length: 1\r\n" * 4000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = [tuple(r) for r in warc.round_trip(frame).collect()]
    again = lambda i: 7 <= i < 20
    assert pairs(got) == pairs((i, len(h), sha256(utf8(h)).hexdigest(), "revisit" if again(i) else "response", i % 7 if again(i) else None) for i, _, h in pages)
    warc.write(frame, str(tmp_path / "cut"))
    (part,) = (tmp_path / "cut").glob("part-*")
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "part-0").write_bytes(part.read_bytes()[:-3000])
    with pytest.raises(ValueError):
        warc.read(spark, str(tmp_path / "short"))
    (tmp_path / "spoilt").mkdir()
    (tmp_path / "spoilt" / "part-0").write_bytes(part.read_bytes().replace(b"3 3 3 3", b"3 4 3 3", 1))
    with pytest.raises(ValueError):
        warc.read(spark, str(tmp_path / "spoilt"))


def test_archives_of_text_ids_and_uneven_sizes(spark, tmp_path, monkeypatch):
    big, middle = "b" * 900_000, "m" * 30_000
    pages = [("a\r\nb", "u", big), ("", "u", "empty id " * 20), (None, "u", "no id " * 20), ("=x é/%", "u", middle), ("z", "u", middle), ("z", "u", middle), ("zz", "u", big)]
    pages += [(f"p{i:03}", "u", f"{i} " * 60) for i in range(300)] + [(f"q{i:03}", "u", "a copied page " * 10) for i in range(100)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id string, url string, html string, copied string").coalesce(1)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    again = lambda i, h: h in first and i != first[h]
    want = pairs((i, len(h), sha256(utf8(h)).hexdigest(), "revisit" if again(i, h) else "response", first[h] if again(i, h) else None) for i, _, h in pages)
    assert pairs(map(tuple, warc.round_trip(frame, file_bytes=20_000).collect())) == want
    warc.write(frame, str(tmp_path / "files"), file_bytes=20_000)
    sizes = [f.stat().st_size for f in (tmp_path / "files").glob("part-*")]
    assert max(sizes) < 905_000 and sum(s > 400_000 for s in sizes) == 1
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)  # as for copies too many to broadcast
    assert pairs(map(tuple, warc.round_trip(frame).collect())) == want


# shards ----------------------------------------------------------------------------------------------------------


def test_shards(docs, none, rows):
    got = kdtree.partition(docs).collect()
    assert pairs((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == pairs((r[0], len(utf8(r[1])) + 1, zlib.crc32(utf8(r[1]))) for r in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdtree.partition(none).count() == 0
    same = kdtree.partition(docs.select("doc_id", "text", "lang", "source")).collect()
    assert pairs((r["doc_id"], r["shard"]) for r in same) == pairs((r["doc_id"], r["shard"]) for r in got)


def plain_tree(rows, target=None, depth=4):
    """Paths of the leaves, by a walk over lists; rows: (four numbers, tie, size)."""
    root = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) or 1.0 for d in range(4)]
    out = {}

    def walk(own, path):
        whole = sum(rows[i][2] for i in own)
        if (len(path) == depth) if target is None else (whole <= target or len(own) == 1):
            out.update(dict.fromkeys(own, path))
            return
        width = [(max(rows[i][0][d] for i in own) - min(rows[i][0][d] for i in own)) / root[d] for d in range(4)]
        d, at, sides = width.index(max(width)), 0, ([], [])
        for i in sorted(own, key=lambda i: (rows[i][0][d], rows[i][1])):
            sides[2 * at + rows[i][2] > whole].append(i)
            at += rows[i][2]
        for side, digit in zip(sides, "01"):
            if side:
                walk(side, path + digit)

    walk(list(range(len(rows))), "")
    return [out[i] for i in range(len(rows))]


def test_shards_are_cut_at_weighted_medians(docs, rows):
    from hashlib import md5
    from math import log2

    code = lambda t: -1.0 if t is None else float(int.from_bytes(t.encode()[:6].ljust(6, b"\0"), "big"))
    made = []
    for r in rows:
        size, crc = len(utf8(r[1])) + 1, zlib.crc32(utf8(r[1]))
        made.append(((log2(size), code(r[3]), code(r[2]), float(r[0])), int(md5(f"{r[0]}:{crc}".encode()).hexdigest()[:15], 16), size))
    got = pairs((r["doc_id"], r["shard"]) for r in kdtree.partition(docs).collect())
    assert got == pairs((r[0], int(p, 2)) for r, p in zip(rows, plain_tree(made)))
    paths = plain_tree(made, target=500)
    number = {p: i for i, p in enumerate(sorted(set(paths)))}
    got = kdtree.partition(docs, shards=None, target_bytes=500).collect()
    assert len(number) > 150 and pairs((r["doc_id"], r["shard"]) for r in got) == pairs((r[0], number[p]) for r, p in zip(rows, paths))


def test_shards_are_even(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    copies = d.unionAll(d.where("doc_id = 3").crossJoin(spark.range(400)).drop("id"))
    by = defaultdict(int)
    for r in kdtree.partition(copies).collect():
        by[r["shard"]] += r["size"]
    mean = sum(by.values()) / 16
    longest = copies.selectExpr("max(octet_length(text))").first()[0]
    assert len(by) == 16 and max(by.values()) < mean + longest + 1 and min(by.values()) > mean - longest - 1


def test_shards_of_text_ids(spark):
    rows = [(f"id {i}" if i % 5 else None, "w " * (i % 9), "s", None) for i in range(200)]
    got = kdtree.partition(spark.createDataFrame(rows, "doc_id string, text string, source string, lang string")).collect()
    assert pairs(r["doc_id"] for r in got) == pairs(r[0] for r in rows) and len({(r["shard"], r["slot"]) for r in got}) == 200


# token ids -------------------------------------------------------------------------------------------------------


def test_token_store(spark, docs, none, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    ids = [e.ids + [1] for e in whole.encode_batch_fast([r[1] or "" for r in rows], add_special_tokens=False)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], len(ids[i])))
    want, start = [], 0
    for i in order:
        want.append((rows[i][0], start, len(ids[i]), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[i])), True))
        start += len(ids[i])
    assert pairs(tuple(r) for r in tokenstore.round_trip(docs, path).collect()) == pairs(want)
    assert tokenstore.round_trip(none, path).count() == 0


def test_chunks_are_stored_once_and_rebuilt(spark, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    base = " ".join(f"word{i} thing{i * 7 % 1000}" for i in range(4000))
    docs = spark.createDataFrame([(1, base), (2, "before " + base), (3, base), (4, None)], "doc_id long, text string")
    tokenstore.write(docs, str(tmp_path), path)
    store = spark.read.parquet(f"{tmp_path}/rows")
    recipes = {r["doc_id"]: [bytes(c["digest"]) for c in r["recipe"]] for r in store.collect()}
    assert len(set(recipes[1]) & set(recipes[2])) >= len(recipes[1]) - 2  # cut by content, not by place
    kept = store.selectExpr("explode(recipe) AS c").where("c.here").select("c.digest").collect()
    assert len(kept) == len({bytes(r[0]) for r in kept}) == len({d for v in recipes.values() for d in v})
    got = {r["doc_id"]: bytes(r["ids"]) for r in tokenstore.reconstruct(spark, str(tmp_path), [1, 2, 3, 4]).collect()}
    words = tokenstore.WordEncoder(path)
    assert all(got[i] == ids + (1).to_bytes(2, "little") for i, ids in zip((1, 2, 3, 4), words([base.encode(), b"before " + base.encode(), base.encode(), b""])))
    assert all(r["verified"] for r in tokenstore.read(spark, str(tmp_path)).collect())


def test_words_are_encoded_like_whole_texts(rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = [r[1] or "" for r in rows] + ["foo's CAN'T 12345 a,b. x.. É. ﬁ İ ß. ÿ, \x85 a\xa0b ñ́", "ab, ab. ab", "<|endoftext|> Say <|startoftext|>"]
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    small = tokenstore.WordEncoder(path, remember=50)
    for i in range(0, len(texts), 40):
        assert [list(memoryview(b).cast("H")) for b in small([t.encode() for t in texts[i : i + 40]])] == whole[i : i + 40]


# decontamination -------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, none, rows, data, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    items += [(700, "five and MORE in"), (701, None), (702, "..."), (703, " ".join(["word"] * 13)), (704, "five and more in")]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[at : at + 13])].add(str(i))
    want = []
    for r in rows:
        w = words(r[1])
        hit, named = set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    named |= own
        want.append((r[0], len(w), len(hit), len(named), sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc int")
    got = decontaminate.contamination(docs, bench).drop("digest")
    assert pairs(map(tuple, got.collect())) == pairs(want)
    assert any(w[2] for w in want)
    assert decontaminate.decontaminated(docs, bench).count() == sum(not w[5] for w in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)  # as for a benchmark too large to broadcast
    assert pairs(map(tuple, decontaminate.contamination(docs, bench).drop("digest").collect())) == pairs(want)
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_a_window_of_many_items(spark):
    opening = " ".join(f"w{i}" for i in range(13))
    items = [(i, f"{opening} own{i} more{i}") for i in range(5000)]
    documents = [(1, f"before {opening} after"), (2, f"{opening} own7 more7"), (3, "nothing of it"), (4, None)] + [(10 + i, f"{opening} {i}") for i in range(300)]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    named = sha256(",".join(sorted(str(i) for i in range(5000))).encode()).hexdigest()
    empty = (0, 0, sha256(b"").hexdigest())
    assert got[1] == (13, 5000, named) and got[2] == (15, 5000, named) and got[3] == got[4] == empty and all(got[10 + i] == (13, 5000, named) for i in range(300))


# near duplicates -------------------------------------------------------------------------------------------------


def prints(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spans = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, docs, none, rows):
    fp = [prints(r[1]) if len(r[1] or "") < 100_000 else simhash.fingerprint(r[1].encode()) % (1 << 64) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[top(i)] = min(least[top(i)], r[0])
    got = simhash.components(docs)
    shown = got.select("doc_id", simhash.hex_print(got.fp).alias("f"), "component_id")
    assert pairs(map(tuple, shown.collect())) == pairs((r[0], f"{fp[i]:016x}", least[top(i)]) for i, r in enumerate(rows))
    assert simhash.deduplicated(docs).count() == len({top(i) for i in range(len(rows))})
    assert simhash.components(none).count() == 0


def test_deduplication_of_null_and_repeated_ids(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(80)) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:9]] + [(8, texts[9]), (None, texts[9]), (9, texts[10]), (9, texts[10]), (3, texts[10]), (None, texts[11]), (None, texts[11]), (None, None), (None, "")]
    got = [tuple(r) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = rows[:9] + [(8, texts[9]), (3, texts[10]), (None, texts[11])]
    assert pairs(r for r in got if r[1]) == pairs(want)
    assert len(got) == len(want) + 1  # and one of the two without words


def test_golay_keys_miss_no_pair(spark):
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in {*base, *near}], "fp long"))
    from tessella.llm.graphs import connected_components

    root = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    for a, b in zip(base, near):
        assert a == b or root[signed(a)] == root[signed(b)]


def test_hot_keys_lose_no_link(spark, monkeypatch):
    import random

    from tessella.llm.graphs import connected_components

    rng = random.Random(4)
    centre = rng.getrandbits(64)
    some = {centre} | {centre ^ 1 << i for i in range(0, 64, 3)} | {centre ^ 1 << i ^ 1 << (i * 7 + 3) % 64 for i in range(64)} | {centre ^ 0b11111 << i for i in range(0, 60, 5)} | {rng.getrandbits(64) for _ in range(50)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = sorted(map(signed, some))
    root = {p: p for p in prints}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                root[max(top(a), top(b))] = min(top(a), top(b))
    want = {p: top(p) for p in prints if sum(top(q) == top(p) for q in prints) > 1}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for most_paired, rows in ((256, 500_000), (2, 500_000), (2, 0)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
        edges = simhash.links(frame, most_paired)
        assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == want


# token counts ----------------------------------------------------------------------------------------------------


def best_count(pieces, unknown, word):
    """Dynamic programming over one word alone."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        some = [(best[a][0] + pieces[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in pieces]
        if word[end - 1 : end] not in pieces:
            some.append((best[end - 1][0] + unknown, best[end - 1][1] - len(word[end - 1].encode())))
        best[end] = max(some)
    return -best[-1][1]


def test_token_counts(docs, none, rows):
    path = tokenizer_path("piece_bpe_32k.model")
    counter = tokencount.TrieCounter.from_file(path)
    known = {}
    want = []
    for r in rows:
        words = utf8(r[1]).split()
        for w in set(words) - set(known):
            known[w] = best_count(counter.pieces, counter.unknown, tokencount.MARK + w.decode())
        want.append((r[0], len(words), sum(known[w] for w in words)))
    assert pairs(map(tuple, tokencount.token_counts(docs, path).collect())) == pairs(want)
    assert tokencount.token_counts(none, path).count() == 0


def test_archives_with_long_heads():
    """An HTTP head longer than a few kilobytes is no part of the payload."""
    import pyarrow as pa

    payload = b"<html>" + b"x" * 300
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-Field-%d: %s\r\n" % (i, b"y" * 90) for i in range(100)) + b"\r\n" + payload
    head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 5\r\nX-Refers-To-Page-Id: \r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n" % (sha256(payload).hexdigest().encode(), len(block))
    data = head + block + b"\r\n\r\n"
    (found,) = warc._candidates(iter([pa.RecordBatch.from_pydict({"path": ["a"], "content": [data]})]))
    record, end = (list(r.values()) for r in found.to_pylist())
    assert len(payload) in record and record.count(sha256(payload).hexdigest()) == 2 and len(data) in end


# licenses --------------------------------------------------------------------------------------------------------


def shingles(text):
    w = licenses.words(text.encode())
    return [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def plain_scan(scanner, text):
    """Every window of every class, without bands."""
    found = set()
    for window, stride, _, keys, _ in scanner.classes:
        own = set().union(*keys.values())
        row = [g for g in shingles(text) if any(g in scanner.grams[i] for i in own)]
        last = max(0, len(row) - window)
        for at in [*range(0, last, stride), last]:
            held = set(row[at : at + window])
            found |= {scanner.names[i] for i in own if len(held & scanner.grams[i]) >= 0.8 * len(scanner.grams[i])}
    return ",".join(sorted(found))


def test_licenses(docs, none, rows):
    import random

    rng = random.Random(3)
    scanner = licenses.Scanner()
    got = {(r["doc_id"], r["n_words"]): r["licenses"] for r in licenses.license_matches(docs).collect()}
    for r in rows:
        assert got[(r[0], len(licenses.words(utf8(r[1]))))] == plain_scan(scanner, r[1] or "")
    assert got[(9005, 50_005)] == "MIT"
    for _ in range(150):  # with some words changed
        name, text = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "other"
        around = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))
        mixed = f"{around} {' '.join(words)} {around}"
        assert ",".join(sorted({m[0] for m in scanner.matches(mixed.encode())[1]})) == plain_scan(scanner, mixed)
    assert licenses.license_matches(none).count() == 0 and licenses.license_matches(docs, []).where("n_matches > 0").count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner([("x", "too few words")])
    assert licenses.bands_for(1.0) == 1 and (1 - 0.5**2) ** licenses.bands_for(0.5) <= licenses.MISS


def test_license_matches_are_found_in_every_part_of_a_long_text():
    text = ("filler " * 170_000).encode()
    for at in (10, licenses.PART_BYTES - 12, licenses.PART_BYTES + 3, len(text) - 5):
        here = text.rfind(b" ", 0, at) + 1
        n, found = licenses.Scanner().matches(text[:here] + b"Released under the MIT License. " + text[here:])
        assert [m[0] for m in found] == ["MIT"] and n == 170_005 and found[0][1] == len(text[:here].split())


def test_licenses_with_inserted_words_are_found_in_the_whole_text():
    import random

    rng = random.Random(11)
    scanner = licenses.Scanner()

    def whole(text):
        held = set(shingles(text))
        return {scanner.names[i] for i, g in enumerate(scanner.grams) if len(held & g) >= 0.8 * len(g)}

    spread = 0
    for name, text in licenses.TEMPLATES:
        for foreign in (5, 10, 15, 20, 300, 200_000):
            words = text.split()
            at = rng.randrange(len(words))
            text_of = " ".join(["before"] * 30 + words[:at] + [f"x{i}" for i in range(foreign)] + words[at:] + ["after"] * 30)
            n, found = scanner.matches(text_of.encode())
            assert {m[0] for m in found} == whole(text_of) and n == len(licenses.words(text_of.encode()))
            spread += any(m[2] - m[1] > foreign for m in found)
    assert spread > 5


def test_licenses_are_found_through_their_bands_alone(docs):
    import random

    rng = random.Random(5)
    scanner, blind = licenses.Scanner(), licenses.Scanner()
    blind.classes = [(window, stride, seeds, {}, known) for window, stride, seeds, _, known in blind.classes]
    want = got = 0
    for _ in range(400):  # words changed, inserted and left out at several places
        i = rng.randrange(len(licenses.TEMPLATES))
        words = licenses.TEMPLATES[i][1].split()
        for _ in range(rng.randrange(1 + len(words) // 30)):
            words[rng.randrange(len(words)) : rng.randrange(2)] = ["other"] * rng.randrange(1, 40)
        text = " ".join([*(f"w{rng.randrange(90)}" for _ in range(rng.randrange(200))), *words, *["end"] * 9])
        found = {m[0] for m in scanner.matches(text.encode())[1]}
        held = set(shingles(text))
        due = {scanner.names[k] for k, g in enumerate(scanner.grams) if len(held & g) >= 0.8 * len(g)}
        want, got = want + len(due), got + len(due & found)
        assert found <= due and blind.matches(text.encode())[1] == []
    assert want > 200 and got >= 0.99 * want


def test_each_copy_of_a_license_is_a_match():
    scanner = licenses.Scanner()
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300 and t.startswith("Permission"))
    words = mit.split()
    spread = " ".join(w + (" x" * 200 if k in (20, 40) else "") for k, w in enumerate(words))
    for text, copies in ((mit, 1), (f"{mit} and then {spread} z", 2), (f"{mit} {mit} {mit}", 3), ("Released under the MIT License. " * 4, 4)):
        found = scanner.matches(text.encode())[1]
        assert [m[0] for m in found] == ["MIT"] * copies and all(a[2] <= b[1] for a, b in zip(found, found[1:]))
