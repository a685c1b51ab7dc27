"""Product codes, the prefix trie and scores of the language model against brute force, and on odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import attention, lloyd, lm, trie
from tessella.llm.queries import tokenizer_path

# product codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{row: (code, error)} and the codebooks' digest, every part against every entry."""
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    code = lambda part, book: min(range(len(book)), key=lambda k: (distance(part, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            found = defaultdict(list)
            for r in kept:
                found[code(cut(r[2], p), books[p])].append(cut(r[2], p))
            for k, own in found.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, label, v in kept:
        codes = [code(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in codes), sum(distance(cut(v, p), books[p][c]) for p, c in enumerate(codes))))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, label, c, e in out), key=repr)


def vectors(n, seed, size=16):
    rng = random.Random(seed)
    spots = [[rng.uniform(-0.4, 0.4) for _ in range(size)] for _ in range(6)]
    rows = [(i, rng.choice([None, 1, 2]), [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(spots)]) for i in range(n)]
    return rows


def test_codes(spark, monkeypatch):
    rows = vectors(300, 3)
    rows += [(1000 + i, 7, [0.25] * 16) for i in range(100)]  # one vector in a fourth of all rows: leaves of equal points
    rows += [(5, 1, rows[5][2]), (None, 1, rows[9][2]), (2000, 1, None), (2001, 1, [0.1] * 15 + [None]), (2002, None, [float("nan")] * 16), (2003, 1, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(3)
    for block in (4096, 37):
        monkeypatch.setattr(lloyd, "BLOCK", block)
        got = lloyd.coded(df).collect()
        assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr) == plain_codes(rows)


def test_codes_of_few_rows(spark):
    kind = "vec_id long, label string, embedding array<double>"
    assert lloyd.coded(spark.createDataFrame([], kind)).count() == 0
    rows = [(3, "a", [0.5] * 8), (4, None, [0.5] * 8)]
    got = lloyd.coded(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(3, "00" * 8, 0, 0), (4, "00" * 8, 0, 0)]  # ties go to the lower entry
    other = spark.createDataFrame([*rows, (5, "a", [0.5] * 9)], kind)
    assert lloyd.coded(other).count() == 2  # not as long as the first
    with pytest.raises(ValueError):
        lloyd.coded(spark.createDataFrame([(1, "a", [0.5] * 9)], kind))
    with pytest.raises(ValueError):
        lloyd.whole_numbers(np.array([[1e12]]))


def test_trees_filter_and_assign_as_plain_search():
    rng = np.random.default_rng(5)
    for n, spread in ((1, 10), (24, 3), (700, 4), (3000, 400)):
        points = rng.integers(-spread, spread, (n, 3))
        entries = rng.integers(-spread, spread, (16, 3))
        entries[9] = entries[2]
        tree = lloyd.Tree(points[lloyd.planted(points)])
        far = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (tree.codes(entries) == far.argmin(axis=1)).all()
        want = np.zeros((16, 4), dtype=np.int64)
        np.add.at(want[:, 0], far.argmin(axis=1), 1)
        np.add.at(want[:, 1:], far.argmin(axis=1), tree.points)
        assert (tree.totals(entries) == want).all()
    whole, places, _ = tree.nearest(entries * 4)
    assert sum(len(n) for level, n, _ in whole if level < tree.depth) and len(places) < len(tree.points)  # subtrees are assigned at once


# prefix trie -----------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    for c in own:
        own[c] = [t[1:] for t in sorted(own[c], key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))]
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20 if c >= 0 else -(-c - -c % 20), [])[:h] + turns[h:])
    members, closed, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in convs.items():
        closed[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    saved, leaves = Counter(), Counter()
    for path in sorted(members, key=len, reverse=True):
        saved[path] += (len(members[path]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        leaves[path] += not kids[path]
        if path:
            saved[path[:-1]] += saved[path]
            leaves[path[:-1]] += leaves[path]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha256(",".join(map(str, sorted(closed[p]))).encode()).hexdigest()) for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talk(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        for turn in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["yes it is", "no", "", None, "a b  c"][: rng.choice([1, 2, 5])])))
    long = [(i, "user", f"turn {i // 5}") for i in range(40)]
    rows += [(c, *t) for c in (500, 501, 504, 512) for t in long[: 30 + c % 9]]
    rows += [(900 + i, 0, "user", "the same words") for i in range(60)]  # copies, a family of its own
    return rows


@pytest.mark.parametrize("seed, sizes", [(1, (64, 4096, 1000, 4096)), (2, (2, 4, 3, 2)), (3, (1, 3, 2, 3))])
def test_trie(spark, monkeypatch, seed, sizes):
    for name, size in zip(("CHUNK", "BLOCK", "PACK", "STRETCH"), sizes):
        monkeypatch.setattr(trie, name, size)
    rows = talk(seed) if seed > 1 else talk(seed, 60)
    rows += [(None, 0, "user", "of no conversation"), (3, None, "user", "before all"), (3, None, None, None), (-7, 2, "user", "late"), (-7, 1, "user", "early"), (7, 7, "x", "long " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int").repartition(4)
    by_digest = [(c, t, r, x) for c, t, r, x in rows]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df).collect())
    assert got == plain_trie(by_digest)


def test_trie_of_little(spark):
    kind = "conv_id long, turn int, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    got = trie.prefix_trie(spark.createDataFrame([(25, 0, "a", "b")], kind)).collect()  # its first turns come from a family that is absent
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_trie([(25, 0, "a", "b")])


def test_nearest_smaller_values_and_least_of_spans(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rng = random.Random(8)
    v = [-1, *[rng.randrange(12) for _ in range(300)], *range(40, 0, -1)]
    df = spark.createDataFrame(list(enumerate(v)), "at long, v long")
    got = {r["at"]: (r["before"], r["after"]) for r in trie.nearest_smaller(df).collect()}
    for i, x in enumerate(v):
        before = max((j for j in range(i) if v[j] < x), default=None)
        after = min((j for j in range(i + 1, len(v)) if v[j] < x), default=None)
        assert got[i] == (before, after)
    spans = [tuple(sorted(rng.sample(range(len(v)), 2))) for _ in range(100)] + [(5, 5), (0, len(v) - 1)]
    found = trie.least_between(df, spark.createDataFrame(spans, "low long, high long")).collect()
    assert len(found) == len(spans) and all(r["least"] == min(v[r["low"] : r["high"] + 1]) for r in found)


# language model --------------------------------------------------------------------------------------------------


def tiny():
    rng = np.random.default_rng(2)
    return attention.Attention.new(rng.integers(1, 9, 20).astype(float), depth=3, hidden=5, classes=4), rng


def test_windows_score_each_id_once():
    lengths = np.array([1, 16, 17, 40])
    ids = np.arange(3, 3 + lengths.sum())
    x, y, place = attention.windows(ids, lengths)
    assert (y.ravel()[place] == ids).all() and len(set(place.tolist())) == len(ids)
    at = 0
    for n in lengths.tolist():
        own = [attention.START] * (attention.CONTEXT + 1) + ids[at : at + n].tolist()
        for i in range(n):  # what a window shows before a target is what stands before it
            row, col = divmod(int(place[at + i]), attention.SCORED)
            seen = x[row, : attention.CONTEXT + col + 1].tolist()
            assert seen == own[attention.CONTEXT + 1 + i - len(seen) : attention.CONTEXT + 1 + i]
        at += n


def test_gradient():
    model, rng = tiny()
    x, y = rng.integers(0, 20, (3, attention.CONTEXT + attention.SCORED)), rng.integers(0, 20, (3, attention.SCORED))
    mask = rng.random(y.shape) < 0.8
    for name in model.weights:
        model.weights[name] = model.weights[name].astype(np.float64)
    _, g = model.gradient(x, y, mask)
    loss = lambda: float(-(np.log(model.forward(x, y)["p"]) * (mask / mask.sum())).sum())
    for name, w in model.weights.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[at]
            w[at] = old + 1e-4
            up = loss()
            w[at] = old - 1e-4
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name


def test_probabilities_are_causal_and_sum_to_one():
    model, rng = tiny()
    scorer = attention.Scorer(model)
    before = rng.integers(3, 20, 45)
    every = [10 ** scorer.log10(np.append(before, i), np.array([46])) for i in range(20)]
    assert abs(sum(p[-1] for p in every) - 1) < 1e-4
    assert all(np.allclose(p[:-1], every[0][:-1], rtol=1e-5) for p in every)  # what comes later changes nothing
    x, y, place = attention.windows(before, np.array([45]))
    assert np.allclose(model.forward(x, y)["p"].ravel()[place], every[0][:-1], rtol=1e-3)


@pytest.fixture(scope="module")
def model_rows():
    rng = random.Random(4)
    languages = [[a + b for a in x for b in y] for x, y in ((["th", "wh", "an"], ["er", "at", "ing"]), (["le", "qu", "de"], ["eau", "oi", "ent"]))]
    rows = [(i, " ".join(rng.choice(rng.choice(languages[i % 2 : i % 2 + 1])) for _ in range(60)) + (" rare%d" % (i // 3))) for i in range(300)]
    return [*rows, (9001, None), (9002, ""), (9003, " \t\n"), (9004, "É’ÄÖ ß 你好 世界 🙂 <|endoftext|>"), (9005, "Therat " * 700_000), (9005, "x" * 3000), (None, "THER wher"), (9006, "ther wher"), (9006, "ther wher")]


def scores(spark, rows, **more):
    import public_tokenizers

    df = spark.createDataFrame([(*r, 0.5, "w") for r in rows], "doc_id long, text string, score double, word string").repartition(3)
    return lm.scored(df, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, epochs=more.pop("epochs", 2), **more).collect()


def test_scores(spark, model_rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in model_rows]
    c = Counter(w for i, words in split if not held(i) for w in words)
    total, different = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(words), sum(c[w] > 0 for w in words), total, round(sum(math.log10((c[w] + 1) / (total + different + 1)) for w in words), 3)) for i, words in split), key=repr)
    for most in (150_000, 3):  # nearly all words travel, nearly all are joined
        got = scores(spark, model_rows, most=most)
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got), key=repr) == want
        by = sorted(((r["doc_id"], round(r["score"], 3)) for r in got), key=repr)
        assert most == 150_000 or all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-2 * max(1, abs(b[1]) ** 0.5) for a, b in zip(by, first))
        first = by
    assert all(r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # it knows more of held-out texts than counts alone


def test_held_out_rows_teach_nothing(spark, model_rows):
    some = model_rows[:100]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    changed = [(i, "ther wher " + t if held(i) else t) for i, t in some]
    a, b = ({r["doc_id"]: r["score"] for r in scores(spark, rows, epochs=1) if not r["held_out"]} for rows in (some, changed))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 * abs(a[i]) for i in a)


def test_scores_of_nothing(spark):
    assert scores(spark, []) == []
    (only,) = scores(spark, [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")])  # held out: nothing is learned
    assert (only["train_tokens"], only["n_known"], only["n_tokens"], only["base_score"]) == (0, 0, 3, 0.0) and only["score"] < 0


def test_words_are_joined_alike_by_tables_and_by_sorting(spark, model_rows, monkeypatch):
    some, found = [r for r in model_rows[:60] if r[0] != 9005], []
    for most in (lm.PARTITION_WORDS, 0):
        monkeypatch.setattr(lm, "PARTITION_WORDS", most)
        found.append(sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in scores(spark, some, most=3, epochs=1)))
    assert found[0] == found[1]


def test_every_training_text_is_learned_from(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    taught, out = next(i for i in range(1000, 1100) if not held(i)), [i for i in range(2000, 2100) if held(i)]
    rng = random.Random(6)
    cycle = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.sample(cycle, 5))) for i in range(200) if not held(i)]
    ordered = cycle * 20
    rows += [(taught, " ".join(cycle * 45_000)), (out[0], " ".join(ordered)), (out[1], " ".join(rng.sample(ordered, len(ordered))))]  # order is in one text of more than 1 MB
    got = {r["doc_id"]: r for r in scores(spark, rows)}
    assert abs(got[out[0]]["base_score"] - got[out[1]]["base_score"]) < 1e-6
    assert got[out[0]]["score"] > got[out[1]]["score"] + 20


def test_rounds_take_every_row():
    for total in (0, 5, 10**5, 10**6, 10**7, 10**10):
        found = lm.rounds(total, 3)
        met = Counter(slot for low, high in found for slot in range(low, high))
        assert set(met) == set(range(lm.SLOTS)) and len(set(met.values())) == 1
    assert len(lm.rounds(10**10, 3)) == 4


def test_learners_are_put_together_over_many_tasks(spark, model_rows, monkeypatch):
    monkeypatch.setattr(lm, "TASK_WORDS", 2000)
    monkeypatch.setattr(lm, "ROUND_WORDS", 500)
    got = scores(spark, [r for r in model_rows if r[0] != 9005])
    out = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_words_together_have_the_ids_of_each_alone():
    import public_tokenizers

    ids_of = lm.WordIds(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    some = ["don't", "x" * 900, "a\u00a0b", "\u3000", "12ab", "\x1cq", "é’äö", "你好", "<|endoftext|>", "|", "the"]
    for part in (some, [w for w in some if len(w) < 400 and len(w.split()) == 1], []):
        ids, sizes = ids_of.many([w.encode() for w in part])
        assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == [ids_of(w.encode()) for w in part]


def test_learner_has_the_gradient_of_the_plain_windows():
    rng, m, lengths = np.random.default_rng(3), 60, np.array([1, 16, 17, 40, 0, 300, 15])
    ids, learner = rng.integers(3, m, lengths.sum()), attention.Learner(m)
    learner.begin(learner.rows.copy(), learner.small())
    h, steps, w = learner.hidden, [], learner.model.weights
    learner._step = lambda x, part: steps.append((x, part))
    learner.learn(ids, lengths)
    ((stretches, part),) = steps
    x, y, place = attention.windows(ids, lengths)
    mask = np.isin(np.arange(y.size), place).reshape(y.shape)
    w["E"], w["P"], shares = learner.rows[:, :h], learner.rows[:, h : 2 * h], rng.dirichlet(np.ones(m), attention.CLASSES).astype(np.float32)
    plain = attention.Attention({**w, "T": np.log(shares)})
    got, moved = learner.gradient(stretches, part, shares.T)
    _, want = plain.gradient(x, y, mask)
    assert part.sum() == len(ids) and got.keys() == want.keys() - {"T"}
    assert all(np.allclose(got[n], want[n], rtol=1e-3, atol=1e-6) for n in got)
    assert np.allclose((moved.sum(axis=0)[:, None] * shares - moved.T) / len(ids), want["T"], rtol=1e-3, atol=1e-6)
    assert np.allclose(attention.Scorer(plain).log10(ids, lengths), np.log10(plain.forward(x, y)["p"].ravel()[place]), atol=1e-4)


def test_words_are_numbered_alike_whether_they_travel_or_not():
    import public_tokenizers

    texts = [b"", b"  the  The cat\x0b", b"a\x1cb \xc2\xa0x\r\nthe", b" ", b"cat cat zzz"]
    want = [w for t in texts for w in t.lower().split()]
    for top in ({}, {b"the": 3, b"cat": 3}, {w: 1 for w in sorted(set(want))}):
        known = lm.Known(lm.WordIds(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), {b"the": 60_000}, top)
        laid = lm.Laid(known, [(i, t, None, True) for i, t in enumerate(texts)])
        assert [w.encode() for w in laid.words.to_pylist()] == want and laid.held.tolist() == [len(t.split()) for t in texts]
        every = [i for t in texts for i in [*(i for w in t.lower().split() for i in ([60_000] if w == b"the" else [attention.END + 1 + i for i in known.ids_of(w)])), attention.END]]
        assert laid.ids.tolist() == every and known.count[laid.number].tolist() == [top.get(w, -1) for w in want]


def test_travelling_words_are_found_without_going_over_all_of_them():
    class Ids:
        def many(self, some):
            return np.zeros(len(some), dtype=np.int64), np.ones(len(some), dtype=np.int64)

    odd = [b"a", b"a\x00", b"\x00", b"\x00\x00", b"1234567", b"12345678", b"12345678\x00", b"123456781", b"x" * 15, b"x" * 16, b"x" * 17, b"x" * 18, b"x" * 16 + b"y", "é你好é你好".encode(), "你".encode()]
    some = [*odd, *(w[:-1] + b"z" for w in odd), *(b"w%d" % i for i in range(200_000))]
    top = {w: i for i, w in enumerate(dict.fromkeys(some[::2]))}
    known = lm.Known(Ids(), {}, top)
    for part in (some[: 2 * len(odd)], some[-9:], []):
        for at in (0, 1):  # an array may begin within its buffers
            numbers = known.numbers(pa.array([b"?", *part], pa.binary()).view(pa.string())[1 - at :])
            assert known.count[numbers].tolist() == [-1] * at + [top.get(w, -1) for w in part]
            assert len(set(numbers.tolist())) == at + len(set(part))
    one, begin = pa.array(["w7"]), time.process_time()
    for _ in range(500):
        known.numbers(one)
    assert time.process_time() - begin < 1  # each time over all words: several seconds


def test_sums_by_index():
    rng = np.random.default_rng(5)
    index = np.concatenate((np.repeat(np.arange(60), np.arange(60)), rng.integers(60, 90_000, 500)))
    rng.shuffle(index)
    values = rng.standard_normal((len(index), 7))
    for n in (90_000, 60):
        some = index < n
        want = np.zeros((n, 7))
        np.add.at(want, index[some], values[some])
        assert np.allclose(attention.sums_by(index[some], values[some], n), want)
    assert not attention.sums_by(index[:0], values[:0], 3).any()
