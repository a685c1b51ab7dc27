"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages.  Every passage is encoded (what kinds of characters follow one another, how
many of its words are distinct, how long they are), a small network maps it to a hidden vector, and gated
attention weighs the passages: a = softmax(w . (tanh(V h) * sigmoid(U h))).  The weighted sum of hidden
vectors is what the last layer scores.  Only documents have labels; which passages matter is learned from them.

The network is fitted on a sample of labelled documents whose size is a parameter; scoring is one pass over
all documents, each whole, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import named, stored, worker_memory

#: Labelled documents that are fitted on at most: those of least hash, so at random.
SAMPLE_ROWS = 6000
#: Passages that the fitted documents have in all, at most; a document counts whole or not at all, and scoring takes every one.
SAMPLE_PASSAGES = 250_000
#: Words of a passage, and bytes of a text after which a passage ends early (bounds memory): at the next white space, at twice that at the latest.
PASSAGE_WORDS = 40
SEGMENT_BYTES = 1 << 20
#: Texts that are encoded together have up to this many bytes.
GROUP_BYTES = 1 << 18
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    kind = np.full(256, 11, dtype=np.int64)
    for i, some in enumerate((b"", b"", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".", b",", b"!?", b"|", b"#$%&*@^~+=<>\\_", b"-:;'\"()[]{}/`")):
        kind[list(some)] = i
    kind[97:123], kind[65:91], kind[:9], kind[14:32] = 0, 1, 12, 12
    return kind


KIND = _kinds()
KINDS = 13
WIDTH = KINDS * KINDS + 5
_SPACE = np.isin(KIND, (3, 4))
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
_VALUES = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)


def segments(text: bytes) -> list[bytes]:
    """The text in parts of SEGMENT_BYTES and what is left of the word there."""
    out, begin = [], 0
    while len(text) - begin > SEGMENT_BYTES:
        gap = _GAP.search(text, begin + SEGMENT_BYTES, begin + 2 * SEGMENT_BYTES)
        end = gap.start() if gap else min(len(text), begin + 2 * SEGMENT_BYTES)
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]] if begin < len(text) or not out else out


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts): a row for each passage of the texts in order, and how many each text has (one at least)."""
    cut = [segments(t) for t in texts]
    of_part = [len(c) for c in cut]
    found = [_encoded(run) for run in grouped([p for c in cut for p in c])]
    held = np.concatenate([h for _, h in found])
    return np.concatenate([x for x, _ in found]), np.add.reduceat(held, np.concatenate(([0], np.cumsum(of_part)[:-1])))


def _encoded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of parts that are passages of their own."""
    sizes = np.array([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    word = np.cumsum(begins)  # words up to and with each byte
    before = word[first] - begins[first]
    words_of = np.diff(np.append(before, word[-1]))
    held = np.maximum(1, -(-words_of // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(held)))
    part = np.repeat(np.arange(len(parts)), sizes)
    inside = np.maximum(word - before[part] - 1, 0)
    at = base[part] + inside // PASSAGE_WORDS
    n = base[-1]
    kind = KIND[data]
    pairs = np.delete(at[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:], first[1:] - 1)  # none from one text to the next
    counts = np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1).astype(np.float32)
    n_bytes = counts.sum(axis=1)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(n_bytes, 1)[:, None])
    starts = np.flatnonzero(begins)
    if len(starts):
        place = np.arange(len(data), dtype=np.int32)
        begun = np.where(begins, place, np.int32(0))
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(63, 0x9E3779B97F4A7C15, np.uint64))))
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        value = _VALUES[data] * powers[(place - np.maximum.accumulate(begun)) & 63]
        name = np.add.reduceat(value, starts)
        of = at[starts]
        n_words = np.bincount(of, minlength=n)
        again = np.bincount(of[1:], weights=(name[1:] == name[:-1]) & (of[1:] == of[:-1]), minlength=n)
        order = np.lexsort((name, of))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order], weights=fresh, minlength=n)
        letters = np.bincount(of, weights=ends - starts, minlength=n)
        some = np.maximum(n_words, 1)
        out[:, -5], out[:, -4], out[:, -3] = distinct / some, again / some, letters / some / 10
        out[:, -2], out[:, -1] = np.log1p(n_words) / 4, n_words == 0
    else:
        out[:, -1] = 1
    return out, held


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of up to GROUP_BYTES (a longer text is alone)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > GROUP_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


@dataclass
class Network:
    """A passage encoder (E, e), gated attention (V, U, w) and a last layer (o, c)."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls({"E": draw(WIDTH, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "o": draw(HIDDEN), "c": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        h = np.maximum(x @ p["E"] + p["e"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = np.exp(np.clip((t * g) @ p["w"], -30, 30))
        a = s / np.repeat(np.add.reduceat(s, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the bags."""
        p, f = self.weights, self.forward(x, counts)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["o"], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), counts))
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 1) -> Network:
        """Adam over shuffled batches of bags, the rate falling to nothing."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        whole = EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                counts = np.array([len(bags[i]) for i in some])
                x = np.concatenate([bags[i] for i in some]).astype(np.float32)
                step += 1
                for k, g in self.gradient(x, counts, y[some]).items():
                    g = g + DECAY * self.weights[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    change = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - RATE * (1 - step / (whole + 1)) * change).astype(np.float32)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [self.forward(*passages(run))["score"] for run in grouped(texts)]
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


@dataclass
class Constant:
    """What is scored where no labels, or labels of one class alone, can be learned from."""

    score: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.score)


def held_out(id_: Column) -> Column:
    """Whether a row's label is kept from learning: crc32 of the id as text, mod 4, is 2; null ids are not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bytes(column: pa.Array) -> list[bytes]:
    return [bytes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in column]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memory("quality")
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            bags = [passages([text])[0] for text in _bytes(part["text"])]
            yield pa.RecordBatch.from_arrays(
                [part["order"], part["y"], pa.array([len(x) for x in bags], pa.int64()), pa.array([x.astype(np.float16).tobytes() for x in bags], pa.binary())], ["order", "y", "n", "bag"]
            )


def learn(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", sample_rows=SAMPLE_ROWS, sample_passages=SAMPLE_PASSAGES) -> Network | Constant:
    """Fit on at most sample_rows labelled documents that are not held out, of at most sample_passages passages in all.

    Documents are taken whole, in the order of a hash; one that no longer fits is passed over.  Labels repeated for
    an id count by their mean; null ids and labels are left out.  The labels' sample has a fixed
    bound and is broadcast, so the documents' texts are not shuffled; the driver holds 2 * WIDTH bytes for each of the passages.
    """
    label_id, label, (own_id, text) = *named(label_id_col, label_col), named(id_col, text_col)
    known = labels.select(label_id.alias("id"), label.cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    known = known.withColumn("order", F.xxhash64("id", F.lit("sample"))).orderBy("order", "id").limit(sample_rows)
    texts = documents.select(own_id.alias("id"), text.cast("binary").alias("text"))
    found = texts.join(F.broadcast(known), "id").select("order", "y", "text").mapInArrow(_bags, "order long, y double, n long, bag binary")
    found = stored(found, "bags").where(F.col("n") <= sample_passages)
    bags, y, left = [], [], sample_passages
    for r in found.orderBy("order", F.xxhash64("bag")).limit(sample_rows).toLocalIterator():  # ids may repeat
        if r["n"] <= left:
            bags.append(np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH))
            y.append(r["y"])
            left -= r["n"]
    if not 0 < sum(y) < len(y):
        return Constant(float((sum(y) + 1) / (len(y) + 2)))
    return Network.new().fit(bags, np.array(y))


def _scorer(model: Network | Constant, threshold: float, within: int | None) -> Callable:
    """within: the place of the text among the kept columns, where it is no column of its own."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("quality")
        for batch in batches:
            more = ["kept"] if "kept" in batch.schema.names else []
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                scores = model.scores(_bytes(part["text"] if within is None else part["kept"].field(within)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), *[part[c] for c in more]], ["doc_id", "held_out", "score", "predicted", *more])

    return score


def scored(documents: DataFrame, model: Network | Constant, *, id_col="doc_id", text_col="text", threshold=THRESHOLD, keep=()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and, under `kept`, the columns named in keep: a row per row of documents.

    Null texts are empty ones, whose single passage has no words.  Repeated rows get equal scores.  An
    empty table gives no rows; other columns are not read.  Texts may be of any length; a word of more than a MiB is cut.
    """
    own_id, text = named(id_col, text_col)
    kept = [F.struct(*named(*keep)).alias("kept")] if keep else []
    # a text that is kept goes to the workers once: batches of whole texts are most of what a task holds
    within = keep.index(text_col) if text_col in keep and documents.schema[text_col].dataType.typeName() in ("string", "binary") else None
    alone = [text.cast("binary").alias("text")] if within is None else []
    source = documents.select(own_id.alias("doc_id"), held_out(own_id).alias("held_out"), *alone, *kept)
    schema = source.drop("text").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).select("doc_id", "held_out", "score", "predicted", *["kept"][: len(kept)]).schema
    return source.mapInArrow(_scorer(model, threshold, within), schema)


def quality(documents: DataFrame, labels: DataFrame, *, threshold=THRESHOLD, **names) -> DataFrame:
    """Learn from the labels and score every document."""
    own = {k: v for k, v in names.items() if k in ("id_col", "text_col")}
    return scored(documents, learn(documents, labels, **names), threshold=threshold, **own)


def good_documents(documents: DataFrame, labels: DataFrame, *, threshold=THRESHOLD, **names) -> DataFrame:
    """The documents, with all their columns, that the classifier predicts to be good.

    Repeated rows stay or go together; null and empty texts are scored like any other.  An empty table gives no
    rows; the names of further columns do not matter.
    """
    own = {k: v for k, v in names.items() if k in ("id_col", "text_col")}
    found = scored(documents, learn(documents, labels, **names), threshold=threshold, keep=tuple(documents.columns), **own)
    return found.where("predicted = 1").select(*[F.col("kept").getField(c).alias(c) for c in documents.columns])
