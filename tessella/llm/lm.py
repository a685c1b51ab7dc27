"""Scores of a language model: causal self-attention over subword ids, mixed with the corpus' own word counts.

A text is its words, lower-cased in A-Z, and an end.  A frequent word is one id; the ids of another are those of the tokenizer for the word
behind one space, so ids say where words begin, and the model's probabilities are of word sequences.  Words are counted and the attention model (see `attention`) is
trained over all documents that are not held out, each whole.  A word's probability is OWN parts its share of the training words and the rest
what attention gives its ids.

Training goes over the rows in rounds, each of which takes other rows than those before it.  In a round every task goes on from the same model over its own rows;
what the tasks change is put together by the ids that they saw, and the next round goes on from there.  Where there are few words, it goes over all rows again.
Words that make up most of all text have a bounded number; their counts travel with the tasks that score.  All other words of a document are rows that are joined with the counts.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.attention import CONTEXT, END, START, Attention, Learner, Scorer, sums_by
from tessella.llm.common import named, stored, worker_memory

#: The share of a word's probability that comes from counts.
OWN = 0.2
#: Words that are one id, at most, and how often they occur among the training words, at least.
WHOLE, WHOLE_LEAST = 50_000, 40
#: The hashes of texts fall into so many slots.  Rounds end at these slots; a round of fewer words than ROUND_WORDS is left to the next one.
SLOTS, ROUND_ENDS, ROUND_WORDS = 64, (1, 5, 21), 100_000
#: Training words of a task, about, and those that are met in all where that takes at most EPOCHS times over all rows.
TASK_WORDS, MET_WORDS, EPOCHS = 3_000_000, 3_000_000, 5
#: Words whose counts travel with the tasks, at most; a word of lower rank is rarer than 1 in so many.
OFTEN = 150_000
#: Words of a partition that are joined by a hash table; where there are more, words are sorted.
PARTITION_WORDS = 400_000
#: Different words that a scoring worker remembers.
REMEMBER = 350_000
#: Texts counted together and texts scored together have so many bytes; a longer one is taken in parts of about PART_BYTES that end between words.
COUNT_BYTES, GROUP_BYTES, PART_BYTES = 1 << 24, 1 << 21, 1 << 20
#: Words of up to so many bytes are looked up packed in two numbers.
PACKED = 16
#: Longer words are encoded in parts of so many characters; shorter ones, up to so many together.
LONG_WORD, WORDS_TOGETHER = 400, 2000


def held_out(id_: Column) -> Column:
    """Whether nothing is learned from a row: crc32 of the id as text, mod 7, is 2; null ids are not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class WordIds:
    """The tokenizer's ids of words."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.size = max(ranks.values()) + 1
        self.begins = np.zeros(self.size, dtype=bool)  # ids of pieces that begin with a space
        self.begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        self._encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, word: bytes) -> list[int]:
        text = " " + word.decode()
        if len(text) <= LONG_WORD:
            return self._encode(text)
        return [i for at in range(0, len(text), LONG_WORD) for i in self._encode(text[at : at + LONG_WORD])]

    def many(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each has).

        The tokenizer's pattern lets no piece span a space, so words without white space of their own can be encoded together.
        """
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(some), WORDS_TOGETHER):
            part = some[at : at + WORDS_TOGETHER]
            text = (b" " + b" ".join(part)).decode()
            if max(map(len, part)) < LONG_WORD and len(text.split()) == len(part):
                found = np.array(self._encode(text), dtype=np.int64)
                own = np.diff(np.append(np.flatnonzero(self.begins[found]), len(found)))
            else:
                each = [self(w) for w in part]
                found, own = np.array([i for e in each for i in e], dtype=np.int64), np.array([len(e) for e in each])
            ids.append(found)
            sizes.append(own)
        return np.concatenate(ids), np.concatenate(sizes)


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text (binary); where white space stands first or last, an empty one stands beside it."""
    # of bytes: A-Z and ASCII white space only
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())))


def _bytes(column: pa.Array) -> list[bytes]:
    return [bytes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in column]


def word_counts(source: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in the (held_out, text) rows that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            found = words(pa.array(held, pa.binary())).flatten().value_counts()
            word, c = found.field("values").view(pa.binary()), found.field("counts")
            return pa.RecordBatch.from_arrays([word, c], ["word", "c"]).filter(pc.not_equal(pc.binary_length(word), 0))

        held, size = [], 0
        for batch in batches:
            for text in _bytes(batch["text"]):
                for part in parts(text):
                    held.append(part)
                    size += len(part)
                    if size > COUNT_BYTES:
                        yield counted()
                        held, size = [], 0
        yield counted()

    return source.where(~F.col("held_out")).select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def often(counts: DataFrame, most: int = OFTEN, least: int = 1) -> dict[bytes, int]:
    """{word: c} of the words that occur most, at least so often; the bound is found on a histogram of counts in quarters of an octave."""
    level = F.floor(F.log2("c") * 4)
    counts, held, low = counts.where(F.col("c") >= least), 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 256 levels at most
        held += r["count"]
        if held > most:
            break
        low = r["level"]
    if low is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in counts.where(level >= low).select("word", "c").collect()}  # `most` rows at most


def rounds(total: int, epochs: int) -> list[tuple[int, int]]:
    """(first slot, the slot behind the last) of each round over so many training words."""
    ends = [e for e in ROUND_ENDS if total * e / SLOTS >= ROUND_WORDS] + [SLOTS]
    again = max(1, min(epochs, ceil(MET_WORDS / max(1, total))))
    return list(zip([0, *ends], ends)) + [(0, SLOTS)] * (again - 1)


def train(source: DataFrame, known_of: Callable[[], Known], ids: int, total: int, epochs: int = EPOCHS) -> Attention:
    """The model of all (held_out, text) rows that are not held out; ids: how many there are, total: the words of those rows.

    known_of gives a task its words.  A task's changes are rows of the ids that it met; these are added up by id, so that the driver sees a row for each id.
    """
    spark, name = source.sparkSession, uuid.uuid4().hex
    learner = Learner(ids)
    rows, small = learner.rows, learner.small()
    width = rows.shape[1]
    fit = source.where(~F.col("held_out")).select("text", F.xxhash64("text").alias("h"))

    def emitted(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        data = np.ascontiguousarray(values, dtype=np.float32)
        offsets = np.arange(len(data) + 1, dtype=np.int32) * (4 * width)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], ["key", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = {}, np.zeros((0, width), np.float32)
        for batch in batches:
            own, inverse = np.unique(batch["key"].to_numpy(), return_inverse=True)
            found = sums_by(inverse, np.frombuffer(b"".join(_bytes(batch["change"])), dtype=np.float32).reshape(-1, width), len(own))
            fresh = [k for k in own.tolist() if k not in at]
            at.update(zip(fresh, range(len(at), len(at) + len(fresh))))
            sums = np.concatenate((sums, np.zeros((len(fresh), width), np.float32)))
            sums[[at[k] for k in own.tolist()]] += found
        for a in range(0, len(at), 10_000):
            yield emitted(np.array(list(at)[a : a + 10_000]), sums[a : a + 10_000])

    for low, high in rounds(total, epochs):
        state = spark.sparkContext.broadcast((rows, small))

        def learn(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            memory = worker_memory("lm")
            if memory.get("lm_learner", ("",))[0] != name:
                memory["lm_learner"] = name, Learner(ids)
            known, own, (before, start) = known_of(), memory["lm_learner"][1], state.value
            own.begin(before, start)
            for batch in batches:
                for run in _runs(_bytes(batch["text"])):
                    laid = Laid(known, run)
                    own.learn(laid.ids, laid.sizes, laid.before)
            if own.seen:
                after = own.learned()
                met = np.flatnonzero((after != before).any(axis=1))
                for a in range(0, len(met), 10_000):
                    some = met[a : a + 10_000]
                    yield emitted(some, (after[some] - before[some]) * np.float32(own.seen))
                rest = np.append((own.small() - start) * own.seen, own.seen)
                rest = np.append(rest, np.zeros(-len(rest) % width)).reshape(-1, width)
                yield emitted(-1 - np.arange(len(rest)), rest)

        tasks = max(1, ceil(total * (high - low) / SLOTS / TASK_WORDS))
        some = fit.where(F.pmod("h", F.lit(SLOTS)).between(low, high - 1)).coalesce(tasks)
        some = some.sortWithinPartitions("h", "text") if tasks == 1 else some
        changes = some.select("text").mapInArrow(learn, "key long, change binary")
        found = changes.repartition("key").mapInArrow(add, "key long, change binary").toArrow()  # a row for each id at most
        state.destroy()
        if len(found):
            keys, change = found["key"].to_numpy(), np.frombuffer(b"".join(_bytes(found["change"].combine_chunks())), dtype=np.float32).reshape(-1, width)
            rest = change[np.flatnonzero(keys < 0)[np.argsort(-keys[keys < 0])]].ravel().astype(np.float64)
            seen = rest[len(small)]
            rows = rows.copy()
            rows[keys[keys >= 0]] += change[keys >= 0] / np.float32(seen)
            small = small + rest[: len(small)] / seen
    return learner.begin(rows, small).finished()


def packed(some: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 8 bytes, next 8 bytes, length) of each word: words of up to PACKED bytes that agree in all three are equal."""
    wide = pa.types.is_large_string(some.type) or pa.types.is_large_binary(some.type)
    bounds = np.frombuffer(some.buffers()[1] or b"", np.int64 if wide else np.int32)[some.offset :][: len(some) + 1]
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, high = int(bounds[0]), int(bounds[-1])
    data = np.concatenate((np.frombuffer(some.buffers()[2] or b"", np.uint8)[low:high], np.zeros(PACKED, np.uint8)))
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # from each byte on
    at, size = bounds[:-1] - low, np.diff(bounds)
    masks, short = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64), np.minimum(size, PACKED)
    return eights[at] & masks[np.minimum(short, 8)], eights[at + 8] & masks[np.maximum(short - 8, 0)], size.astype(np.int64)


def _key(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    key = (first ^ second * np.uint64(0xC2B2AE3D27D4EB4F) ^ size.astype(np.uint64) << np.uint64(56)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ key >> np.uint64(32)


class Known:
    """Words by number: their ids end to end, and their counts (-1: not among those that travel).

    Those that travel come first; all of them but long ones are found in an index over packed words that is built once. The others have a dictionary.
    """

    def __init__(self, ids_of: WordIds, whole: dict[bytes, int], top: dict[bytes, int]) -> None:
        """whole: the words that are one id, and that id."""
        self.ids_of, self.whole = ids_of, whole
        self.pieces, self.start, self.length, self.count = (np.zeros(1 << 16, dtype) for dtype in (np.int32, np.int64, np.int64, np.int64))
        self.have = self.used = 0
        often = list(top)
        if often:
            self.learn(often, list(top.values()))
        self.kept = self.have, self.used
        self.whole = {w: i for w, i in whole.items() if w not in top}  # of the words that are still to be learned
        *columns, size = packed(pa.array(often, pa.binary()))
        _, own = np.unique(_key(*columns, size), return_index=True)
        own = own[size[own] <= PACKED]
        self.index = pd.Index(_key(*columns, size)[own])
        # the last row stands for words that are not found
        self.first, self.second, self.size, self.place = (np.append(x[own], np.array([-1]).astype(x.dtype)) for x in (*columns, size, np.arange(len(often))))
        self.apart = {often[i]: i for i in np.setdiff1d(np.arange(len(often)), own).tolist()}  # long words that travel
        self.clear()

    def clear(self) -> None:
        """Forget all words but those whose counts travel."""
        self.number = dict(self.apart)
        self.have, self.used = self.kept

    def learn(self, new: list[bytes], counts: list[int] | int = -1) -> None:
        """Give different new words the next numbers, in their order."""
        alone = np.array([self.whole.get(w, 0) for w in new], dtype=np.int64) if self.whole else np.zeros(len(new), dtype=np.int64)
        ids, sizes = self.ids_of.many([w for w, own in zip(new, alone.tolist()) if not own] if alone.any() else new)
        ids = ids + END + 1
        if alone.any():
            ids = np.insert(ids, np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(alone == 0)[alone > 0]], alone[alone > 0])
            every = np.ones(len(new), dtype=np.int64)
            every[alone == 0] = sizes
            sizes = every
        have, more = self.have, len(new)
        while have + more > len(self.start):
            self.start, self.length, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length, self.count))
        while self.used + sizes.sum() > len(self.pieces):
            self.pieces = np.concatenate((self.pieces, np.zeros_like(self.pieces)))
        ends = self.used + np.cumsum(sizes)
        self.pieces[self.used : ends[-1]] = ids
        self.start[have : have + more], self.length[have : have + more] = ends - sizes, sizes
        self.count[have : have + more] = counts
        self.have, self.used = have + more, int(ends[-1])

    def numbers(self, some: pa.Array) -> np.ndarray:
        """The numbers of words."""
        first, second, size = packed(some)
        at = self.index.get_indexer(_key(first, second, size))
        same = (self.first.take(at, mode="wrap") == first) & (self.second.take(at, mode="wrap") == second) & (self.size.take(at, mode="wrap") == size)
        numbers = self.place.take(at, mode="wrap")
        if not same.all():
            others = some.filter(pa.array(~same)).dictionary_encode()
            numbers[~same] = self._others(others.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())[others.indices.to_numpy()]
        return numbers

    def _others(self, some: list[bytes]) -> np.ndarray:
        """The numbers of different words that are not in the index."""
        fresh = [w for w in some if w not in self.number]
        if len(fresh) + self.have > REMEMBER:
            self.clear()
            fresh = [w for w in some if w not in self.number]
        if fresh:
            self.number.update(zip(fresh, range(self.have, self.have + len(fresh))))
            self.learn(fresh)
        return np.fromiter(map(self.number.__getitem__, some), dtype=np.int64, count=len(some))


class Laid:
    """The parts of a run as ids end to end: of each part its words in order, then its end if it is a document's last."""

    def __init__(self, known: Known, run: list[tuple[int, bytes, np.ndarray | None, bool]]) -> None:
        split = words(pa.array([t for _, t, _, _ in run], pa.binary()))
        self.of, self.last = np.array([k for k, *_ in run]), np.array([final for *_, final in run])
        self.words, ends = split.flatten(), split.offsets.to_numpy()
        there = pc.binary_length(self.words).to_numpy() > 0
        if not there.all():
            self.words, ends = self.words.filter(pa.array(there)), np.concatenate(([0], np.cumsum(there)))[ends]
        self.held = np.diff(ends)
        self.number = known.numbers(self.words)
        length = known.length[self.number]
        self.first = np.concatenate(([0], np.cumsum(length)))
        ids = known.pieces[np.arange(self.first[-1]) + np.repeat(known.start[self.number] - self.first[:-1], length)]
        part_ids = np.diff(self.first[np.concatenate(([0], np.cumsum(self.held)))])
        self.ids = np.insert(ids, np.cumsum(part_ids)[self.last], END)
        self.sizes = part_ids + self.last
        self.ending = np.cumsum(self.sizes)[self.last] - 1
        tail = run[0][2]
        self.before = None if tail is None else tail[None].copy()
        if tail is not None:
            tail[:] = np.concatenate((tail, self.ids))[-CONTEXT - 1 :]


def parts(text: bytes) -> Iterator[bytes]:
    """The text, or parts of a long one that end at white space."""
    begin = 0
    while len(text) - begin > PART_BYTES:
        end = begin + PART_BYTES
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def scored(documents: DataFrame, vocabulary: str, pattern: str, *, id_col="doc_id", text_col="text", own=OWN, most=OFTEN, epochs=EPOCHS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of documents, repeated ones included.

    vocabulary is the path of a rank file that every executor must have, pattern how it parts texts.  Null and empty texts are an end alone.  Null
    ids are learned from.  Texts and words may be of any length.  Where nothing can be learned (no rows, or all held out), train_tokens is 0, base
    scores are 0 and the untrained model scores alone.  An empty table gives no rows; other columns are not read.
    """
    id_, text = named(id_col, text_col)
    source = documents.select(id_.alias("doc_id"), held_out(id_).alias("held_out"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    counts = stored(word_counts(source), "words")
    n_words, n_known = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = source.where(~F.col("held_out")).count()
    total, different = (n_words or 0) + ends, n_known + (ends > 0)
    below = log10(total + different + 1)
    mine = own if total else 0.0
    first = END + 1 + WordIds(vocabulary, pattern).size
    frequent = sorted(often(counts, WHOLE, WHOLE_LEAST).items(), key=lambda x: (-x[1], x[0]))
    travel = documents.sparkSession.sparkContext.broadcast(({w: first + i for i, (w, _) in enumerate(frequent)}, often(counts, most)))
    name = uuid.uuid4().hex
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary"

    def mixed(count: np.ndarray, logp: np.ndarray) -> np.ndarray:
        counted = mine / max(1, total) * count
        with np.errstate(divide="ignore"):  # where nothing was counted, 10 ** logp may be too small to be told from 0
            return np.where(counted > 0, np.log10((1 - mine) * 10**logp + counted), logp + log10(1 - mine))

    def known_of() -> Known:
        memory = worker_memory("lm")
        if memory.get("lm") != name:
            memory["lm"], memory["lm_known"], memory["lm_scorer"] = name, Known(WordIds(vocabulary, pattern), *travel.value), None
        return memory["lm_known"]

    model = train(source, known_of, first + len(frequent), n_words or 0, epochs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memory = known_of(), worker_memory("lm")
        memory["lm_learner"] = ("",)
        memory["lm_scorer"] = scorer = memory["lm_scorer"] or Scorer(model)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = _bytes(batch["text"])
            sums = np.zeros((len(texts), 4))  # tokens, known ones, base score, score
            rest_rows, rest_words, rest_logp = [], [], []
            for run in _runs(texts):
                laid = Laid(known, run)
                of, held, last, number = laid.of, laid.held, laid.last, laid.number
                logp = scorer.log10(laid.ids, laid.sizes, laid.before)
                word_logp = np.add.reduceat(np.delete(logp, laid.ending), laid.first[:-1]) if len(number) else np.zeros(0)
                count, doc = known.count[number], np.repeat(of, held)
                there = count >= 0
                add = lambda j, at, v: sums.__setitem__((slice(None), j), sums[:, j] + np.bincount(at, weights=v, minlength=len(texts)))
                add(0, of, held + last)
                add(1, doc[there], count[there] > 0)
                add(2, doc[there], np.log10(count[there] + 1) - below)
                add(3, doc[there], mixed(count[there], word_logp[there]))
                done = of[last]
                add(1, done, np.full(len(done), float(ends > 0)))
                add(2, done, np.full(len(done), log10(ends + 1) - below))
                add(3, done, mixed(np.full(len(done), ends), logp[laid.ending]))
                away = np.flatnonzero(~there)
                rest_rows.append(row + doc[away])
                rest_words.append(laid.words.take(pa.array(away)).view(pa.binary()))
                rest_logp.append(word_logp[away])
            n = sum(map(len, rest_words))
            blank = lambda t: pa.nulls(n, t)
            docs = [pa.array(row + np.arange(len(texts))), batch["doc_id"], batch["held_out"], *(pa.array(sums[:, j].astype(np.int64)) for j in (0, 1)), *(pa.array(sums[:, j]) for j in (2, 3)), pa.nulls(len(texts), pa.binary())]
            names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word"]
            yield pa.RecordBatch.from_arrays(docs, names)
            if n:
                cols = [pa.array(np.concatenate(rest_rows)), blank(batch["doc_id"].type), blank(pa.bool_()), blank(pa.int64()), blank(pa.int64()), blank(pa.float64()), pa.array(np.concatenate(rest_logp)), pa.concat_arrays(rest_words)]
                yield pa.RecordBatch.from_arrays(cols, names)
            row += len(texts)

    found = stored(source.mapInArrow(score, schema), "scored")
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked_up = counts.hint("shuffle_hash") if n_known <= PARTITION_WORDS * partitions else counts
    rest = found.where("word IS NOT NULL").select("row", "word", F.col("score").alias("logp")).join(looked_up, "word", "left").fillna(0, "c")
    counted = F.lit(mine / max(1, total)) * F.col("c")
    both = F.when(counted > 0, F.log10(F.lit(1 - mine) * F.pow(10.0, "logp") + counted)).otherwise(F.col("logp") + log10(1 - mine))
    own_kind = found.schema["doc_id"].dataType
    rest = rest.select("row", F.lit(None).cast(own_kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"), (F.col("c") > 0).cast("long").alias("n_known"), (F.log10(F.col("c") + 1.0) - below).alias("base_score"), both.alias("score"))
    sums = found.where("word IS NULL").drop("word").unionByName(rest).groupBy("row")
    sums = sums.agg(F.first("doc_id", True).alias("doc_id"), F.first("held_out", True).alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _runs(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, np.ndarray | None, bool]]]:
    """Parts that are scored together: (text's number, part, the ids before it, whether it is the text's last).

    Parts of a long text are alone and share an array: who scores a part leaves its last ids there for the next one.
    """
    run, size = [], 0
    for k, t in enumerate(texts):
        if len(t) <= PART_BYTES:
            if run and size + len(t) > GROUP_BYTES:
                yield run
                run, size = [], 0
            run.append((k, t, None, True))
            size += len(t)
            continue
        if run:
            yield run
            run, size = [], 0
        tail = np.full(CONTEXT + 1, START, dtype=np.int32)
        every = list(parts(t))
        for i, p in enumerate(every):
            yield [(k, p, tail, i == len(every) - 1)]
    if run:
        yield run
