"""Token ids in a content-addressed store.

Documents are encoded, an end id is appended, and a rolling hash over the ids cuts each
document into chunks: equal runs of ids are cut alike wherever they stand.  A chunk is named by the
SHA-256 of its bytes and stored once, with the first document (by id) that has it.  A document's recipe
lists its chunks; the root of a Merkle tree over their names stands beside it, and a manifest
holds the root over the documents of each part of the store.

The store is a Parquet table in ascending order of document ids: range-partitioned, sorted, its parts numbered.
A row holds the recipe and the ids (16 bits each, little-endian) of those chunks that are stored here.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.llm.common import hot_of, named, new_path, skewed_join, stored, worker_memory

END_ID = 1
#: Chunks: ids at least, ids at most, and the bits of the hash that must be zero at a cut (so 2**BITS ids on average beyond the least).
LEAST, MOST, BITS = 256, 8192, 10
#: Ids under the rolling hash; no more than LEAST.
ROLL = 32
#: Words whose ids a worker remembers, before it forgets those that it has not met again since the last time.
REMEMBER = 600_000
#: The multiplier of the rolling hash, odd, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 1 << 64)
CHUNKS = "array<struct<digest: binary, n: int>>"
#: The id of one of the model's tokens.
ID = attrgetter("id")


#: A word that can be taken apart: letters of Latin-1 that normalization leaves alone, then perhaps one mark.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([,.]?)")
#: The characters that stand for the bytes 128 to 255 in the vocabularies of byte-level tokenizers.
BYTE_CHARS = {b: chr(256 + 33 + i) for i, b in enumerate(b for b in range(127, 256) if b < 161 or b == 173)}


class WordEncoder:
    """Encodes texts word by word and remembers what it has seen, also from one task of a worker to the next.

    For tokenizer files that lower-case, let no token span white space, and part letters from punctuation:
    then a text's ids are its words' ids end to end.  Plain words go to the model without the
    file's normalizer and patterns, which cost most of the time; all others go through the whole tokenizer.
    A sample of the plain words is encoded both ways, and a difference is an error.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        kept = worker_memory("tokenstore")
        if path not in kept:
            from tokenizers import Tokenizer

            kept[path] = {"tokenizer": Tokenizer.from_file(path), "known": {}, "old": {}}
        self.kept, self.whole = kept[path], kept[path]["tokenizer"]
        self.remember, self.checked, self.tokenize = remember, 0, self.whole.model.tokenize
        self.marks = {ord(m): self._ids([m])[0] for m in ",."}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, letters: bytes) -> bytes:
        """The ids of a word of letters, straight from the model, whose pieces are written in one character for each byte."""
        text = letters.decode("latin-1")
        return array("H", map(ID, self.tokenize(text if letters.isascii() else text.translate(BYTE_CHARS)))).tobytes()

    def _learn(self, fresh: set[bytes], known: dict[bytes, bytes]) -> None:
        plain, tokenize, marks, rest, sample = self._plain, self.tokenize, self.marks, [], []
        get, before = known.get, self.kept["old"].get
        for w in fresh:
            if w.isalpha() and w.islower():  # of ASCII alone
                known[w] = array("H", map(ID, tokenize(w.decode()))).tobytes()
                continue
            mark = marks.get(w[-1])
            letters = w[:-1] if mark else w
            if mark and letters.isalpha() and letters.islower():
                known[w] = (get(letters) or before(letters) or array("H", map(ID, tokenize(letters.decode()))).tobytes()) + mark
            elif not w.isascii() and PLAIN.fullmatch(w.decode()):
                known[w] = (get(letters) or before(letters) or plain(letters)) + mark if mark else plain(w)
            else:
                rest.append(w)
                continue
            if len(sample) < 200:
                sample.append(w)
        if self.checked < 200:
            sample += list(fresh.difference(rest))[: 200 - len(sample)]
            for w, ids in zip(sample, self._ids([w.decode() for w in sample])):
                if known[w] != ids:
                    raise ValueError(f"{w!r} is encoded otherwise without the tokenizer's patterns: this file is not of the kind that WordEncoder takes")
            self.checked += len(sample)
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            known.update(zip(some, self._ids([w.decode() for w in some])))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids, 16 bits little-endian."""
        # of bytes: A-Z and ASCII white space only; the names of special tokens are told apart by case
        lowered = [t if b"<|" in t else t.lower() for t in texts]
        raw, kind = (pa.large_binary(), pa.large_string()) if sum(map(len, lowered)) >> 30 else (pa.binary(), pa.string())
        split = pc.ascii_split_whitespace(pa.array(lowered, raw).view(kind))
        told = split.flatten().dictionary_encode()
        words, index, ends = told.dictionary.view(raw).to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy(), split.offsets.to_numpy()
        if len(self.kept["known"]) > self.remember:  # what is not used again by the next time is forgotten
            self.kept["old"], self.kept["known"] = self.kept["known"], {}
        known, old = self.kept["known"], self.kept["old"]
        known[b""] = b""  # stands beside white space that is first or last
        ids = list(map(known.get, words))
        if None in ids:
            fresh = {w for w, v in zip(words, ids) if v is None}
            if old:
                again = [w for w in fresh if w in old]
                known.update(zip(again, map(old.__getitem__, again)))
                fresh.difference_update(again)
            self._learn(fresh, known)
            ids = list(map(known.__getitem__, words))
        flat, length = np.frombuffer(b"".join(ids), dtype="<u2"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 2
        start, each = np.cumsum(length) - length, length[index]
        found = [np.zeros(0, "<u2")]
        for at in range(0, len(index), 1 << 20):  # some words at a time bound the memory
            n = each[at : at + (1 << 20)]
            found.append(flat[np.arange(n.sum()) + np.repeat(start[index[at : at + len(n)]] - np.cumsum(n) + n, n)])
        every, bounds = np.concatenate(found), np.concatenate(([0], np.cumsum(each)))[ends].tolist()
        return [every[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Chunker:
    """Cut points of id streams by a rolling polynomial hash over ROLL ids."""

    def __init__(self, longest: int = 1 << 16) -> None:
        rng = np.arange(1 << 16, dtype=np.uint64)
        rng = (rng + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.mixed = rng ^ (rng >> np.uint64(29))  # a fixed number for each id
        self._grow(longest)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(STEP, n), _powers(STEP_BACK, n)

    def cuts(self, ids: np.ndarray) -> list[int]:
        """Ends of the chunks of one document."""
        n = len(ids)
        if n <= LEAST:
            return [n]
        if n > len(self.up):
            self._grow(2 * n)
        sums = np.cumsum(self.mixed[ids] * self.up[:n])
        rolled = (sums[ROLL:] - sums[:-ROLL]) * self.down[ROLL:n]  # the same for the same ROLL ids, wherever they stand
        marks = (np.flatnonzero(rolled >> np.uint64(64 - BITS) == 0) + ROLL + 1).tolist()
        out, last = [], 0
        for mark in [*marks, n]:
            while mark - last > MOST:
                last += MOST
                out.append(last)
            if mark - last >= LEAST or mark == n:
                last = mark
                out.append(mark)
        if len(out) > 1 and out[-1] == out[-2]:
            out.pop()
        return out


def merkle_root(names: list[bytes]) -> bytes:
    """The root over names in order; that of a single name is its hash, an odd one out goes up as it is."""
    level = [sha256(b"\0" + n).digest() for n in names]
    while len(level) > 1:
        level = [sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else sha256(b"").digest()


def _without_cycles(task: Callable) -> Callable:
    """The task without the collector of cycles: it makes none, and looking for them among all its words takes long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from task(batches)
        finally:
            gc.enable()

    return run


def _encoder(path: str, end_id: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunker, end = WordEncoder(path), Chunker(), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 512):  # some texts at a time bound the memory
                part = batch.slice(at, 512)
                texts = [bytes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in part["text"]]
                data = [ids + end for ids in words(texts)]
                recipes = []
                for ids in data:
                    ends = chunker.cuts(np.frombuffer(ids, dtype="<u2"))
                    recipes.append([{"digest": sha256(ids[2 * a : 2 * b]).digest(), "n": b - a} for a, b in zip([0, *ends], ends)])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["tie"], pa.array([len(d) // 2 for d in data], pa.int64()), pa.array(recipes, pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))), pa.array(data, pa.large_binary() if sum(map(len, data)) >> 30 else pa.binary())],
                    ["doc_id", "tie", "n_tokens", "recipe", "data"],
                )

    return _without_cycles(encode)


def encoded(documents: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", end_id=END_ID) -> DataFrame:
    """(doc_id, tie, n_tokens, recipe, data): every document's ids and how they are cut; tie parts rows of one id."""
    own_id, text = named(id_col, text_col)
    source = documents.select(own_id.alias("doc_id"), F.monotonically_increasing_id().alias("tie"), text.cast("binary").alias("text"))
    schema = f"{_field(source, 'doc_id')}, tie long, n_tokens long, recipe {CHUNKS}, data binary"
    return source.mapInArrow(_encoder(tokenizer, end_id), schema)


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part, sorted; before a document's row stands one with the chunks that others store, if there are any."""
    part, first, elsewhere = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        ids, ties, kinds, counts, others = (batch[c].to_pylist() for c in ("doc_id", "tie", "kind", "n_tokens", "others"))
        recipes, data = batch["recipe"], batch["data"]
        flat, offsets = recipes.flatten(), (recipes.offsets.to_numpy() - recipes.offsets[0].as_py()).tolist()
        digests, sizes = flat.field("digest").to_pylist(), flat.field("n").to_pylist()
        rows = []
        for i, kind in enumerate(kinds):
            if kind == 0:
                elsewhere = (ids[i], ties[i], set(others[i]))
                continue
            names, ns = digests[offsets[i] : offsets[i + 1]], sizes[offsets[i] : offsets[i + 1]]
            away = elsewhere[2] if elsewhere and elsewhere[:2] == (ids[i], ties[i]) else ()
            stored_ids = bytes(data[i].as_buffer())
            if away or len(set(names)) < len(names):
                at, kept, here, own = 0, [], [], set(away)
                for name, n in zip(names, ns):
                    here.append(name not in own)
                    if here[-1]:
                        kept.append(stored_ids[2 * at : 2 * (at + n)])
                        own.add(name)
                    at += n
                stored_ids = b"".join(kept)
            else:
                here = [True] * len(names)
            recipe = [{"digest": d, "n": n, "here": h} for d, n, h in zip(names, ns, here)]
            rows.append((part, ids[i], ties[i], first, counts[i], recipe, stored_ids, merkle_root(names)))
            first += counts[i]
        columns = list(zip(*rows)) if rows else [[]] * 8
        types_ = [pa.int32(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("here", pa.bool_())])), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types_)], ["part", "doc_id", "tie", "first", "n_tokens", "recipe", "data", "root"])


def write(documents: DataFrame, path: str, tokenizer: str, *, id_col="doc_id", text_col="text", end_id=END_ID) -> None:
    """Write the store of documents to path/rows and its manifest to path/manifest."""
    spark = documents.sparkSession
    staged = stored(encoded(documents, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "encoded")
    uses = staged.select("doc_id", "tie", F.explode("recipe.digest").alias("digest"))
    # names that more than one row has: the least row stores the chunk, the others are told so
    owners = uses.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("owner"), F.max(F.struct("doc_id", "tie")).alias("last"), F.count(F.lit(1)).alias("n")).where("owner <> last")
    owners = stored(owners.select("digest", "owner", "n"), "owners")
    others = skewed_join(uses, owners.select("digest", "owner"), ["digest"], hot_of(owners, "digest")).where(~F.struct("doc_id", "tie").eqNullSafe(F.col("owner"))).groupBy("doc_id", "tie").agg(F.collect_set("digest").alias("others"))
    told = others.select("doc_id", "tie", F.lit(0).alias("kind"), "others", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast(CHUNKS).alias("recipe"), F.lit(None).cast("binary").alias("data"))
    told = stored(told, "stored-elsewhere")
    rows = staged.select("doc_id", "tie", F.lit(1).alias("kind"), F.lit(None).cast("array<binary>").alias("others"), "n_tokens", "recipe", "data")
    placed = told.unionByName(rows).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie", "kind")
    schema = f"part int, {_field(staged, 'doc_id')}, tie long, first long, n_tokens long, recipe array<struct<digest: binary, n: int, here: boolean>>, data binary, root binary"
    placed.mapInArrow(_without_cycles(_pack), schema).write.option("compression", "zstd").parquet(f"{path}/rows")
    store = spark.read.parquet(f"{path}/rows")
    sums = store.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("roots"))
    sums = sums.withColumn("start", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens"))  # a row for each part
    sums.write.parquet(f"{path}/manifest")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stored row its chunks' checksums (null where they are stored elsewhere), and whether all stored bytes are what they are named."""
    for batch in batches:
        recipes, stored_ids = batch["recipe"], batch["data"]
        flat, offsets = recipes.flatten(), recipes.offsets.to_numpy() - recipes.offsets[0].as_py()
        digests, sizes, here = flat.field("digest").to_pylist(), flat.field("n").to_pylist(), flat.field("here").to_pylist()
        crcs, sound, ends = [], [], offsets.tolist()
        for i, root in enumerate(batch["root"].to_pylist()):
            buffer = stored_ids[i].as_buffer()
            data = bytes(buffer) if len(buffer) else b""
            wide = memoryview(np.frombuffer(data, dtype="<u2").astype("<u4")).cast("B") if data else memoryview(b"")
            names = digests[ends[i] : ends[i + 1]]
            at, good = 0, merkle_root(names) == root
            for name, n, own in zip(names, sizes[ends[i] : ends[i + 1]], here[ends[i] : ends[i + 1]]):
                if own:
                    good = good and sha256(data[2 * at : 2 * (at + n)]).digest() == name
                    crcs.append(zlib.crc32(wide[4 * at : 4 * (at + n)]))
                    at += n
                else:
                    crcs.append(None)
            sound.append(good and 2 * at == len(data))
        pieces = pa.StructArray.from_arrays([flat.field("digest"), flat.field("n"), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])
        pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("part", "doc_id", "tie", "first", "n_tokens")), pieces, pa.array(sound, pa.bool_())], ["part", "doc_id", "tie", "first", "n_tokens", "pieces", "sound"])


class Crc32Join:
    """The CRC-32 of two byte strings end to end, from theirs and the second's length; on arrays.

    Appending 2**k zero bytes is a linear map of the 32 bits, held here as four tables of 256.
    """

    def __init__(self, bits: int = 40) -> None:
        def zero_bytes(columns: list[int]) -> list[int]:  # the map applied twice
            apply = lambda v: __import__("functools").reduce(lambda a, i: a ^ (columns[i] if v >> i & 1 else 0), range(32), 0)
            return [apply(c) for c in columns]

        one_bit = [0xEDB88320] + [1 << i for i in range(31)]
        columns = zero_bytes(zero_bytes(zero_bytes(one_bit)))  # one byte
        self.tables, every = [], np.arange(256, dtype=np.uint32)
        for _ in range(bits):
            tables = np.zeros((4, 256), dtype=np.uint32)
            for i in range(32):
                tables[i // 8] ^= np.where(every >> np.uint32(i % 8) & np.uint32(1), np.uint32(columns[i]), np.uint32(0))
            self.tables.append(tables)
            columns = zero_bytes(columns)

    def __call__(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        crc = first.astype(np.uint32)
        for k, t in enumerate(self.tables):
            hit = np.flatnonzero(length >> k & 1)
            if len(hit):
                c = crc[hit]
                crc[hit] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        return crc ^ second.astype(np.uint32)


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined = Crc32Join()
    for batch in batches:
        pieces = batch["pieces"]
        flat, offsets = pieces.flatten(), pieces.offsets.to_numpy()
        lengths, crcs = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64) * 4, flat.field("crc").to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        counts, total = np.diff(offsets), np.zeros(len(batch), dtype=np.uint32)
        for i in range(int(counts.max(initial=0))):
            rows = np.flatnonzero(counts > i)
            at = offsets[rows] + i
            total[rows] = joined(total[rows], crcs[at], lengths[at])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(total.astype(np.int64)), batch["sound"]], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified): every document of the store, checked from its files.

    verified: the stored chunks hash to their names, the names to the recipe's root, and all chunks are found.
    """
    store, manifest = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")
    kind = "array<struct<digest: binary, n: int, crc: bigint>>"
    schema = f"part int, {_field(store, 'doc_id')}, tie long, first long, n_tokens long, pieces {kind}, sound boolean"
    found = stored(store.mapInArrow(_pieces, schema), "pieces")
    whole = found.where("NOT exists(pieces, p -> p.crc IS NULL)").select("part", "doc_id", "first", "n_tokens", "pieces", "sound")
    # only documents with chunks that are stored elsewhere have to look them up
    partial = found.where("exists(pieces, p -> p.crc IS NULL)").select("part", "doc_id", "first", "n_tokens", "sound", F.posexplode("pieces").alias("i", "p"))
    needed = stored(partial.groupBy("p.digest").agg(F.count(F.lit(1)).alias("n")), "needed")
    known = found.select(F.explode("pieces").alias("p")).where("p.crc IS NOT NULL").select("p.digest", "p.crc").join(needed, "digest", "left_semi").groupBy("digest").agg(F.max("crc").alias("crc"))
    looked = partial.select("part", "doc_id", "first", "n_tokens", "sound", "i", F.col("p.digest").alias("digest"), F.col("p.n").alias("n"), F.col("p.crc").alias("own"))
    looked = skewed_join(looked, known, ["digest"], hot_of(needed, "digest"), "left")
    crc = F.coalesce("own", "crc")
    gathered = looked.groupBy("part", "first", "doc_id", "n_tokens").agg(
        F.sort_array(F.collect_list(F.struct("i", "digest", "n", F.coalesce(crc, F.lit(0)).alias("crc")))).alias("sorted"), F.bool_and(F.col("sound") & crc.isNotNull()).alias("sound")
    )
    gathered = gathered.select("part", "doc_id", "first", "n_tokens", F.expr("transform(sorted, p -> struct(p.digest, p.n, p.crc))").alias("pieces"), "sound")
    starts = manifest.select("part", "start")
    every = whole.unionAll(gathered).join(starts, "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "pieces", "sound")
    return every.mapInArrow(_join_crcs, f"{_field(store, 'doc_id')}, start long, n_tokens long, ids_crc32 long, verified boolean")


def reconstruct(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """(doc_id, first, ids): the id streams of the given documents, put together from the chunks."""
    rows = spark.read.parquet(f"{path}/rows")
    # where each chunk that is stored here begins
    none = "named_struct('at', 0, 'here', CAST(array() AS array<struct<digest: binary, at: int, n: int>>))"
    next_ = "named_struct('at', a.at + c.n, 'here', concat(a.here, array(named_struct('digest', c.digest, 'at', a.at, 'n', c.n))))"
    own = F.expr(f"aggregate(filter(recipe, c -> c.here), {none}, (a, c) -> {next_}, a -> a.here)")
    chunks = rows.select("data", F.explode(own).alias("c")).select("c.digest", F.expr("substring(data, 2 * c.at + 1, 2 * c.n)").alias("bytes"))
    wanted = rows.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "part", "first", F.posexplode("recipe.digest").alias("i", "digest"))
    whole = wanted.join(chunks.dropDuplicates(["digest"]), "digest").groupBy("doc_id", "part", "first").agg(F.sort_array(F.collect_list(F.struct("i", "bytes"))).alias("s"))
    return whole.select("doc_id", "first", F.expr("aggregate(s, X'', (a, c) -> concat(a, c.bytes))").alias("ids"))


def round_trip(documents: DataFrame, tokenizer: str, **names) -> DataFrame:
    """Write documents as a store in the shared folder and read it back.

    A row per row of documents.  Null texts are empty and have the end id alone; null ids come first; repeated
    ids follow one another.  An empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write(documents, path, tokenizer, **names)
    return read(spark, path)
