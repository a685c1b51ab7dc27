"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits.  Two fingerprints that differ
in at most two bits agree in at least one segment (pigeonhole) and differ in at most two bits in the
next one.  The binary Golay code (23, 12, 7) is perfect: every 23-bit word has one codeword within
three bits.  The codewords around a word and its 23 one-bit neighbours are one or six; two
words at most two bits apart have a word within one bit of both, and so share one of them.  So
(segment that agrees, codeword index of the next) are at most 18 keys for each fingerprint, and no linked pair is missed.

Fingerprints that share a key are paired and their bits compared.  A key that more than MOST_PAIRED fingerprints
share is not paired: its fingerprints are spread by their one-bit neighbours, of which two of them
have one in common exactly if they are linked, and no more than 65 fingerprints surround a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessella.llm.common import hot_of, named, row_hash, skewed_join, stored, unused, worker_memory
from tessella.llm.graphs import connected_components

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
SHINGLE = 3
#: Bits in which linked fingerprints differ at most.
BITS = 2
#: Fingerprints of a key that are compared pair by pair.
MOST_PAIRED = 256
#: Up to this many hot keys (8 bytes each) are broadcast; beyond, their rows are salted and shuffled.
BROADCAST_ROWS, SALTS = 500_000, 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed integer; a text without words has 0."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        spans = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), 1 << 14):
        h = np.array([xxh64_intdigest(s, SEED) for s in spans[at : at + (1 << 14)]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * total > len(spans)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memory("simhash")
    for batch in batches:
        prints = [fingerprint(t.as_buffer() and bytes(t.as_buffer())) if t.is_valid and len(t.as_buffer()) else 0 for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fp"])


class Golay:
    """Nearest codewords of the (23, 12, 7) code, looked up by syndrome."""

    def __init__(self) -> None:
        def remainder(v: int) -> int:
            for i in range(22, 10, -1):
                if v >> i & 1:
                    v ^= GENERATOR << (i - 11)
            return v

        one = np.array([remainder(1 << i) for i in range(23)], dtype=np.int64)
        every = np.arange(4096)
        fold = lambda bits: np.bitwise_xor.reduce([np.where(every >> i & 1, b, 0) for i, b in enumerate(bits)], axis=0)
        self.low, self.high = fold(one[:12]), fold(one[12:])
        flips = [0] + [1 << i for i in range(23)]
        errors = {a | b | c for a in flips for b in flips for c in flips}
        self.error = np.zeros(2048, dtype=np.int64)
        for e in errors:
            self.error[remainder(e)] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword within three bits of each 23-bit word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def around(self, words: np.ndarray) -> np.ndarray:
        """(n, 24): the indices around each word and its one-bit neighbours."""
        return self.index(words[:, None] ^ np.array([0] + [1 << i for i in range(23)], dtype=np.int64))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memory("simhash")
    golay = Golay()
    for batch in batches:
        prints = batch["fp"].to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            fp = prints[at : at + 4096]
            parts = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1) for low, bits in SEGMENTS]
            near = [np.sort(golay.around(p), axis=1) for p in parts]
            for i in range(3):
                fuzzy = near[(i + 1) % 3]
                fresh = np.ones(fuzzy.shape, dtype=bool)
                fresh[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
                row, col = np.nonzero(fresh)
                keys = (np.int64(i) << 40) | (parts[i][row] << 12) | fuzzy[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(keys)], ["fp", "key"])


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def _by_neighbours(prints: DataFrame) -> DataFrame:
    """Edges (a, b): around each word of 64 bits, all fingerprints within one bit are tied to the least."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    around = prints.select("fp", F.explode(flips).alias("u"))
    least = around.withColumn("m", F.min("fp").over(Window.partitionBy("u")))
    return least.where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))


def links(prints: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that differ in one or two bits.

    All such pairs are edges, but for those of keys that more than most_paired share: there, fingerprints
    are tied to the least of those around a word, which leaves the same components.
    """
    keys = stored(prints.select("fp").distinct().mapInArrow(_keys, "fp long, key long"), "golay-keys")
    hot = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_paired).select("key"), "hot-keys")
    n_hot = hot.count()
    spread = None
    if n_hot:
        if n_hot <= BROADCAST_ROWS:
            own = F.broadcast(hot)
        else:  # a hot key's rows are dealt over SALTS places
            keys = keys.withColumn("salt", F.pmod("fp", F.lit(SALTS)))
            own = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = [c for c in keys.columns if c != "fp"]
        spread = stored(keys.join(own, on, "left_semi").select("fp").distinct(), "spread-prints")
        keys = keys.join(own, on, "left_anti")
    a, b = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") > F.col("b")) & _near(F.col("a"), F.col("b"))).select("a", "b")
    return (pairs.unionAll(_by_neighbours(spread)) if spread is not None else pairs).distinct()


def components(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp, root, component_id): a row per row of documents.

    fp is the fingerprint as a signed integer, root the least fingerprint of the component, and
    component_id the least id in it (null only if all its ids are).  Null texts are empty ones; texts
    without words have fingerprint 0 and are linked like any other.  Repeated rows and ties
    get the same component.  An empty table gives no rows; other columns are not read.
    """
    return _components(documents, id_col, text_col).select("doc_id", "fp", "root", "component_id")


def _components(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """components() with text_hash, which tells apart the texts of rows whose id repeats or is null."""
    source = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    prints = stored(source.mapInArrow(_fingerprints, source.select("doc_id", "text_hash").withColumn("fp", F.lit(0).cast("long")).schema), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(rooted.join(named, "root").select("fp", "root", "component_id"), "components")
    return skewed_join(prints, known, ["fp"], hot_of(distinct, "fp")).select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_print(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with all their columns, one of each component: that of least id, null last, and of its texts that of least hash.

    An id may repeat or be null: a row is known by its id and its text's hash, and of rows that have both in common one stays.
    Null and empty texts, and others without words, are one component.  An empty table gives no rows; the
    names and types of further columns do not matter.
    """
    found = _components(documents, id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    keep = stored(found.groupBy("root").agg(least).select("root", "least.doc_id", "least.text_hash"), "kept-rows")
    hash_, root, row, kept_id, kept_hash = unused(documents, "text_hash", "root", "row", "kept_id", "kept_hash")
    (own_id, text), columns = named(id_col, text_col), named(*documents.columns)
    own = documents.withColumn(hash_, F.xxhash64(text))
    kept = keep.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash), F.col("root").alias(root))
    joined = own.join(kept, own_id.eqNullSafe(F.col(kept_id)) & (F.col(hash_) == F.col(kept_hash)))
    unique = Window.partitionBy(root).orderBy(row_hash(documents))
    return joined.withColumn(row, F.row_number().over(unique)).where(F.col(row) == 1).select(*columns)
