"""Product codes of vectors by Lloyd's rounds that filter entries through kd-trees.

A vector's components become integers and are cut into equal parts, each with a codebook of its own.  The rows of
a partition are put into blocks; for each part a block has a kd-tree over its points: every node halves its points at the median of its
widest dimension and keeps their box, sum and count.  A round goes down each tree with the entries that may be nearest to some point of the
node: an entry goes if no point of the box is nearer to it than to the entry nearest the middle of the box.  Where one entry is left the
node's sum and count are added to it as a whole; only in leaves are points compared one by one.  All figures
are integers, so a result does not depend on how rows are dealt out.

Trees are built once and written to the shared folder.  A round moves one row for each entry and task; codebooks, of fixed size, are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hot_of, named, skewed_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and points of a leaf at most.
BLOCK, LEAF = 4096, 24


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def levels(n: int) -> int:
    """How often n points are halved until leaves hold LEAF at most."""
    return max(0, -(-n // LEAF) - 1).bit_length()


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin among the sorted points, and n."""
    return (np.arange((1 << level) + 1) * n) >> level


def planted(points: np.ndarray) -> np.ndarray:
    """The order of the points (n, p) in their kd-tree: each node of each level is a run of it."""
    n = len(points)
    order = np.arange(n)
    for level in range(levels(n)):
        at = bounds(n, level)
        now = points[order]
        wide = np.maximum.reduceat(now, at[:-1]) - np.minimum.reduceat(now, at[:-1])
        node = np.repeat(np.arange(1 << level), np.diff(at))
        order = order[np.lexsort((now[np.arange(n), wide.argmax(axis=1)[node]], node))]
    return order


class Tree:
    """Boxes, sums and points of one part of a block; points stand in the tree's order."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.astype(np.int64)
        self.depth = levels(len(points))
        self.at = [bounds(len(points), level) for level in range(self.depth + 1)]
        self.low = [np.minimum.reduceat(self.points, at[:-1]) for at in self.at]
        self.high = [np.maximum.reduceat(self.points, at[:-1]) for at in self.at]
        self.sums = [np.add.reduceat(self.points, at[:-1]) for at in self.at]

    def nearest(self, entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """(whole, places, codes): (level, nodes, entry of each) of the nodes assigned as a whole, and single points with theirs."""
        whole = []
        nodes, maybe = np.zeros(1, dtype=np.int64), np.ones((1, len(entries)), dtype=bool)
        for level in range(self.depth + 1):
            low, high = self.low[level][nodes], self.high[level][nodes]
            far = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            best = np.where(maybe, far, np.iinfo(np.int64).max).argmin(axis=1)
            own = entries[best][:, None]
            # the point of the box that is best for an entry against `best`
            corner = np.where(entries[None] > own, high[:, None], low[:, None])
            lead = ((entries[None] - own) * (entries[None] + own - 2 * corner)).sum(axis=2)
            maybe &= (lead < 0) | ((lead == 0) & (np.arange(len(entries))[None] <= best[:, None]))
            alone = maybe.sum(axis=1) == 1
            whole.append((level, nodes[alone], best[alone]))
            nodes, maybe = nodes[~alone], maybe[~alone]
            if not len(nodes):
                return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if level < self.depth:
                nodes, maybe = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(maybe, 2, axis=0)
        begin, size = self.at[-1][nodes], np.diff(self.at[-1])[nodes]
        places = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = self.points[places]
        # products below 2**53 are exact in floating point, and quicker
        exact = np.float64 if max(np.abs(self.points).max(), np.abs(entries).max()) ** 2 * 3 * entries.shape[1] < 1 << 53 else np.int64
        far = (entries**2).sum(axis=1)[None].astype(exact) - 2 * (found.astype(exact) @ entries.T.astype(exact))
        return whole, places, np.where(np.repeat(maybe, size, axis=0), far, np.inf if exact is np.float64 else np.iinfo(np.int64).max).argmin(axis=1)

    def totals(self, entries: np.ndarray) -> np.ndarray:
        """(entries, 1 + p): the count and sum of the points nearest to each entry."""
        out = np.zeros((len(entries), 1 + entries.shape[1]), dtype=np.int64)
        whole, places, codes = self.nearest(entries)
        for level, nodes, best in whole:
            np.add.at(out[:, 0], best, np.diff(self.at[level])[nodes])
            np.add.at(out[:, 1:], best, self.sums[level][nodes])
        np.add.at(out[:, 0], codes, 1)
        np.add.at(out[:, 1:], codes, self.points[places])
        return out

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, in the tree's order."""
        out = np.zeros(len(self.points), dtype=np.int64)
        whole, places, codes = self.nearest(entries)
        for level, nodes, best in whole:
            begin, size = self.at[level][nodes], np.diff(self.at[level])[nodes]
            out[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(best, size)
        out[places] = codes
        return out


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); an error where sums of squares of these could leave 64 bits."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and float(np.abs(scaled).max()) ** 2 * 16 * scaled.shape[-1] >= 2.0**63:
        raise ValueError("components are too large for exact distances of 64 bits")
    return scaled.astype(np.int64)


def _blocks(size: int, parts: int):
    """Tasks that make blocks of (id, label, vector) rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                x = whole_numbers(some["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(some), size)).astype(np.int32)
                orders = [planted(p) for p in np.split(x, parts, axis=1)] if size else []
                points = b"".join(np.ascontiguousarray(p[o]).tobytes() for p, o in zip(np.split(x, parts, axis=1), orders)) if size else b""
                one = pa.array([0, len(some)], pa.int32())
                keep = [pa.ListArray.from_arrays(one, some[c]) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int32()), *keep, pa.array([b"".join(o.astype(np.int32).tobytes() for o in orders)], pa.binary()), pa.array([points], pa.binary())], ["n", "ids", "labels", "orders", "points"])

    return build


def _trees(n: int, points: bytes, parts: int) -> list[Tree]:
    return [Tree(p) for p in np.frombuffer(points, np.int32).reshape(parts, n, -1)]


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, p) after so many rounds over the blocks, from those given."""
    parts, entries, p = books.shape
    names = ["n", *(f"s{i}" for i in range(p))]
    for _ in range(rounds):
        now = books

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((parts, entries, 1 + p), dtype=np.int64)
            for batch in batches:
                for n, points in zip(batch["n"].to_pylist(), batch["points"]):
                    for i, tree in enumerate(_trees(n, points.as_buffer(), parts)):
                        out[i] += tree.totals(now[i])
            flat = out.reshape(parts * entries, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), *(pa.array(c) for c in flat.T)], ["entry", *names])

        found = blocks.select("n", "points").mapInArrow(totals, ", ".join(f"{c} long" for c in ["entry", *names])).groupBy("entry").agg(*[F.sum(c).alias(c) for c in names])
        books = books.copy().reshape(parts * entries, p)
        for r in found.where("n > 0").collect():  # a row for each entry
            books[r["entry"]] = np.array([r[c] for c in names[1:]], dtype=np.int64) // r["n"]
        books = books.reshape(parts, entries, p)
    return books


def coded(embeddings: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a row per kept row of embeddings, repeated ones included.

    Rows whose vector is null or holds null or non-finite components are left out, as are those whose vector is not as long as the first one (by
    id, null last, then by its components), whose length must be a multiple of `parts`.  Codebooks begin with the vectors of the
    `entries` smallest ids; fewer rows make fewer entries, no rows no result.  Null labels are one label; a null id is kept.  Other columns are not read.
    """
    id_, vector, label = named(id_col, vector_col, label_col)
    kept = embeddings.select(id_.alias("id"), label.alias("label"), vector.alias("vector")).where(finite(F.col("vector")))
    seeds = kept.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector")
    first = seeds.limit(1).collect()
    size = len(first[0]["vector"]) if first else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("vector") == size)
    start = np.array([r["vector"] for r in kept.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()], dtype=np.float64)
    books = whole_numbers(start.reshape(len(start), size)).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    blocks = stored(kept.mapInArrow(_blocks(size, parts), f"n int, ids array<{kinds['id']}>, labels array<{kinds['label']}>, orders binary, points binary"), "blocks")
    if size and len(start):
        books = learn(blocks, books, rounds)
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (n, orders, points) in enumerate(zip(batch["n"].to_pylist(), batch["orders"], batch["points"])):
                code, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                if size:
                    for i, (order, tree) in enumerate(zip(np.frombuffer(orders.as_buffer(), np.int32).reshape(parts, n), _trees(n, points.as_buffer(), parts))):
                        own = tree.codes(books[i])
                        code[order, i] = own
                        error[order] += ((tree.points - books[i][own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch["ids"][k].values, batch["labels"][k].values, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    found = stored(blocks.mapInArrow(encode, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of"), F.col("label").isNull().alias("none")]
    found = found.select("*", *key)
    sums = stored(found.groupBy("of", "none").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "label-errors")
    joined = skewed_join(found, sums.drop("n"), ["of", "none"], hot_of(sums, "of", "none"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
