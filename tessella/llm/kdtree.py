"""K-d tree partitioning: shards of near equal bytes, cut at distributed weighted medians.

Only a table of a few numbers for each document is cut.  At every level each node that is still too large takes the
dimension along which it is widest and is halved at its weighted median.  The medians of all nodes of a level are found by one
distributed sort by (node, value): tasks sum bytes along their stretch, the sums of the stretches are added up, and a row goes right if
its middle byte lies beyond the half of its node.  Rows of one value (copies, a source with a third of all rows) are sorted by a
hash, and by their number at last, so ties cost no balance and no stretch is long.  Nodes are rows of a table; a node at its target
is a leaf from then on and is not sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.llm.common import named, stored

DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")
#: Up to this many nodes (about 40 bytes each) are broadcast to the rows; beyond, rows and nodes are joined by shuffle.
BROADCAST_NODES = 500_000


def _code(text: Column) -> Column:
    """A string's first six bytes as a number: its place in the order of code points."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def metadata(documents: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """The numbers that are cut: a row per document."""
    id_, text, source, lang = named(id_col, text_col, source_col, lang_col)
    text = F.coalesce(text, F.lit(""))
    place = _code(id_) if isinstance(documents.schema[id_col].dataType, StringType) else F.coalesce(id_.cast("double"), F.lit(-1.0))
    rows = documents.select(id_.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _code(source).alias("d_source"), _code(lang).alias("d_lang"), place.alias("d_id"))
    tie = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_crc32")), 1, 15), 16, 10).cast("long")
    return rows.withColumns({"d_size": F.log2(F.col("size").cast("double")), "tie": tie, "row": F.monotonically_increasing_id()})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds before: the weights of a stretch's rows up to each."""
    at = 0
    for batch in batches:
        weight = batch["weight"].to_numpy()
        before = at + np.cumsum(weight) - weight
        at += int(weight.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "before"])


def running(rows: DataFrame, weight: Column, *order: str) -> DataFrame:
    """rows with before: the sum of weight over all rows that come earlier in this order, by one distributed sort."""
    placed = rows.withColumn("weight", weight.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("stretch", F.spark_partition_id())
    schema = placed.withColumn("before", F.lit(0).cast("long")).schema
    summed = stored(placed.mapInArrow(_sums, schema), "sorted")
    stretches = summed.groupBy("stretch").agg(F.sum("weight").alias("in_all"))  # a row for each task of the sort
    stretches = stretches.select("stretch", (F.sum("in_all").over(Window.orderBy("stretch")) - F.col("in_all")).alias("from"))
    return summed.join(F.broadcast(stretches), "stretch").withColumn("before", F.col("from") + F.col("before")).drop("stretch", "from", "weight")


def _measured(rows: DataFrame) -> DataFrame:
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    return rows.groupBy("node").agg(F.sum("size").alias("whole"), F.count(F.lit(1)).alias("rows"), *ends)


def _with_nodes(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(nodes) if n <= BROADCAST_NODES else nodes.hint("shuffle_hash"), "node")


def kd_tree(rows: DataFrame, *, depth: int | None, target_bytes: int | None) -> DataFrame:
    """rows with path: their leaf's way from the root, a digit for each level (0 left, 1 right)."""
    rows = rows.withColumn("node", F.lit(""))
    leaves, level, root = [], 0, None
    while True:
        nodes = stored(_measured(rows), "nodes")
        if root is None:
            whole = nodes.first()
            root = {d: (whole[f"max_{d}"] - whole[f"min_{d}"] or 1.0) if whole else 1.0 for d in DIMENSIONS}
        width = {d: (F.col(f"max_{d}") - F.col(f"min_{d}")) / F.lit(float(root[d])) for d in DIMENSIONS}
        widest = reduce(lambda other, d: F.when(width[d] >= F.greatest(*width.values()), d).otherwise(other), reversed(DIMENSIONS[:-1]), F.lit(DIMENSIONS[-1]))
        too_large = F.lit(level < depth) if target_bytes is None else (F.col("whole") > target_bytes) & (F.col("rows") > 1)
        # where a node begins in the order of those that are sorted; a row for each
        begins = F.sum("whole").over(Window.orderBy("node")) - F.col("whole")
        to_cut = stored(nodes.where(too_large).select("node", "whole", widest.alias("along")).withColumn("begins", begins), "nodes-to-cut")
        n, all_ = to_cut.count(), nodes.count()
        if n < all_ or not n:
            leaves.append(rows if not n else stored(rows.join(F.broadcast(to_cut.select("node")) if n <= BROADCAST_NODES else to_cut.select("node"), "node", "left_anti"), "leaves"))
        if not n:
            return reduce(DataFrame.unionByName, leaves).withColumnRenamed("node", "path")
        value = reduce(lambda other, d: F.when(F.col("along") == d, F.col(d)).otherwise(other), DIMENSIONS[1:], F.col(DIMENSIONS[0]))
        own = _with_nodes(rows, to_cut, n).withColumn("value", value)
        right = 2 * (F.col("before") - F.col("begins")) + F.col("size") > F.col("whole")
        cut = running(own, F.col("size"), "node", "value", "tie", "row")
        rows = cut.withColumn("node", F.concat("node", right.cast("int").cast("string"))).drop("before", "begins", "whole", "along", "value")
        level += 1


def partition(documents: DataFrame, *, shards: int | None = 16, target_bytes: int | None = None, **names) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row per row of documents.

    Nodes are halved until there are `shards` of them (a power of two), or, where that is None, each until its bytes are target_bytes
    at most or it is a single row.  law is `bytes`: shards are near equal in bytes.  slot numbers a shard's rows from 0.
    Null texts have size 1, null ids, sources and languages come before all others; ids may be numbers or text; repeated
    rows are rows of their own; texts may be of any length.  An empty table gives no rows; other columns are not read.
    """
    rows = stored(metadata(documents, **names), "kd-rows")
    depth = None if shards is None else shards.bit_length() - 1
    leaves = kd_tree(rows, depth=depth, target_bytes=None if shards else target_bytes).select("doc_id", "size", "text_crc32", "path", "tie", "row")
    numbered = running(leaves, F.lit(1), "path", "tie", "row")
    found = stored(numbered.groupBy("path").agg(F.min("before").alias("first")), "shards")  # a row for each shard
    number = F.coalesce(F.conv("path", 2, 10).cast("int"), F.lit(0)) if shards else F.row_number().over(Window.orderBy("path")) - 1
    found = found.select("path", "first", number.alias("shard"))
    found = F.broadcast(found) if found.count() <= BROADCAST_NODES else found
    return numbered.join(found, "path").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
