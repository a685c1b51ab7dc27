"""Prefix trie of conversations from their sorted order.

Sorted conversations that share their first turns stand together, so every node of the trie is a stretch of them.  Which
stretches there are follows from the LCP array (how many turns each conversation shares with the one before it): the nearest smaller value to
either side of an entry bounds the stretch that shares so many turns.  That is the Cartesian tree of the array; entries of equal LCP with equal bounds
are one node.  Between a node and its parent lie depths at which nothing branches: they are filled in last.  Sums over subtrees are differences
of running sums, least members come from minima of blocks.

Conversations are never gathered: turns are digests, runs of CHUNK of them are named by their rank, and runs of two names are named by the rank
of the pair, until a conversation is one name.  Running sums have two levels, the parts of a range sort and the rows in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import named, stored
from tessella.llm.mixing import word_count

#: Conversations begin with turns of the one whose id is the next lower multiple of this.
FAMILY = 20
#: Digests in a run; values in a block.
CHUNK, BLOCK = 64, 4096
#: Ids in a row of those that are hashed, and depths in a row of those that are filled in.
PACK, STRETCH = 1000, 4096
_IN_PART = (1 << 33) - 1


def numbered(df: DataFrame, *order: Column, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `at`, its place in the order (from 0), and the running sums to each row of the columns named, as sum_<name>.

    The parts of one range sort are numbered and summed on their own; what lies before a part is added.
    """
    kept = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "numbered")
    kept = kept.withColumn("part", F.shiftright("id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    parts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"part_{c}") for c in sums])
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c}") for c in ("n", *[f"part_{c}" for c in sums])])
    if sums:
        inside = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kept = kept.withColumns({f"in_{c}": F.sum(c).over(inside) for c in sums})
    found = kept.join(F.broadcast(parts), "part").withColumn("at", F.col("first_n") + F.col("id").bitwiseAND(F.lit(_IN_PART)))
    return found.select(*df.columns, "at", *[(F.col(f"first_part_{c}") + F.col(f"in_{c}")).alias(f"sum_{c}") for c in sums])


def blocks(values: DataFrame) -> DataFrame:
    """(block, run): the values (at, v) of each block in order."""
    runs = values.groupBy(F.expr(f"at div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("run"))
    return runs.select("block", F.transform("run", lambda x: x["v"]).alias("run"))


def _in_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    at, v = rows["at"].tolist(), rows["v"].tolist()
    before, after, open_ = [None] * len(v), [None] * len(v), []
    for i, x in enumerate(v):
        while open_ and v[open_[-1]] > x:
            after[open_.pop()] = at[i]
        # of equal values the one below in the stack is no smaller: what that one found holds for both
        before[i] = (before[open_[-1]] if v[open_[-1]] == x else at[open_[-1]]) if open_ else None
        open_.append(i)
    return pd.DataFrame({"at": at, "v": v, "before": pd.array(before, "Int64"), "after": pd.array(after, "Int64")})


def _search(asked: DataFrame, values: DataFrame) -> DataFrame:
    """(side, at, v, found) for (side, at, v): the nearest place before (side 0) or after (side 1) `at` whose value is less than v; none is null.

    A question that its own block does not answer is asked of the blocks' minima, and then of the block found there.
    """
    runs = stored(blocks(values), "runs")
    inside = F.expr(
        f"IF(side = 0, array_max(transform(run, (x, i) -> IF(x < v AND i < at % {BLOCK}, i, NULL))), array_min(transform(run, (x, i) -> IF(x < v AND i > at % {BLOCK}, i, NULL))))"
    )
    own = stored(asked.withColumn("block", F.expr(f"at div {BLOCK}")).join(runs, "block", "left").select("side", "at", "v", "block", (F.col("block") * BLOCK + inside).alias("found")), "found")
    away = own.where("found IS NULL").select("side", F.col("block").alias("at"), "v").distinct()
    minima = runs.select(F.col("block").alias("at"), F.array_min("run").alias("v"))
    if away.isEmpty() or runs.count() < 2:
        return own.drop("block")
    there = _search(away, minima).where("found IS NOT NULL").select("side", F.col("at").alias("block"), "v", F.col("found").alias("other"))
    at_end = F.expr("IF(side = 0, array_max(transform(run, (x, i) -> IF(x < v, i, NULL))), array_min(transform(run, (x, i) -> IF(x < v, i, NULL))))")
    there = there.join(runs.withColumnRenamed("block", "other"), "other").select("side", "block", "v", (F.col("other") * BLOCK + at_end).alias("far"))
    return own.join(there, ["side", "block", "v"], "left").select("side", "at", "v", F.coalesce("found", "far").alias("found"))


def nearest_smaller(values: DataFrame) -> DataFrame:
    """(at, v, before, after): for values (at from 0 without gaps, v), the nearest places to either side whose value is less; null where none is."""
    inside = stored(values.select("at", "v").groupBy(F.expr(f"at div {BLOCK}")).applyInPandas(_in_block, "at long, v long, before long, after long"), "in-blocks")
    minima = inside.groupBy(F.expr(f"at div {BLOCK}").alias("at")).agg(F.min("v").alias("v"))
    if minima.limit(2).count() < 2:
        return inside
    # the questions that are left over: of one block and value they have one answer
    block = F.expr(f"at div {BLOCK}")
    asked = inside.where("before IS NULL").select(F.lit(0).alias("side"), block.alias("at"), "v").unionAll(inside.where("after IS NULL").select(F.lit(1), block, "v")).distinct()
    there = _search(asked, minima).where("found IS NOT NULL").select("side", F.col("at").alias("block"), "v", F.col("found").alias("other"))
    at_end = F.expr("IF(side = 0, array_max(transform(run, (x, i) -> IF(x < v, i, NULL))), array_min(transform(run, (x, i) -> IF(x < v, i, NULL))))")
    there = stored(there.join(blocks(values).withColumnRenamed("block", "other"), "other").select("side", "block", "v", (F.col("other") * BLOCK + at_end).alias("far")), "far")
    for side, name in enumerate(("before", "after")):
        one = there.where(F.col("side") == side).select("block", "v", F.col("far").alias(f"far_{name}"))
        inside = inside.withColumn("block", block).join(one, ["block", "v"], "left").withColumn(name, F.coalesce(name, f"far_{name}")).drop("block", f"far_{name}")
    return inside.select("at", "v", "before", "after")


def least_between(values: DataFrame, spans: DataFrame) -> DataFrame:
    """(low, high, least): the least of the values (at, v) in each of the spans (low, high), both ends included."""
    runs = stored(blocks(values), "runs")
    ends = spans.withColumns({"a": F.expr(f"low div {BLOCK}"), "b": F.expr(f"high div {BLOCK}")})
    joined = ends.join(runs.select(F.col("block").alias("a"), F.col("run").alias("first")), "a").join(runs.select(F.col("block").alias("b"), F.col("run").alias("last")), "b")
    one = F.expr(f"array_min(slice(first, CAST(low % {BLOCK} + 1 AS INT), CAST(high - low + 1 AS INT)))")
    two = F.expr(f"least(array_min(slice(first, CAST(low % {BLOCK} + 1 AS INT), {BLOCK})), array_min(slice(last, 1, CAST(high % {BLOCK} + 1 AS INT))))")
    own = stored(joined.select("low", "high", "a", "b", F.when(F.col("a") == F.col("b"), one).otherwise(two).alias("least")), "least")
    between = own.where("b > a + 1").select((F.col("a") + 1).alias("low"), (F.col("b") - 1).alias("high")).distinct()
    if between.isEmpty():
        return own.select("low", "high", "least")
    inner = least_between(runs.select(F.col("block").alias("at"), F.array_min("run").alias("v")), between)
    inner = inner.select((F.col("low") - 1).alias("a"), (F.col("high") + 1).alias("b"), F.col("least").alias("inner"))
    return own.join(inner, ["a", "b"], "left").select("low", "high", F.least("least", "inner").alias("least"))


def rebuilt(conversations: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, words), (conv_id, length)): each conversation with its first turns taken from its family's."""
    conv, turn, role, text = named(conv_col, turn_col, role_col, text_col)
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where(conv.isNotNull()).select(conv.cast("long").alias("conv_id"), turn.alias("turn"), digest.alias("digest"), word_count(text).alias("words"))
    turns = stored(numbered(turns, F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest")), "turns")
    held = stored(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    convs = held.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("given", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    lengths = held.select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"))
    convs = convs.join(lengths, "family", "left").withColumn("taken", F.least("given", F.coalesce("family_n", F.lit(0))))
    convs = stored(convs.select("conv_id", "first", "family", "given", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("given"), F.lit(0))).alias("length")), "families")
    own = turns.join(convs, "conv_id").withColumn("depth", F.col("at") - F.col("first") + 1).where("depth > given")
    own = own.select("conv_id", (F.col("depth") - F.col("given") + F.col("taken")).alias("depth"), "digest", "words")
    # a family has 2 * FAMILY members at most, which take 3 turns at most
    heads = turns.where(F.col("conv_id") % FAMILY == 0).join(held.select("conv_id", "first"), "conv_id").withColumn("depth", F.col("at") - F.col("first") + 1).where("depth <= 3")
    heads = heads.select(F.col("conv_id").alias("family"), "depth", "digest", "words").join(convs.where("taken > 0").select("conv_id", "family", "taken"), "family")
    rows = own.unionByName(heads.where("depth <= taken").select("conv_id", "depth", "digest", "words"))
    return stored(rows, "rebuilt"), convs.select("conv_id", "length")


def ranked(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, at), (at, conv_id, length, n, lcp)): the rank of each conversation among the different ones, and these with their least id, how many have them, and what they share with the one before (the first: -1)."""
    run = F.array_sort(F.collect_list(F.struct("depth", "digest")))
    chunks = rows.groupBy("conv_id", F.expr(f"(depth - 1) div {CHUNK}").alias("i")).agg(F.transform(run, lambda x: x["digest"]).alias("digests"))
    chunks = stored(chunks, "chunks")
    named_ = stored(numbered(chunks.select("digests").distinct(), F.col("digests")), "names")
    levels = [stored(chunks.join(named_, "digests").select("conv_id", "i", F.col("at").alias("name")), "level")]
    while (levels[-1].agg(F.max("i")).first()[0] or 0) > 0:
        pair = [F.max(F.when(F.col("i") % 2 == side, F.col("name"))).alias(c) for side, c in enumerate("ab")]
        pairs = stored(levels[-1].groupBy("conv_id", F.expr("i div 2").alias("i")).agg(*pair), "pairs")
        names = numbered(pairs.select("a", "b").distinct(), F.col("a"), F.asc_nulls_first("b"))
        levels.append(stored(pairs.alias("p").join(names.alias("n"), F.expr("p.a = n.a AND p.b <=> n.b")).select("conv_id", "i", F.col("at").alias("name")), "level"))
    empty = lengths.where("length = 0")
    shift = 0 if empty.isEmpty() else 1  # those without turns are first
    rank = stored(levels[-1].select("conv_id", (F.col("name") + shift).alias("at")).unionAll(empty.select("conv_id", F.lit(0).cast("long"))), "ranks")
    different = stored(rank.join(lengths, "conv_id").groupBy("at").agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n")), "different")
    before = different.select((F.col("at") + 1).alias("at"), F.col("conv_id").alias("last"))
    walk = different.select("at", "conv_id").join(before, "at").withColumn("i", F.lit(0).cast("long"))
    for level in levels[-2::-1]:
        half = lambda c, as_: level.select(F.col("conv_id").alias(c), F.col("i").alias("j"), F.col("name").alias(as_))  # noqa: B023, E731
        walk = walk.withColumn("j", F.col("i") * 2).join(half("conv_id", "x"), ["conv_id", "j"], "left").join(half("last", "y"), ["last", "j"], "left")
        walk = walk.select("at", "conv_id", "last", (F.col("j") + F.coalesce((F.col("x") == F.col("y")).cast("long"), F.lit(0))).alias("i"))
    part = lambda c, as_: chunks.select(F.col("conv_id").alias(c), "i", F.col("digests").alias(as_))
    walk = walk.join(part("conv_id", "x"), ["conv_id", "i"], "left").join(part("last", "y"), ["last", "i"], "left")
    shared = F.expr("array_min(transform(x, (d, k) -> IF(k >= size(y) OR d <> y[k], k, NULL)))")
    lcp = walk.select("at", (F.col("i") * CHUNK + F.when(F.col("x").isNull() | F.col("y").isNull(), 0).otherwise(F.coalesce(shared, F.size("x")))).alias("lcp"))
    return rank, stored(different.join(lcp, "at", "left").withColumn("lcp", F.coalesce("lcp", F.lit(-1).cast("long"))), "sequences")


def ends(rank: DataFrame) -> DataFrame:
    """(at, ends_sha256): the digest of the ids that have each rank.

    SHA-256 takes its input in order, so ids of one rank end in one task; it reads them as rows of PACK ids and holds one at a time.
    """
    placed = numbered(rank.withColumnRenamed("at", "rank"), F.col("rank"), F.col("conv_id"))
    packed = placed.groupBy("rank", F.expr(f"at div {PACK}").alias("pack")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, values = [], []
            for key, ids in zip(batch["rank"].to_pylist(), batch["ids"]):
                text = ",".join(map(str, ids.values.to_pylist())).encode()
                if key == now:
                    state.update(b"," + text)
                else:
                    if state is not None:
                        keys.append(now)
                        values.append(state.hexdigest())
                    now, state = key, sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())], ["at", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["at", "ends_sha256"])

    return packed.repartition("rank").sortWithinPartitions("rank", "pack").select("rank", "ids").mapInArrow(digest, "at long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, **names) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    Turns are in the order of `turn`, null first; those of equal turn in that of a digest of role and text.  Null roles and texts are empty ones, texts and
    conversations of any length; rows without a conv_id belong to no conversation and are left out.  Repeated rows are turns each.
    Other columns are not read.  An empty table has no conversation and gives no rows.
    """
    rows, lengths = rebuilt(conversations, **names)
    rank, sequences = ranked(rows, lengths)
    many = sequences.count()
    # each conversation's LCP stands before its length, so one array bounds branchings and ends alike
    values = sequences.select((F.col("at") * 2).alias("at"), F.col("lcp").alias("v")).unionAll(sequences.select(F.col("at") * 2 + 1, "length"))
    bounded = stored(nearest_smaller(values), "bounded")
    half = lambda c: F.shiftright(F.col(c), 1)
    nodes = bounded.where("v >= 0").select(half("before").alias("start"), F.coalesce(half("after"), F.lit(many)).alias("stop"), F.col("v").alias("depth"))
    root = sequences.where("at = 0").select("at", F.lit(many), F.lit(0).cast("long"))
    nodes = nodes.unionAll(root).dropDuplicates(["start", "depth"]).withColumn("end", F.col("stop") - 1)
    # what is known of a sequence: bounds of its LCP, the next one's LCP, members and leaves up to it
    own = bounded.where("at % 2 = 0").select(half("at").alias("rank"), half("before").alias("lcp_start"))
    following = sequences.where("at > 0").select((F.col("at") - 1).alias("rank"), F.col("lcp").alias("next_lcp"))
    known = sequences.withColumnRenamed("at", "rank").join(own, "rank").join(following, "rank", "left").withColumn("next_lcp", F.coalesce("next_lcp", F.lit(-1).cast("long")))
    known = known.withColumn("leaf", (F.col("next_lcp") < F.col("length")).cast("long"))
    known = stored(numbered(known, F.col("rank"), sums=("n", "leaf")).drop("at"), "known")
    first = known.select(F.col("rank").alias("start"), "lcp", "lcp_start", F.col("length").alias("start_length"), (F.col("sum_n") - F.col("n")).alias("n_before"), (F.col("sum_leaf") - F.col("leaf")).alias("leaves_before"))
    last = known.select(F.col("rank").alias("end"), "next_lcp", "sum_n", "sum_leaf")
    nodes = nodes.join(first, "start").join(last, "end")
    is_root = F.col("depth") == 0
    above = F.when(~is_root, F.greatest("lcp", "next_lcp", F.lit(0)))
    nodes = nodes.select(
        "start", "end", "depth", "start_length", (F.col("sum_n") - F.col("n_before")).alias("n_convs"), (F.col("sum_leaf") - F.col("leaves_before")).alias("n_leaves"),
        above.alias("above"), F.when(~is_root, F.when(F.col("lcp") == above, F.col("lcp_start")).otherwise(F.col("start"))).alias("above_start"),
    )
    nodes = stored(nodes, "nodes")
    least = least_between(known.select(F.col("rank").alias("at"), F.col("conv_id").alias("v")), nodes.select(F.col("start").alias("low"), F.col("end").alias("high")).distinct())
    least = stored(least.select(F.col("low").alias("start"), F.col("high").alias("end"), F.col("least").alias("conv_id")), "least")
    # words of the sequences' turns, and their running sum
    turns = rows.join(known.select("conv_id", "rank"), "conv_id").select(F.col("rank").alias("start"), "depth", "words")
    turns = stored(numbered(turns, F.col("start"), F.col("depth"), sums=("words",)).drop("at"), "turns")
    at_top = turns.select("start", (F.col("depth") - 1).alias("above"), (F.col("sum_words") - F.col("words")).alias("words_before"))
    at_bottom = turns.select("start", "depth", F.col("sum_words").alias("words_to"))
    nodes = nodes.join(least, ["start", "end"]).join(at_bottom, ["start", "depth"], "left").join(at_top, ["start", "above"], "left")
    nodes = nodes.withColumn("saved", F.coalesce((F.col("n_convs") - 1) * (F.col("words_to") - F.col("words_before")), F.lit(0))).drop("words_before")
    nodes = stored(numbered(nodes, F.col("start"), F.col("depth"), sums=("saved",)).drop("at"), "summed")
    # a subtree is a run of nodes in this order: to the last node that begins at the stretch's end
    closing = nodes.groupBy(F.col("start").alias("end")).agg(F.max("sum_saved").alias("closing"))
    kids = nodes.where("above IS NOT NULL").groupBy(F.col("above_start").alias("start"), F.col("above").alias("depth")).agg(F.count(F.lit(1)).alias("n_kids"))
    parents = nodes.select(F.col("start").alias("above_start"), F.col("depth").alias("above"), F.col("conv_id").alias("above_conv"))
    nodes = nodes.join(closing, "end").join(kids, ["start", "depth"], "left").join(parents, ["above_start", "above"], "left")
    nodes = nodes.withColumn("below", F.col("closing") - F.col("sum_saved")).withColumnRenamed("depth", "bottom")
    # a node and the depths above it where nothing branches; stretches first, so that no task makes all depths of a long conversation
    nodes = nodes.withColumn("top", F.coalesce(F.col("above") + 1, F.lit(0)))
    cut = nodes.withColumn("from", F.explode(F.sequence("top", "bottom", F.lit(STRETCH).cast("long"))))
    if not cut.where("bottom - top >= %d" % STRETCH).isEmpty():
        cut = cut.repartition("start", "from")
    each = cut.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH - 1, F.col("bottom")))))
    each = each.join(turns, ["start", "depth"], "left").join(ends(rank).withColumnRenamed("at", "start"), "start", "left")
    here = F.coalesce((F.col("n_convs") - 1) * (F.col("words_to") - F.col("sum_words") + F.col("words")), F.lit(0))
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.coalesce("n_kids", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (here + F.col("below")).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("start_length"), F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
