"""Mixing sources to target weights by a low-discrepancy schedule.

Native: DataFrame functions only.  The mix is a row of slots, each of `block` words.  Slot i has the van der Corput point of i (its bits
reversed behind the binary point); the sources' targets, laid end to end on the line [0, 1), say which source the point falls to.  So every
stretch of the schedule holds each source in proportion to its target, up to a few slots.  A slot's rank is its number among its source's slots, and
the slot of rank k takes the k-th block of that source's words: its documents in shuffled order, end to end, and round again once they are used up.

A source's target in words says how many blocks it needs, the last of which may be cut short.  Points give it a few slots more or less: those
over are left out, those lacking stand behind the last point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import ASCII_SPACE, named, row_hash, stored, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: The schedule's resolution: full slots in the whole mix, whatever its size.
SLOTS = 1 << 18
#: Points are 32 bits.
BITS = 32
#: Stretches of the line [0, 1) whose points find their sources together, slots that are ranked together, and parts of a source's shuffled order.
RUNS = 256
RANKED = 4096
PARTS = 4096


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, ASCII_SPACE))).cast("long")


def van_der_corput(i: Column) -> Column:
    """i's lowest 32 bits reversed, over 2**32."""
    return F.conv(F.reverse(F.lpad(F.bin(i), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target, words, at, total): a row per source, by code point, null last; words is the target in whole words.

    The sources share `share` times all words by weight.  A target stops at `most` times its
    source's size; what is over goes to the others by weight until none is above.  In order of
    cap per weight the stopped sources come first, so the level at which it ends is the
    first that the next source's cap reaches.
    """
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("at", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    ends = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "at", "level"))).over(all_rows)["level"]
    ranked = ranked.withColumn("target", F.when(F.col("ratio") < ends, F.col("cap")).otherwise(F.least("cap", ends * F.col("weight"))))
    total = F.sum("target").over(all_rows)
    return ranked.withColumn("total", total).withColumn("words", F.round("target").cast("long")).select("source", "source_size", "target", "words", "at", "total")


def schedule(targets: DataFrame, total: float, slots=SLOTS, point=van_der_corput) -> tuple[DataFrame, int]:
    """((slot, at, rank), block): which source (by its place `at`) each slot goes to, and its rank among that source's slots."""
    block = max(1, -(-int(total) // slots))
    points = -(-int(total) // block)
    by_place = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = targets.select("at", (F.coalesce(F.sum("target").over(by_place), F.lit(0.0)) / max(total, 1.0)).alias("x"), F.lit(None).cast("long").alias("slot"))
    line = targets.sparkSession.range(points).select(F.lit(None).cast("int").alias("at"), point(F.col("id")).alias("x"), F.col("id").alias("slot"))
    # a point falls to the source that began last: in its stretch of the line, or in those before
    line = line.unionByName(starts.where("x < 1")).withColumn("run", F.floor(F.col("x") * RUNS))
    last = line.groupBy("run").agg(F.max(F.when(F.col("slot").isNull(), F.struct("x", "at")))["at"].alias("begun"))
    last = last.withColumn("begun", F.last("begun", True).over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    in_run = Window.partitionBy("run").orderBy("x", F.asc_nulls_first("slot"), "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = line.withColumn("own", F.last("at", True).over(in_run)).where("slot IS NOT NULL").join(last, "run").select("slot", F.coalesce("own", "begun").alias("at"))
    # ranks: in stretches of slots first
    given = given.withColumn("some", F.expr(f"slot div {RANKED}"))
    some = given.groupBy("at", "some").agg(F.count(F.lit(1)).alias("n"))
    some = some.withColumn("before", F.sum("n").over(Window.partitionBy("at").orderBy("some")) - F.col("n"))
    given = given.withColumn("i", F.row_number().over(Window.partitionBy("at", "some").orderBy("slot")) - 1).join(some, ["at", "some"])
    given = given.select("slot", "at", (F.col("before") + F.col("i")).alias("rank"))
    needs = targets.where("words > 0").select("at", F.expr(f"(words + {block - 1}L) div {block}L").alias("needed"))
    used = given.join(needs, "at").where("rank < needed").select("slot", "at", "rank")
    has = some.groupBy("at").agg(F.sum("n").alias("has"))
    short = needs.join(has, "at", "left").withColumn("has", F.coalesce("has", F.lit(0))).where("has < needed")
    behind = short.select("at", F.explode(F.sequence(F.col("has"), F.col("needed") - 1)).alias("rank"))
    every = used.unionByName(behind.select((F.lit(points) + F.col("rank") * targets.count() + F.col("at")).alias("slot"), "at", "rank")).withColumn("some", F.expr(f"slot div {RANKED}"))
    # the empty ones are left out of the count
    before = every.groupBy("some").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("some", (F.sum("n").over(Window.orderBy("some")) - F.col("n")).alias("before"))
    i = F.row_number().over(Window.partitionBy("some").orderBy("slot")) - 1
    return every.withColumn("i", i).join(before, "some").select((F.col("before") + F.col("i")).alias("slot"), "at", "rank"), block


def row_key(id_: Column, source: Column, text: Column, seed: str) -> Column:
    """What documents are shuffled by, and known by: equal only for rows of one id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("/", F.lit(seed), part(id_), F.coalesce(F.md5(text), F.lit("-")), part(source)))


def mix(documents: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", seed="mix", weights=WEIGHTS, share=SHARE, most=MOST, slots=SLOTS, point=van_der_corput) -> DataFrame:
    """(slot, key, doc_id, size, source_size, target, at, begin, turn, words_from, words): which words of which document each slot takes.

    A row of slot null stands for a document of which this pass takes nothing.  Null texts and
    sources are an empty text and a source of their own, last.  Repeated ids are documents each.  An
    empty table gives no rows.  Only the three named columns are read.  The slots' order is the mix's.
    """
    id_, source, text = named(id_col, source_col, text_col)
    sized = stored(
        documents.select(id_.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), row_key(id_, source, text, seed).alias("key"))
        .withColumn("part", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % PARTS),
        "sized",
    )
    targets = stored(source_targets(sized, weights, share, most), "targets")
    total = targets.agg(F.max("total")).first()[0] or 0.0
    slot, block = schedule(targets, total, slots, point)
    slot = stored(slot, "slots")
    # where each document begins in its source's shuffled order: sums of parts first, then within a part
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words_in"))
    parts = parts.withColumn("first", F.sum("words_in").over(Window.partitionBy("source").orderBy("part")) - F.col("words_in"))
    in_part = Window.partitionBy("source", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum("size").over(in_part) - F.col("size")
    s, p = sized.withColumn("inside", inside).alias("s"), parts.alias("p")
    begun = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.part") == F.col("p.part"))).select("s.key", "s.doc_id", "s.source", "s.size", (F.col("first") + F.col("inside")).alias("begin"))
    b, t = begun.alias("b"), targets.alias("t")
    known = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.key", "b.doc_id", "b.size", "b.begin", "t.source_size", "t.target", "t.at", F.col("t.words").alias("due"))
    rounds = known.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    rounds = rounds.withColumn("a", F.col("turn") * F.col("source_size") + F.col("begin"))
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block)))
    pieces = rounds.withColumn("rank", F.explode_outer(touched))
    low, high = F.greatest("a", F.col("rank") * block), F.least(F.col("a") + F.col("size"), (F.col("rank") + 1) * block, "due")
    # a source's last slot ends where its target does
    joined = pieces.join(slot, ["at", "rank"], "left").withColumn("slot", F.when(low < F.col("due"), F.col("slot")))
    words = F.when(F.col("slot").isNull(), F.lit(0)).otherwise(high - low).cast("long")
    return joined.select("slot", "key", "doc_id", "size", "source_size", "target", "at", "begin", "turn", (low - F.col("a")).alias("words_from"), words.alias("words"))


def taken(documents: DataFrame, **names) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot): the words the mix takes of each document, repeats counted, and the first slot that takes some (null: none does)."""
    found = _taken(mix(documents, **names), names.get("most", MOST))
    return found.withColumn("first_slot", F.array_min("slots")).drop("key", "slots")


def _taken(rows: DataFrame, most: int) -> DataFrame:
    """A row per document; slots are those at which it begins, one for each time round that takes some of it."""
    # (at, begin) names a document with words; those without are a row for each round, of which one of `most` is counted
    slots = F.array_compact(F.array(*[F.min(F.when(F.col("turn") == t, F.col("slot"))) for t in range(most)]))
    some = rows.where("size > 0").groupBy("at", "begin", "key", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), slots.alias("slots")).drop("at", "begin")
    none = rows.where("size = 0").groupBy("key", "doc_id", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("n"))
    none = none.withColumn("i", F.explode(F.sequence(F.lit(1), (F.col("n") / most).cast("int"))))
    return some.unionByName(none.select("key", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots")))


def mixed_documents(documents: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", seed="mix", most=MOST, **names) -> DataFrame:
    """The documents of the mix with all their columns, in the schedule's order: each as often as it is taken, to the nearest whole time.

    Only the document at which a source's target ends is taken in part; it counts from half of it.  Rows that
    agree in id, source and text share what is taken of them, the first of them (by a hash of all columns) what is left over.  Documents
    without words are not in the mix; null sources are a source, null ids an id.  An empty table gives no rows; the names
    of further columns do not matter.  The parts of the result are in the order of slots, and so are the rows in each.
    """
    some = _taken(mix(documents, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, most=most, **names), most).where("size > 0")
    places = [F.min(F.get("slots", F.lit(t))) for t in range(most)]
    times = some.groupBy("key").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("times"), F.count(F.lit(1)).alias("rows"), F.array_compact(F.array(*places)).alias("slots"))
    times = stored(times.where("times > 0"), "times")
    key, of, whole, rows, slots, i, again = unused(documents, "key", "key_of", "times", "rows", "slots", "i", "again")
    columns = named(*documents.columns)
    own = documents.withColumn(key, row_key(*named(id_col, source_col, text_col), seed))
    joined = own.join(times.select(F.col("key").alias(of), F.col("times").alias(whole), F.col("rows").alias(rows), F.col("slots").alias(slots)), F.col(key) == F.col(of))
    count = F.col(whole)
    if not times.where("rows > 1").isEmpty():
        joined = joined.withColumn(i, F.row_number().over(Window.partitionBy(key).orderBy(row_hash(documents))))
        count = F.floor(F.col(whole) / F.col(rows)) + (F.col(i) <= F.col(whole) % F.col(rows)).cast("long")
    repeats = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
    placed = joined.withColumn(again, F.explode(repeats)).withColumn(slots, F.element_at(slots, F.least(F.col(again), F.size(slots)).cast("int")))
    return placed.repartitionByRange(slots, key).sortWithinPartitions(slots, key).select(*columns)
