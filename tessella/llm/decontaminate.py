"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

Native: DataFrame functions only.  Every window of a benchmark item (13 words in a row) is a
run of three-word shingles.  A document holds the window only if it holds each of its
shingles, so the rarest one over all documents is the only prefix token that has to be joined.
The length bound (the window must fit into the document) and the positional bound (the
shingle's place in the window fixes where the window must begin) leave few candidates,
and each of those is compared word by word.  Windows are numbered; which items hold them is looked up at the
end, once for each set of windows that some document has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fold_ascii, hot_of, named, skewed_join, split_words, stored, unused

#: What stands between words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Up to so many bytes a table made of the benchmark is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Places over which a frequent shingle's rows are dealt.
SALTS = 64


def words(text: Column) -> Column:
    return split_words(fold_ascii(text), GAP)


def _shingle(array: str, at: Column, size: int) -> Column:
    # get() gives null where there is no such word: documents too short have one row without a place
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(size)])


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """((wid, window, length), (wid, item)): each distinct window once, numbered, and a row for each item that holds it."""
    item, text = named(id_col, text_col)
    w = F.col("w")
    held = (
        benchmark.select(item.cast("string").alias("item"), words(text).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("length", F.least(F.size("w"), F.lit(width)))
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))))
        .select("item", "length", F.array_join(F.slice(w, F.col("at") + 1, F.col("length")), " ").alias("window"))
        .distinct()
    )
    held = stored(held, "item-windows")
    windows = stored(held.groupBy("window", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    members = skewed_join(held.where("item IS NOT NULL"), windows.select("window", "wid"), ["window"], hot_of(windows, "window"))
    return windows.select("wid", "window", "length"), stored(members.select("wid", "item"), "members")


def _small(df: DataFrame, width: str) -> bool:
    """Whether the stored table df, with rows of so many bytes each (an SQL expression), may be broadcast."""
    return (df.agg(F.sum(F.expr(width))).first()[0] or 0) <= BROADCAST_BYTES


def hits(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", width=13) -> tuple[DataFrame, DataFrame]:
    """((doc, digest, start, length, wid), (wid, item)): each place of a document where a benchmark window occurs, and whose windows they are.

    doc is the document's id and digest a hash of its text; the two together name a row, so that
    repeated ids with other texts stay apart.
    """
    windows, members = item_windows(benchmark, item_col, item_text_col, width)
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]
    doc, text = named(id_col, text_col)
    base = documents.select(doc.alias("doc"), F.xxhash64(text).alias("digest"), words(text).alias("w"))

    def found(size: int) -> DataFrame:
        own = windows.where(F.least("length", F.lit(SHINGLE)) == size)
        grams = own.withColumn("win", F.split("window", " ")).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("length") - size))).select("wid", "off", _shingle("win", F.col("off"), size).alias("h"))
        grams = stored(grams, "grams")
        distinct = stored(grams.select("h").distinct(), "shingles")
        # outer, so that no filter computes the words a second time below the explode
        at = base.withColumn("at", F.explode_outer(F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size))))
        at = at.withColumn("h", _shingle("w", F.col("at"), size))
        # how often each benchmark shingle stands in all documents
        shingles, n = at.select("h"), F.count(F.lit(1)).alias("n")
        if _small(distinct, "16L"):
            counts = shingles.join(F.broadcast(distinct), "h").groupBy("h").agg(n)
        else:  # counted before the shuffle, so that a frequent shingle is one row of each task
            counts = shingles.groupBy("h").agg(n).join(distinct.hint("shuffle_merge"), "h")
        counts = stored(counts, "rarity")
        # a shingle that no document has rules its windows out: the inner joins drop them
        whole = grams.groupBy("wid").agg(F.count(F.lit(1)).alias("grams"))
        prefix = (
            grams.join(counts, "h")
            .groupBy("wid")
            .agg(F.min(F.struct("n", "off", "h")).alias("rarest"), F.count(F.lit(1)).alias("seen"))
            .join(whole, "wid")
            .where(F.col("seen") == F.col("grams"))
            .select("wid", "rarest.off", "rarest.h", "rarest.n")
            .join(own, "wid")
        )
        prefix = stored(prefix, "prefix")
        start = F.col("at") - F.col("off")
        fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
        same = F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ") == F.col("window")
        at = at.withColumn("n_words", F.size("w"))
        if _small(prefix, "64L + 2 * octet_length(window)"):
            return at.join(F.broadcast(prefix.drop("n")), "h").where(fits).withColumn("start", start).where(same).select("doc", "digest", "start", "length", "wid")
        # no text goes through the shuffle by shingle: the shingle's neighbours do, as hashes; a frequent one's rows are dealt by them
        wanted = prefix.drop("n", "window")
        hot = hot_of(stored(prefix.groupBy("h").agg(F.max("n").alias("n")), "prefix-shingles"), "h")
        places = at.select("doc", "digest", "at", "h", "n_words")
        if hot is None:
            near = places.join(wanted.hint("shuffle_merge"), "h")
        else:
            hot, salts = F.broadcast(hot), F.lit(SALTS)
            often = wanted.join(hot, "h", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            near = places.join(hot, "h", "left_semi").withColumn("salt", F.pmod(F.hash("doc", "digest", "at"), salts)).join(often.hint("shuffle_merge"), ["h", "salt"]).drop("salt")
            near = near.unionByName(places.join(hot, "h", "left_anti").join(wanted.join(hot, "h", "left_anti").hint("shuffle_merge"), "h"))
        near = near.where(fits).select(F.col("doc").alias("d"), F.col("digest").alias("g"), start.alias("start"), "length", "wid").distinct()
        near = near.join(base, F.col("d").eqNullSafe(F.col("doc")) & (F.col("g") == F.col("digest")))
        text_of = F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ")
        near = near.select("doc", "digest", "start", "length", "wid", text_of.alias("there"))
        return near.join(own.select("wid", "window"), "wid").where("there = window").select("doc", "digest", "start", "length", "wid").distinct()

    if not sizes:
        nothing = base.where(F.lit(False)).select("doc", "digest", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("wid"))
        return nothing, members
    return reduce(DataFrame.unionAll, map(found, sorted(sizes))), members


def named_items(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(set, n_items, items_sha256) for the sets of windows (set, wid): the items that hold any of them, once for each set."""
    items = sets.join(members, "wid").select("set", "item").distinct().groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return items.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", share=20, **names) -> DataFrame:
    """One row per row of documents: how many of its words benchmark windows cover, and the items concerned.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, digest.  Null and empty
    texts have no words and are clean.  Repeated rows get equal rows.  Items of null id count
    as hits but are not named.  An empty benchmark leaves every document clean; other columns
    of either table are not looked at.
    """
    place = F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end"))
    covered = F.aggregate(
        F.sort_array("places"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(p["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], p["end"]).alias("end")),
        lambda acc: acc["n"],
    )
    places, members = hits(documents, benchmark, id_col=id_col, text_col=text_col, **names)
    wids = F.array_sort(F.collect_set("wid"))  # no more than the document has places
    found = places.groupBy("doc", "digest").agg(F.collect_set(place).alias("places"), wids.alias("wids"))
    found = stored(found.select("doc", "digest", covered.alias("hit"), "wids", F.md5(F.array_join("wids", ",")).alias("set")), "found")
    sets = found.groupBy("set").agg(F.any_value("wids").alias("wids"), F.count(F.lit(1)).alias("n"))
    sets = stored(sets, "sets")
    items = stored(named_items(sets.select("set", F.explode("wids").alias("wid")), members), "set-items")
    found = skewed_join(found.drop("wids"), items, ["set"], hot_of(sets, "set"), "left")
    own_id, text = named(id_col, text_col)
    base = documents.select(own_id.alias("doc_id"), F.xxhash64(text).alias("own"), F.size(words(text)).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("digest")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.col("own").alias("digest"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents, with all their columns, that contamination() does not report.

    Rows of one id and text stay or go together; documents without words stay.  Empty tables on either side and further
    columns of any name do not matter.
    """
    own_id, text = named(names.get("id_col", "doc_id"), names.get("text_col", "text"))
    bad_id, bad_digest = unused(documents, "bad_id", "bad_digest")
    bad = contamination(documents, benchmark, **names).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_digest)).distinct()
    return documents.join(bad, own_id.eqNullSafe(F.col(bad_id)) & (F.xxhash64(text) == F.col(bad_digest)), "left_anti")
