"""Selections whose cuts are balanced 2:1: repeated until no tile stands beside one two or more levels coarser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.quadtree import KEY, MOST_PASSES, balance_refinements, held_refinements, imbalances, refine_cut
from tessella.operators.selection import ID, Rules, cut_changes, select_active, select_base
from tessella.storage import settled


def _located(tiles: DataFrame) -> DataFrame:
    """ns also tells views apart."""
    return tiles.withColumn("ns", F.concat_ws("|", "view", F.coalesce("ns", F.lit(""))))


def select_balanced(tiles: DataFrame, rules: Rules = Rules(), *, most_passes: int = MOST_PASSES, **edges) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(selection, unbalanced): the strategy `active` with 2:1 balance; tiles also have ns, lod, x, y.

    Passes go on while the visible cut asks for further refinements, then while refinements have to be held; both only grow, so
    it ends, at the latest after most_passes.  unbalanced has the visible tiles whose neighbours cannot refine yet.
    """
    tiles = settled(_located(tiles))
    keys = tiles.select(*ID, *KEY, "ready", "selected_before")
    asked = held = tiles.where(F.lit(False)).select(*KEY)
    refined_before = None
    known, held_n = -1, 0
    for _ in range(most_passes):
        state = tiles.drop("balance", "held").join(asked.withColumn("balance", F.lit(True)), list(KEY), "left").join(held.withColumn("held", F.lit(True)), list(KEY), "left")
        chosen = settled(select_active(state, rules))
        cut = chosen.where("selected AND visible").select(*KEY)
        more = settled(asked.unionAll(balance_refinements(cut, **edges)).distinct())
        n = more.count()
        if n != known and n > 0 and n != (known if known > 0 else 0):
            asked, known = more, n
            continue
        if refined_before is None:
            from tessella.operators.hierarchy import ancestors

            shown = ancestors(keys.where("selected_before").select("tile_id").distinct()).join(keys.where("selected_before").select(*ID), "tile_id").select("view", F.col("ancestor").alias("tile_id")).distinct()
            refined_before = settled(keys.join(shown, ID, "left_semi").select(*KEY).distinct())
        again = settled(held.unionAll(held_refinements(imbalances(cut, **edges), keys, refined_before)).distinct())
        m = again.count()
        if m == held_n:
            break
        held, held_n = again, m
    return chosen, imbalances(cut, **edges)


def close_base_cut(selection: DataFrame, *, most_passes: int = MOST_PASSES, **edges) -> DataFrame:
    """(view, tile_id): the cut of select_base, admitted as a balanced quadtree.

    Coarse neighbours are split where their children are ready.  A new tile that would need a split which is not ready gives its place
    back to what was displayed there; where displayed tiles alone are to blame, the view keeps its cut.
    """
    t = settled(_located(selection))
    displayed = t.where("selected_before").select(*ID, *KEY, "ready")
    desired = settled(t.where("selected").select(*ID, *KEY))
    child_ready = t.groupBy("view", F.col("parent").alias("tile_id")).agg(F.bool_and("ready").alias("all_ready"), F.count(F.lit(1)).alias("n"))
    ready = settled(t.join(child_ready.where("all_ready AND n = 4").select(*ID), ID, "left_semi").select(*KEY))
    for _ in range(most_passes):
        balanced, blocked = refine_cut(desired.select(*KEY), ready, **edges)
        if blocked.isEmpty():
            return t.join(balanced.select(*KEY), list(KEY), "left_semi").select(*ID)
        involved = t.join(blocked, list(KEY), "left_semi").select(*ID)
        fresh = settled(involved.join(displayed.select(*ID), ID, "left_anti"))
        stuck = settled(involved.join(fresh.select("view").distinct(), "view", "left_anti").select("view").distinct())
        from tessella.operators.hierarchy import ancestors

        up = ancestors(fresh.select("tile_id").distinct()).join(fresh, "tile_id")
        shown = up.join(displayed.select("view", F.col("tile_id").alias("ancestor")), ["view", "ancestor"]).groupBy(*ID).agg(F.min_by("ancestor", "distance").alias("at"))
        place = settled(fresh.join(shown, ID, "left").select("view", F.coalesce("at", "tile_id").alias("place")).distinct())

        def within(rows: DataFrame, place=place) -> DataFrame:
            ids = rows.select("tile_id").distinct()
            chain = ancestors(ids).select("tile_id", F.col("ancestor").alias("place")).unionAll(ids.select("tile_id", F.col("tile_id").alias("place")))
            return rows.join(chain, "tile_id").join(place, ["view", "place"], "left_semi").select(*ID, *KEY).distinct()

        back = within(displayed.where("ready")).unionAll(displayed.where("ready").join(stuck, "view", "left_semi").select(*ID, *KEY))
        rest = desired.join(within(desired).select(*ID), ID, "left_anti").join(stuck, "view", "left_anti")
        before = desired
        desired = settled(rest.select(*ID, *KEY).unionByName(back.select(*ID, *KEY)).distinct())
        if not stuck.isEmpty() or cut_changes(before, desired).where("change <> 'stay'").isEmpty():
            break
    return desired.select(*ID)


def select_base_balanced(tiles: DataFrame, rules: Rules = Rules(), **edges) -> DataFrame:  # noqa: B008
    return close_base_cut(select_base(tiles, rules), **edges)
