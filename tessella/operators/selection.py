"""Which tiles form the best complete cut for a view: the selection as joins and aggregates over the tree.

Input is a row for each (view, tile) with the state that a frame begins with.  Many views, or the same view at many times, are
selected in one plan: every join and group has the view in its key.  The recursive descent is not walked: children tell their parents
level by level what is asked of descendants, then parents hand down what is asked of ancestors.  Each fold reads a tile once, no key
has more rows than a tile has children, and no table is larger than the tiles:

* a tile is reached if it and all its ancestors are active and the ancestors are open (refined, with what replaces them ready);
* a front is not ready if below it, through tiles without content alone, something visible is missing;
* displayed tiles cover a tile unless a visible leaf below it has no displayed or hidden tile above it.

A tile whose parent is not among the rows counts as a root.  Columns of the input: view, tile_id (its path, parted by slashes), depth, refine (ADD or REPLACE), sse, visible, periphery, potential (it
has or may have something to show), ready, subtree_ready, was_refining, selected_before; held, delayed and balance default to false.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import settled

#: Priorities of loads: what only surrounds the view, and what balance waits for.
PRELOAD_SCALE, BALANCE_PRIORITY = 0.25, float((1 << 53) - 1)
FLAGS = ("held", "delayed", "balance", "periphery")
ID = ["view", "tile_id"]
#: Up to so many rows in all views, a level is folded in one task: shuffling would cost more than it spreads.
FEW_ROWS = 100_000
#: So many levels of a fold are one plan, whose shuffles are used again within it; then they are written.
LEVELS_A_WRITE = 6


@dataclass(frozen=True)
class Rules:
    """What decides a refinement."""

    max_error: float = 16.0
    #: Depths with a threshold of their own.
    by_depth: dict[int, float] = field(default_factory=dict)
    hysteresis: float = 0.1
    threshold_scale: float = 1.0
    stable: bool = True
    preload_siblings: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.hysteresis < 1:
            raise ValueError("hysteresis must be in [0, 1)")

    def threshold(self, depth: Column) -> Column:
        if not self.by_depth:
            return F.lit(self.max_error)
        table = F.create_map(*[F.lit(v) for k, t in self.by_depth.items() for v in (k, float(t))])
        return F.coalesce(F.try_element_at(table, depth), F.lit(self.max_error))

    def effective(self, depth: Column, was_refining: Column) -> Column:
        """A refined tile stays so down to a lower error; a new refinement may be held back."""
        return F.when(was_refining, self.threshold(depth) * (1 - self.hysteresis)).otherwise(self.threshold(depth) * max(1.0, self.threshold_scale))

    def required(self, sse: Column, depth: Column, was_refining: Column, potential: Column, balance: Column) -> Column:
        return (sse > self.effective(depth, was_refining)) | ~potential | balance


def _prepared(tiles: DataFrame) -> DataFrame:
    for name in FLAGS:
        tiles = tiles.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in tiles.columns else F.lit(False))
    return tiles.withColumn("parent", F.regexp_extract("tile_id", "^(.*)/[^/]*$", 1))


class Levels(NamedTuple):
    depths: range
    few: bool


def _by_level(tiles: DataFrame) -> tuple[DataFrame, Levels]:
    """Tiles written so that a level is read without the others, and what levels there are."""
    t = settled(tiles.sortWithinPartitions("depth"))
    least, most, n = t.agg(F.min("depth"), F.max("depth"), F.count(F.lit(1))).first()
    return t, Levels(range(0) if least is None else range(least, most + 1), n <= FEW_ROWS)


def _walked(t: DataFrame, depths: range, few: bool, step) -> DataFrame:
    """The levels of t in the order of depths, each made by step(level, the level before it or None); LEVELS_A_WRITE of them are one written table."""
    level = lambda rows, depth: rows.where(F.col("depth") == depth).coalesce(1) if few else rows.where(F.col("depth") == depth)
    done, some, last = [], [], None
    for n, depth in enumerate(depths, 1):
        last = step(level(t, depth), last)
        some.append(last)
        if len(some) == LEVELS_A_WRITE or n == len(depths):
            done.append(settled(reduce(DataFrame.unionByName, some).sortWithinPartitions("depth")))
            some, last = [], level(done[-1], depth)
    return reduce(DataFrame.unionByName, done) if done else step(t, None)


def _told_up(t: DataFrame, levels: Levels, told: dict[str, Column]) -> DataFrame:
    """Adds for each name whether some child of the tile tells so; what a child tells may depend on what its own children told."""
    nothing = {n: F.lit(False) for n in told}

    def step(level: DataFrame, below: DataFrame | None) -> DataFrame:
        if below is None:
            return level.withColumns(nothing)
        facts = below.groupBy("view", F.col("parent").alias("tile_id")).agg(*[F.bool_or(c).alias(n) for n, c in told.items()])
        return level.join(facts, ID, "left").withColumns({n: F.coalesce(n, no) for n, no in nothing.items()})

    return _walked(t, levels.depths[::-1], levels.few, step)


def _handed_down(t: DataFrame, levels: Levels, handed: dict[str, Column], none: dict[str, Column], own: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each name what the tile's parent hands down (none: to whom nobody does), then the columns of own, which may depend on it."""

    def step(level: DataFrame, above: DataFrame | None) -> DataFrame:
        if above is None:
            got = level.withColumns(none)
        else:
            given = above.select("view", F.col("tile_id").alias("parent"), F.struct(*[c.alias(n) for n, c in handed.items()]).alias("__given"))
            got = level.join(given, ["view", "parent"], "left").withColumns({n: F.when(F.col("__given").isNull(), c).otherwise(F.col(f"__given.{n}")) for n, c in none.items()}).drop("__given")
        for name, value in (own or {}).items():
            got = got.withColumn(name, value)
        return got

    return _walked(t, levels.depths, levels.few, step)


def _flag(tiles: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    return tiles.join(marked.withColumn("__m", F.lit(True)), ID, "left").withColumn(name, F.col("__m").isNotNull()).drop("__m")


def _chosen(tiles: DataFrame, rules: Rules, base: bool, choice: Column) -> tuple[DataFrame, Levels]:
    """Adds wants, front_ok, covered, opened, can_retain, reached, up, choice, selected and refining; choice may use all but the last two.

    Upward go a missing front, up to the tile that has something to show; a bare leaf, up to the tile that is displayed or hidden; displayed
    tiles.  Downward go the nearest ready tile, what is shut, and that displayed tiles stand in for all above them.
    """
    t = _prepared(tiles).withColumn("active", F.col("visible") if base else F.col("visible") | F.col("periphery"))
    if "touches" in tiles.columns and not base and rules.preload_siblings:
        t = t.withColumn("active", F.col("active") | F.coalesce("touches", F.lit(False)))
    missing = ~F.col("subtree_ready") | (F.col("potential") & ~F.col("ready"))
    bare = F.col("visible") & ~F.col("has_children") & ~F.col("selected_before")
    structural = F.col("subtree_ready") & ~F.col("potential")
    if base:  # hidden siblings belong to the front
        bare = bare & ~structural
        kept = F.col("selected_before") & F.col("visible") & F.col("ready")
    else:
        missing, structural = F.col("visible") & missing, F.col("visible") & structural
        kept = F.col("selected_before") & F.col("active")
    t, levels = _by_level(t)
    told = {
        "has_children": F.lit(True),
        "active_child": F.col("active"),
        "front_waits": missing | (structural & F.col("front_waits")),
        "shows_through": bare | (F.col("visible") & ~F.col("selected_before") & F.col("shows_through")),
        "can_retain": kept | F.col("can_retain"),
    }
    t = _told_up(t, levels, told)
    required = rules.required(F.col("sse"), F.col("depth"), F.col("was_refining"), F.col("potential"), F.col("balance"))
    asked = F.col("subtree_ready") & (required | F.col("delayed")) & F.col("has_children")
    wants = F.col("visible") & asked if base else asked & ~(F.col("held") & F.col("potential")) & (F.col("visible") | F.col("active_child"))
    t = t.withColumns({"wants": wants, "front_ok": ~F.col("front_waits"), "covered": ~F.col("shows_through") & F.col("has_children")}).drop("front_waits", "shows_through")
    t = t.withColumn("opened", F.col("wants") & ((F.col("refine") == "ADD") | F.col("front_ok")))
    near = F.when(F.col("ready"), F.col("tile_id")).otherwise(F.col("up"))
    handed = {
        "shut": F.col("shut") | ~(F.col("active") & F.col("opened")),
        "up": F.when(F.col("refine") != "ADD", near) if base else near,
        "stood_for": F.col("stood_for") | (F.col("choice") == "kept"),
    }
    none = {"shut": F.lit(False), "up": F.lit(None).cast("string"), "stood_for": F.lit(False)}
    t = _handed_down(t, levels, handed, none, {"reached": F.col("active") & ~F.col("shut"), "choice": choice})
    ups = t.where("choice = 'up'").select("view", F.col("up").alias("tile_id")).distinct()
    named = F.col("selected") | (F.col("choice") == "self") | (F.col("stood_for") & kept)
    t = _flag(t, ups, "selected").withColumns({"selected": named, "refining": F.col("wants") & F.col("reached")})
    return t.drop("shut", "stood_for"), levels


def select_active(tiles: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(view, tile_id, refining, reached, selected, ...): the cut of each view, by the strategy `active`.

    What is wanted but not ready is stood in for: by displayed descendants, by the nearest ready ancestor, or by the tile itself.
    A tile whose subtree is not loaded is selected though it has nothing to show yet.
    """
    retain, has_up = F.lit(rules.stable) & F.col("can_retain"), F.col("up").isNotNull()
    waiting = F.col("reached") & F.col("subtree_ready") & ~F.col("wants") & F.col("potential") & ~F.col("ready")
    # of each tile: itself, its displayed descendants, the ancestor above it, or nothing
    choice = (
        F.when(~F.col("reached"), "none")
        .when(~F.col("subtree_ready"), "self")
        .when(waiting, F.when(retain, "kept").when(~F.col("visible"), "none").when(has_up, "up").otherwise("self"))
        .when(~F.col("wants"), "self")
        .when(F.col("refine") == "ADD", "self")
        .when(F.col("front_ok"), "none")
        .when(F.col("balance") & F.col("covered") & retain, "kept")
        .when(F.col("ready"), "self")
        .when(has_up, "up")
        .when(retain, "kept")
        .otherwise("self")
    )
    return _chosen(tiles, rules, False, choice)[0]


def select_base(tiles: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The cut of each view by the strategy `base`: only what is seen, and no tile beside one that it replaces.

    A tile is refined once the whole front of its children, hidden ones included, is ready.  What cannot be shown is covered by a
    ladder: displayed descendants that cover it, the tile, its nearest ready ancestor.  A view in which a coarser tile would
    have to take the place of displayed ones keeps its cut as it was (`blocked`).
    """
    laddered = F.col("reached") & (~F.col("subtree_ready") | (~F.col("wants") & F.col("potential")))
    gated = F.col("reached") & F.col("wants") & (F.col("refine") == "REPLACE") & ~F.col("front_ok")
    covered = F.lit(rules.stable) & F.col("covered")
    low = F.when(F.col("ready"), "self").when(F.col("up").isNotNull(), "up").otherwise("none")
    choice = (
        F.when(gated, F.when(covered, "kept").when(F.col("can_retain"), "blocked").otherwise(low))
        .when(laddered, F.when(covered & ~F.col("ready"), "kept").otherwise(low))
        .when(F.col("reached") & F.col("wants") & (F.col("refine") == "ADD") & F.col("ready"), "self")
        .otherwise("none")
    )
    t, levels = _chosen(tiles, rules, True, choice)
    t = settled(t.sortWithinPartitions("depth"))
    # a tile goes where a REPLACE ancestor is selected, unless an ADD tile stands between
    replaced = (F.col("refine") != "ADD") & (F.col("selected") | F.col("replaced"))
    t = _handed_down(t, levels, {"replaced": replaced}, {"replaced": F.lit(False)})
    stuck = t.where("choice = 'blocked'").select("view").distinct().withColumn("blocked", F.lit(True))
    t = t.join(stuck, "view", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    published = F.when(F.col("blocked"), F.col("selected_before") & F.col("ready")).otherwise(F.col("selected") & ~F.col("replaced"))
    t = settled(t.withColumn("selected", published).drop("replaced", "refining").sortWithinPartitions("depth"))
    # what counts as refined follows the published cut
    return _told_up(t, levels, {"refining": F.col("selected") | F.col("refining")})


def requests(selected: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(view, tile_id, kind, priority): what a frame asks for: contents and subtrees, each with the greatest priority it is asked at.

    selected is the result of a selection.  The front of a tile that is to refine loads at its error, or before all else where
    balance waits for it; tiles that only surround the view at a quarter of theirs.
    """
    t = selected
    scale = F.when(F.col("visible"), F.col("sse")).otherwise(F.col("sse") * PRELOAD_SCALE)
    gates = t.where(F.col("reached") & F.col("wants") & (F.col("refine") == "REPLACE")).select("view", F.col("tile_id").alias("parent"), F.when(F.col("balance"), F.lit(BALANCE_PRIORITY)).otherwise(F.lit(0.0)).alias("floor"))
    front = t.join(gates, ["view", "parent"])
    seen = front.where(F.col("visible") | F.lit(rules.preload_siblings) | F.col("active"))
    at = F.when(F.col("visible"), F.greatest("sse", "floor")).otherwise(F.col("sse") * PRELOAD_SCALE)
    kind = F.when(~F.col("subtree_ready"), "subtree").otherwise("content")
    asked = seen.select(*ID, kind.alias("kind"), at.alias("priority"), "potential", "ready")
    own = t.where(F.col("selected") | (F.col("reached") & F.col("potential") & ~F.col("ready") & ~F.col("wants"))).select(*ID, kind.alias("kind"), scale.alias("priority"), "potential", "ready")
    every = asked.unionAll(own).where((F.col("kind") == "subtree") | (F.col("potential") & ~F.col("ready")))
    return every.groupBy(*ID, "kind").agg(F.max("priority").alias("priority"))


def periphery_requests(tiles: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(view, tile_id, priority): loads around the view of the strategy `base`, all below those of the view, by their error."""
    deep = (F.col("sse") > rules.threshold(F.col("depth")) * max(1.0, rules.threshold_scale)) | ~F.col("potential")
    t = _prepared(tiles).withColumn("opens", ~F.col("visible") & F.col("periphery") & F.col("subtree_ready") & deep)
    # a hidden tile is asked for if it lies around the view and all hidden tiles above it refine
    shut = {"shut": F.col("shut") | (~F.col("visible") & ~F.col("opens"))}
    t = _handed_down(*_by_level(t), shut, {"shut": F.lit(False)})
    return t.where(~F.col("shut") & ~F.col("visible") & F.col("periphery") & F.col("potential") & ~F.col("ready")).select(*ID, (F.lit(-1.0) / (1 + F.col("sse"))).alias("priority"))


def cut_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(view, tile_id, change): enter, stay or leave, of two cuts (view, tile_id)."""
    a, b = before.select(*ID).distinct().withColumn("was", F.lit(1)), after.select(*ID).distinct().withColumn("now", F.lit(1))
    joined = a.join(b, ID, "full")
    return joined.select(*ID, F.when(F.col("was").isNull(), "enter").when(F.col("now").isNull(), "leave").otherwise("stay").alias("change"))


def refinement_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(view, refined, coarsened, entered, left): counts of what changed between two selections (view, tile_id, refining, selected)."""
    joined = before.select(*ID, F.col("refining").alias("r0"), F.col("selected").alias("s0")).join(after.select(*ID, F.col("refining").alias("r1"), F.col("selected").alias("s1")), ID, "full").na.fill(False)
    count = lambda c: F.count_if(F.expr(c))
    return joined.groupBy("view").agg(count("r1 AND NOT r0").alias("refined"), count("r0 AND NOT r1").alias("coarsened"), count("s1 AND NOT s0").alias("entered"), count("s0 AND NOT s1").alias("left"))


def presentation_ready(contents: DataFrame) -> DataFrame:
    """(tile_id, ready): there is something to show, and all of it is loaded; contents: tile_id, kind, status, has_handle.

    Contents of kind unknown or renderable are what may be shown.
    """
    may = F.col("kind").isin("unknown", "renderable")
    fine = (F.col("kind") == "renderable") & (F.col("status") == "ready") & F.col("has_handle")
    return contents.groupBy("tile_id").agg((F.count_if(may) > 0).alias("potential"), ((F.count_if(may) > 0) & (F.count_if(may & ~fine) == 0)).alias("ready"))


def readiness_rollup(contents: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, readiness): of a tile's contents (status idle, queued, preparing, ready, failed or cancelled)."""
    n = F.count("status")
    has = lambda *s: F.count_if(F.col("status").isin(*s))
    state = (
        F.when(n == 0, "idle").when(has("ready") == n, "ready").when(has("preparing") > 0, "preparing").when(has("queued") > 0, "queued")
        .when(has("cancelled") == n, "cancelled").when(has("failed", "cancelled") == n, "failed").otherwise("idle")
    )
    return contents.groupBy(key).agg(state.alias("readiness"))
