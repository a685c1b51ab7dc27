"""Which tiles a camera has to look at: a frontier of (camera, tile) that goes down only below what may be seen.

A tile need not lie inside its parent, so what is asked first is its enclosure: the box around its box and all below it, and a ball about its
middle around its sphere and all below it, folded upward once for a tree.  Roots stand in cells of a grid with one cell at its top, so that no
camera is paired with all roots.  A round goes one level down; its rows are what was looked at, so the work grows with what is seen and not
with cameras times tiles.  A level of few tiles is broadcast to the cameras, and its pairs are neither written nor shuffled; pairs are written only
where a level has many tiles, and once in STEPS levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import spatial as S
from tessella.storage import settled

AXES = "xyz"
#: A node at which this part of a frontier stands is shared by several tasks; there are as many such nodes at most.
HOT_PART, SALTS = 1000, 32
#: Rounding between an enclosure and the spheres in it.
SLACK = 1e-9
#: A level of this many tiles at most is broadcast; a frontier is written once it has gone down so many of those.
FEW_TILES, STEPS = 20_000, 8
#: So many planes of a camera are columns of their own, as many as a view has sides; others stay an array.
SIDES = 6
ENDS = [f"{end}_{a}" for end in ("low", "high") for a in AXES]
#: More partitions than any table has: what comes before is compiled apart from what follows, as one method for many levels would be too long to be compiled at all.
APART = 1_000_000


@dataclass(frozen=True)
class Views:
    """Cameras with flat columns: rows (view, camera, those of planes and periphery, clip box); sides: planes that some camera has, more: whether some has more than SIDES."""

    rows: DataFrame
    sides: int
    more: bool

    @classmethod
    def of(cls, cameras: DataFrame) -> Views:
        """cameras: (view, camera, planes, periphery_planes), read once.  A clip box that is not there has ends beyond which nothing lies: NaN is greater than all."""
        spark = cameras.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        dealt = cameras.select("view", "camera", "planes", "periphery_planes").repartition(tasks, "view")
        clipped = F.col("camera.clip_min").isNotNull()
        clip = {f"__clip_{end}_{a}": F.coalesce(F.when(clipped, F.col(f"camera.clip_{at}.{a}").cast("double")), F.lit(none)) for end, at, none in (("low", "min", -math.inf), ("high", "max", math.nan)) for a in AXES}
        count = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("planes", "periphery_planes")])
        first = dealt.withColumns({"__around": F.col("periphery_planes").isNotNull(), "__sides": count, **clip, **_flat("planes")}).coalesce(APART)
        rows = settled(first.withColumns(_flat("periphery_planes")).drop("planes", "periphery_planes"))
        most = rows.agg(F.max("__sides")).first()[0] or 0
        sides, more = min(most, SIDES), most > SIDES
        # what is never null is said to be so: tests are shorter
        used = [F.coalesce(c, F.lit(math.nan)).alias(c) for p in ("planes", "periphery_planes") for i in range(sides) for c in _side(p, i).values()]
        ends = [F.coalesce(f"__clip_{e}", F.lit(math.nan)).alias(f"__clip_{e}") for e in ENDS]
        arrays = [f"__{p}_more" for p in ("planes", "periphery_planes") if more]
        return cls(rows.select("view", "camera", F.coalesce("__around", F.lit(False)).alias("__around"), *ends, *used, *arrays), sides, more)

    def behind(self, planes: str, test: Callable[[Column | dict, Column], Column]) -> Column:
        """Whether test(plane, the length of its normal, one at least) holds for some plane."""
        found = [test({k: F.col(c) for k, c in _side(planes, i).items() if k != "long"}, F.col(_side(planes, i)["long"])) for i in range(self.sides)]
        if self.more:
            found.append(F.coalesce(F.exists(f"__{planes}_more", lambda p: test(p, _long(p))), F.lit(False)))
        return reduce(lambda s, t: s | t, found, F.lit(False))

    def cut_off(self, own: str, occluder: float | None) -> Column:
        """Whether what the row's columns own.. enclose lies outside the clip box or behind the horizon."""
        apart = reduce(lambda s, t: s | t, [(F.col(f"{own}high_{a}") < F.col(f"__clip_low_{a}")) | (F.col(f"{own}low_{a}") > F.col(f"__clip_high_{a}")) for a in AXES])
        if occluder is None:
            return apart
        return apart | F.coalesce(S.below_horizon_plane(_middle(own), F.col(f"{own}reach"), S.Vec.of(F.col("camera.position")), occluder), F.lit(False))

    def may_see(self, occluder: float | None) -> Column:
        """Whether anything in the enclosure of the row may pass the tests of inside(), with either planes: never false if some sphere or box in it does."""
        behind = lambda planes: self.behind(planes, lambda p, long: S.outside_plane(_middle("__in_"), F.col("__in_reach") * long, p))
        return F.col("__in_open") | ~(self.cut_off("__in_", occluder) | (behind("planes") & (~F.col("__around") | behind("periphery_planes"))))

    def inside(self, planes: str, occluder: float | None) -> Column:
        """spatial.inside_view, asked of the columns of told()."""
        return F.col("__boundless") | ~(self.cut_off("__own_", occluder) | self.behind(planes, lambda p, _: S.outside_plane(_middle("__own_"), F.col("__own_reach"), p)))


def _middle(own: str = "") -> S.Vec:
    return S.Vec(*(F.col(f"{own}at_{a}") for a in AXES))


def _side(planes: str, i: int) -> dict[str, str]:
    return {k: f"__{planes}_{i}_{k}" for k in (*"xyzw", "long")}


def _long(p: Column) -> Column:
    """A plane's normal need not have length one."""
    return F.greatest(F.lit(1.0), S.Vec.of(p).length())


def _flat(planes: str) -> dict[str, Column]:
    """The first planes as columns; what is not there is NaN, and nothing lies behind a plane that has NaN in it."""
    out = {}
    for i in range(SIDES):
        p = F.get(F.col(planes), F.lit(i))
        out |= {_side(planes, i)[k]: F.coalesce(p[k].cast("double"), F.lit(math.nan)) for k in "xyzw"} | {_side(planes, i)["long"]: _long(p)}
    return out | {f"__{planes}_more": F.when(F.size(planes) > SIDES, F.slice(planes, SIDES + 1, F.size(planes)))}


def _own(bounds: Column) -> dict[str, Column]:
    """A tile's box, and its sphere (at_x, at_y, at_z, reach); open: it has no finite bounds, and is never culled."""
    ends = {f"{end}_{a}": (bounds[side][a].cast("double"), none) for end, side, none in (("low", "min", -math.inf), ("high", "max", math.inf)) for a in AXES}
    ball = {**{f"at_{a}": (bounds["center"][a].cast("double"), 0.0) for a in AXES}, "reach": (bounds["radius"].cast("double"), math.inf)}
    finite = F.coalesce(reduce(lambda s, t: s & t, [F.abs(c) < float("inf") for c, _ in (*ends.values(), *ball.values())]), F.lit(False))
    return {**{n: F.when(finite, c).otherwise(F.lit(none)) for n, (c, none) in (ends | ball).items()}, "open": ~finite}


def _widest() -> list[Column]:
    return [F.min(f"low_{a}").alias(f"low_{a}") for a in AXES] + [F.max(f"high_{a}").alias(f"high_{a}") for a in AXES] + [F.bool_or("open").alias("open")]


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [p * p for p in parts]))


def _with_below(own: DataFrame, below: DataFrame) -> DataFrame:
    """own with all that lies below it: in its box, and in its ball, whose middle stays."""
    middle = own.select(F.col("node").alias("parent"), *[F.col(f"at_{a}").alias(f"up_{a}") for a in AXES])
    away = _length([F.col(f"at_{a}") - F.col(f"up_{a}") for a in AXES])
    folded = below.join(middle, "parent").withColumn("reach", away + F.col("reach")).groupBy(F.col("parent").alias("node")).agg(*_widest(), F.max("reach").alias("reach"))
    rows = own.join(folded.select("node", F.struct(*folded.columns[1:]).alias("below")), "node", "left")
    low = [F.least(f"low_{a}", f"below.low_{a}").alias(f"low_{a}") for a in AXES]
    high = [F.greatest(f"high_{a}", f"below.high_{a}").alias(f"high_{a}") for a in AXES]
    return rows.select("node", "parent", *low, *high, *[f"at_{a}" for a in AXES], F.greatest("reach", "below.reach").alias("reach"), (F.col("open") | F.coalesce("below.open", F.lit(False))).alias("open"))


def _cells(roots: DataFrame) -> tuple[DataFrame, int]:
    """The roots, each in its cell of the finest grid (x, y, z), and how many levels of cells there are over them."""
    at = {a: F.when(~F.col("open"), F.col(f"at_{a}")) for a in AXES}
    rows = roots.withColumns(at)
    span = rows.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{f.__name__}_{a}") for f in (F.min, F.max) for a in AXES]).first()
    levels = max(0, math.ceil(math.log(max(1, span["n"]), 8)))
    side = max([(span[f"max_{a}"] or 0.0) - (span[f"min_{a}"] or 0.0) for a in AXES]) or 1.0
    index = lambda a: F.least(F.floor((F.col(a) - (span[f"min_{a}"] or 0.0)) / side * (1 << levels)), F.lit((1 << levels) - 1))
    return rows.withColumns({a: F.coalesce(index(a), F.lit(0)).cast("long") for a in AXES}), levels


def _name(levels: int) -> Column:
    """The cell at a level; levels counts from the one cell at the top."""
    return F.concat_ws("/", F.lit(str(levels)), *AXES)


def _ball_of_box() -> dict[str, Column]:
    """The ball through the corners of the box around all balls of a cell."""
    at = {f"at_{a}": F.when(F.col("open"), F.lit(0.0)).otherwise((F.col(f"first_{a}") + F.col(f"last_{a}")) * 0.5) for a in AXES}
    return at | {"reach": F.when(F.col("open"), F.lit(math.inf)).otherwise(_length([F.col(f"last_{a}") - F.col(f"first_{a}") for a in AXES]) * 0.5)}


ENCLOSURE = ["node", "parent", *ENDS, *[f"at_{a}" for a in AXES], "reach", "open"]


def enclosures(placed: DataFrame) -> list[DataFrame]:
    """Levels from the top cell down to the deepest tiles, ENCLOSURE each; the levels of tiles come last.

    placed: (tile_id, parent_id, depth, bounds); a parent is one depth above its children, roots have depth 0.
    """
    tiles = settled(placed.select(F.col("tile_id").alias("node"), F.col("parent_id").alias("parent"), "depth", *[c.alias(n) for n, c in _own(F.col("bounds")).items()]))
    deepest = tiles.agg(F.max("depth")).first()[0]
    if deepest is None:
        return []
    levels, below = [], None
    for depth in range(deepest, -1, -1):
        own = tiles.where(F.col("depth") == depth).select(*ENCLOSURE)
        below = settled(own if below is None else _with_below(own, below))
        levels.append(below)
    cells, n = _cells(below)
    below = settled(cells.withColumns({"parent": _name(n), **{f"first_{a}": F.col(f"at_{a}") - F.col("reach") for a in AXES}, **{f"last_{a}": F.col(f"at_{a}") + F.col("reach") for a in AXES}}))
    levels[-1] = below.select(*ENCLOSURE)
    for k in range(n, -1, -1):
        up = below.withColumn("node", F.col("parent"))
        halved = up.withColumns({a: F.floor(F.col(a) / 2).cast("long") for a in AXES}) if k else up
        named = halved.withColumn("parent", _name(k - 1) if k else F.lit(None).cast("string"))
        ends = [F.min(f"first_{a}").alias(f"first_{a}") for a in AXES] + [F.max(f"last_{a}").alias(f"last_{a}") for a in AXES]
        below = settled(named.groupBy("node").agg(F.max("parent").alias("parent"), *_widest(), *ends, *[F.max(a).alias(a) for a in AXES]).withColumns(_ball_of_box()))
        levels.append(below.select(*ENCLOSURE))
    return levels[::-1]


def _tested(level: DataFrame) -> DataFrame:
    """A level's enclosures, a little larger than rounding; nothing in them is null."""
    wide = F.col("reach") * (1 + SLACK) + _middle().length() * SLACK
    known = {**{c: F.col(c) for c in (*ENDS, *[f"at_{a}" for a in AXES])}, "reach": wide}
    return level.select("node", F.col("parent").alias("__on"), *[F.coalesce(c, F.lit(math.nan)).alias(f"__in_{n}") for n, c in known.items()], F.coalesce("open", F.lit(True)).alias("__in_open"))


def told(tiles: DataFrame) -> DataFrame:
    """tiles with their box and sphere in columns that are never null: what is null, and so fails no test, gets a value that fails none."""
    b = F.col("bounds")
    low, high, at = ({f"__own_{n}_{a}": F.coalesce(b[of][a].cast("double"), F.lit(none)) for a in AXES} for n, of, none in (("low", "min", -math.inf), ("high", "max", math.nan), ("at", "center", math.nan)))
    return tiles.select("*", *[c.alias(n) for n, c in (low | high | at).items()], F.coalesce(b["radius"].cast("double"), F.lit(math.inf)).alias("__own_reach"), b.isNull().alias("__boundless"))


def joined_at(rows: DataFrame, level: DataFrame, key: str) -> DataFrame:
    """rows and level joined on key; nodes at which much of rows stands are dealt to SALTS tasks, and level's rows for them copied."""
    total = rows.count()
    hot = F.broadcast(settled(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * HOT_PART >= max(total, HOT_PART * HOT_PART)).select(key, F.lit(True).alias("__hot"))))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("view"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("__salt")
    salts = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt")
    left = rows.join(hot, key, "left").select(*rows.columns, salt)
    right = level.join(hot, key, "left").select(*level.columns, salts)
    return left.join(right, [key, "__salt"]).drop("__salt")


def looked_at(placed: DataFrame, cameras: DataFrame, occluder: float | None = None) -> tuple[DataFrame, Views]:
    """(columns of Views and of told()): the tiles each camera has to look at, each with all its siblings.

    All tiles that a camera or its periphery may see are among them; whoever is looked at has a parent below which something may be seen.
    placed: (tile_id, parent_id, depth, bounds, ...); cameras: (view, camera, planes, periphery_planes), any number of them.
    """
    views, tiles = Views.of(cameras), settled(placed)
    counts = dict(tiles.where("depth IS NOT NULL").groupBy("depth").count().collect())
    levels = enclosures(tiles)
    if not levels:
        return views.rows.limit(0).crossJoin(told(tiles)), views
    deepest = max(counts)
    cells, kept = len(levels) - 1 - deepest, [*views.rows.columns, *told(tiles).columns]
    frontier, steps, asked, out = views.rows.withColumn("__on", F.lit("0/0/0/0")).coalesce(APART), 0, -1, []
    for i, level in enumerate(levels[1:], 1):
        depth = i - cells
        few = (counts.get(depth, 0) if depth >= 0 else level.count()) <= FEW_TILES
        if steps and not (few and steps < STEPS):
            frontier, steps = settled(frontier), 0
        met = lambda rows: frontier.join(F.broadcast(rows), "__on") if few else joined_at(frontier, rows, "__on")  # noqa: B023, E731
        if depth > asked:
            own, tested, asked = told(tiles.where(F.col("depth") == depth)), _tested(level), depth
            rows = own.join(tested.select(F.col("node").alias("tile_id"), "__on"), "tile_id") if depth == 0 else own.withColumn("__on", F.col("parent_id"))
            if few and depth < deepest and counts.get(depth, 0) + counts.get(depth + 1, 0) <= FEW_TILES:  # two levels at once: children with what is asked of their parent
                below, asked = told(tiles.where(F.col("depth") == depth + 1)).join(tested.withColumnRenamed("node", "parent_id"), "parent_id"), depth + 1
                both = rows.withColumn("__in_open", F.lit(True)).unionByName(below, allowMissingColumns=True)
                out.append(met(both.withColumns({c: F.coalesce(c, F.lit(math.nan)) for c in tested.columns if c.startswith("__in_") and c != "__in_open"})).where(views.may_see(occluder)).select(*kept))
            else:
                out.append(met(rows).select(*kept))
        if asked == deepest:
            break
        below = met(_tested(level)).where(views.may_see(occluder)).select(*views.rows.columns, F.col("node").alias("__on"))
        frontier, steps = (below.coalesce(APART), steps + 1) if few else (settled(below), 0)
        if not few and frontier.isEmpty():
            break
    return reduce(DataFrame.unionAll, out), views
