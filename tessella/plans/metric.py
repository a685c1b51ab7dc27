"""The spatial metric in earth-centred metres: from flattened tiles to bounds, and from bounds and cameras to what a selection needs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geodesy as G
from tessella.functions import spatial as S
from tessella.operators.culling import looked_at
from tessella.operators.hierarchy import vertical_objects, world_transforms
from tessella.sources.tilesets import UTM_EXTENSION, member, tile_columns

#: What pairs all tiles with all cameras takes this many cameras at most; EcefMetric.looked_at takes any number.
MOST_CAMERAS = 1000
UTM_TYPE = "struct<epsg: double, zone: int, hemisphere: string, minEasting: double, minNorthing: double, maxEasting: double, maxNorthing: double, vertical: struct<reference: string, direction: string, minimum: double, maximum: double, groundElevation: double>>"


@dataclass(frozen=True)
class EcefMetric:
    """How tiles are placed and seen.  The ellipsoid must be given; UTM extents are placed by what utm says, if anything.

    horizon is `plane` (conservative) or `tile-heights` (by measured heights).  scale is the vertical exaggeration.
    """

    ellipsoid: G.Ellipsoid
    horizon_culling: bool = True
    horizon: str = "plane"
    viewport_height: float = S.VIEWPORT_HEIGHT
    vertical_fov: float = S.VERTICAL_FOV
    utm: G.UtmPlacement = field(default_factory=G.UtmPlacement)
    utm_extension: str = UTM_EXTENSION
    scale: float = 1.0
    geodetic_heights: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.ellipsoid, G.Ellipsoid):
            raise TypeError("an ellipsoid must be given")
        if self.horizon not in ("plane", "tile-heights"):
            raise ValueError(f"unknown horizon {self.horizon!r}")
        if not (math.isfinite(self.viewport_height) and self.viewport_height > 0):
            raise ValueError("the viewport height must be positive and finite")
        if not 0 < self.vertical_fov < math.pi:
            raise ValueError("the vertical field of view must be in (0, pi)")
        if not (math.isfinite(self.scale) and self.scale >= 0):
            raise ValueError("the vertical scale must be finite and not negative")

    def derive(self, tiles: DataFrame) -> DataFrame:
        """(tile columns, world, bounds, error, utm_status): flattened tiles placed.

        Boxes and spheres take the product of transforms from the root down; regions and UTM extents are absolute.  A UTM extent
        that can be placed wins over the standard volume beside it.  Errors grow with the transform's scale.
        """
        known = F.try_variant_get(member(member(F.col("tile"), "boundingVolume"), "extensions"), "$", "map<string,variant>")
        with_utm = tiles.select("*", known.alias("__known"))
        name = F.try_element_at(F.filter(F.map_keys("__known"), lambda k: k.rlike(self.utm_extension)), F.lit(1))
        with_utm = with_utm.select("*", F.try_variant_get(F.try_element_at("__known", name), "$", UTM_TYPE).alias("utm")).drop("__known")
        columns = tile_columns(with_utm)
        worlds = world_transforms(columns.select("tile_id", "parent_id", "depth", "transform"))
        rows = columns.join(worlds, "tile_id")
        m = [F.col("world")[i] for i in range(16)]
        placed = F.when(F.col("utm").isNotNull(), G.bounds_of_utm(F.col("utm"), self.ellipsoid, self.utm))
        rows = rows.select("*", placed.alias("__utm"), S.max_scale(m).alias("__scale"))
        standard = F.when(F.col("box").isNotNull(), S.bounds_of_box(F.col("box"), m)).when(F.col("sphere").isNotNull(), S.bounds_of_sphere(F.col("sphere"), m)).when(F.col("region").isNotNull(), G.bounds_of_region(F.col("region"), self.ellipsoid))
        rows = rows.select("*", F.coalesce(F.when(F.col("__utm.status") == "placed", F.col("__utm.bounds")), standard).alias("bounds"), (F.col("geometric_error") * F.col("__scale")).alias("error"), F.col("__utm.status").alias("utm_status"))
        return self.rescaled(rows.drop("__utm", "__scale"))

    def rescaled(self, placed: DataFrame) -> DataFrame:
        """Bounds under the vertical scale: objects move with their origin, what is above them grows."""
        if self.scale == 1:
            return placed
        frame = G.vertical_frame_geodetic(self.ellipsoid) if self.geodetic_heights else G.vertical_frame_radial(self.ellipsoid.a)
        rows = placed.join(vertical_objects(placed.select("tile_id", "world")), "tile_id", "left")
        moved = S.place_vertically(F.col("bounds"), S.Vec.of(F.col("vertical_object")), frame, self.scale)
        return rows.withColumn("bounds", F.when(F.col("bounds").isNotNull(), moved))

    def at_scale(self, placed: DataFrame, scale: float) -> DataFrame:
        """All tiles as another vertical scale places them; placed: derived at scale 1, which stays what every scale starts from."""
        return replace(self, scale=scale).rescaled(placed)

    def seen(self, placed: DataFrame, cameras: DataFrame) -> DataFrame:
        """(view, tile columns, visible, periphery, sse): every tile for every camera.

        cameras: (view, camera, planes, periphery_planes): camera is a struct (position, clip_min, clip_max, viewport_height, vertical_fov,
        tan_half_fov).  Cameras are the few rows of a frame: they are counted, and broadcast to the tiles.
        """
        if cameras.limit(MOST_CAMERAS + 1).count() > MOST_CAMERAS:
            raise ValueError(f"more than {MOST_CAMERAS} cameras: looked_at() takes any number")
        b, camera, occluder = F.col("bounds"), F.col("camera"), self._occluder()
        pairs = placed.crossJoin(F.broadcast(cameras))
        return self._judged(pairs, placed, S.inside_view(b, camera, F.col("planes"), occluder), S.in_periphery(b, camera, F.col("periphery_planes"), occluder))

    def looked_at(self, placed: DataFrame, cameras: DataFrame) -> DataFrame:
        """Like seen, for any number of cameras, but only with tiles whose parents have something in view or around it below them.

        Every visible tile and every tile of the periphery is there.  A tile left out is neither, nor is anything below it, so the strategy
        `active` selects the same from either.  Heights over the horizon are asked of single tiles, not on the way down.
        """
        rows, views = looked_at(placed, cameras, self._occluder())
        return self._judged(rows, placed, views.inside("planes", self._occluder()), F.col("__around") & views.inside("periphery_planes", self._occluder()))

    def _occluder(self) -> float | None:
        return self.ellipsoid.minimum_radius if self.horizon_culling and self.horizon == "plane" else None

    def _judged(self, rows: DataFrame, placed: DataFrame, inside: Column, around: Column) -> DataFrame:
        b, camera = F.col("bounds"), F.col("camera")
        hidden = F.lit(False)
        if self.horizon_culling and self.horizon == "tile-heights":
            low, high = (F.col(c) if c in placed.columns else F.lit(None).cast("double") for c in ("height_min", "height_max"))
            lowest = placed.agg(F.min("height_min")).first()[0] if "height_min" in placed.columns else 0.0
            hidden = S.beyond_horizon(S.Vec.of(b["center"]), b["radius"], S.Vec.of(camera["position"]), self.ellipsoid.minimum_radius, float(min(0.0, lowest or 0.0)), low, high)
        sse = S.screen_space_error(F.col("error"), b, S.Vec.of(camera["position"]), viewport=camera["viewport_height"], fov=camera["vertical_fov"], tan_half=camera["tan_half_fov"], viewport_default=self.viewport_height, fov_default=self.vertical_fov)
        clear = F.coalesce(~hidden, F.lit(True))
        return rows.select("view", *[c for c in placed.columns], (inside & clear).alias("visible"), (around & clear).alias("periphery"), sse.alias("sse"))


def refined_heights(tiles: DataFrame, measured: DataFrame, from_parent=None) -> DataFrame:
    """Adds height_min and height_max: measured by a tile's own content, else resolved from what its parent's content measured.

    tiles: (tile_id, parent_id, ordinal, ...); measured: (tile_id, low, high, ...).  from_parent(parent, ordinal) gives a struct (low, high).
    """
    own = measured.select("tile_id", F.struct("low", "high").alias("__own"))
    above = measured.select(F.col("tile_id").alias("parent_id"), F.struct(*[c for c in measured.columns if c != "tile_id"]).alias("__above"))
    rows = tiles.join(own, "tile_id", "left").join(above, "parent_id", "left")
    inherited: Column = F.when(F.col("__above").isNotNull(), from_parent(F.col("__above"), F.col("ordinal"))) if from_parent else F.lit(None).cast("struct<low: double, high: double>")
    best = F.coalesce("__own", inherited)
    return rows.select(*tiles.columns, best["low"].alias("height_min"), best["high"].alias("height_max"))
