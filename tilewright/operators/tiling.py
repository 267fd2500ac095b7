"""Tile grids, sliding and overlapping, bounded by regions, and the join of tiles to regions.

``images`` has (image_id, width, height); ``regions`` has (image_id, name, x0,
y0, x1, y1) and, for other shapes than boxes, ``ring``. Tiles are (image_id,
name, x0, y0, x1, y1) in whole pixels.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import polygon
from ..functions.geometry import Box, box, box_intersection, ring_bounds, ring_of
from ..graph import connected_components
from ..storage import materialize
from .spatial_join import box_self_join, cells, with_cells

DEFAULT_SLIDES = ((512, 0), (0, 512), (512, 512))


@F.pandas_udf(T.DoubleType())
def ring_area_in_box(ring: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Area of each ring inside its box."""
    return pd.Series([None if r is None else polygon.clip_area(polygon.as_ring(r), *b) for r, *b in zip(ring, x0, y0, x1, y1)], dtype=float)


def _named(regions: DataFrame, bound: str | list[str]) -> DataFrame:
    return regions.where(F.col("name").isin([bound] if isinstance(bound, str) else bound))


def _joined_name(bound: str | list[str]) -> str:
    return bound if isinstance(bound, str) else "-".join(bound)


def dissolve(regions: DataFrame, keys: list[str] = ("image_id",)) -> DataFrame:
    """The union of the rings of each key: (keys.., part, ring, area), a row for each outer ring, the largest first; holes are left out.

    Rings whose boxes meet nothing stand for themselves; others are joined by
    components of meeting boxes, so a key with many regions is many groups.
    Needs ``roi_idx``, different within a key, and ``ring``; null rings are left out.
    """
    keys = list(keys)
    rows = regions.where("ring is not null").select(F.xxhash64(*keys, "roi_idx").alias("id"), *keys, "ring")
    b = ring_bounds(F.col("ring"))
    rows = materialize(rows.select("*", *[getattr(b, c).alias(c) for c in b._fields]), "regions")
    near = connected_components(box_self_join(rows.select("id", *keys, "x0", "y0", "x1", "y1"), 1024, "id", keys).select("l_id", "r_id"), "l_id", "r_id")
    grouped = rows.join(near, rows["id"] == near["node"], "left").withColumn("g", F.coalesce("component", "id"))

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        rings = polygon.union([[polygon.positive(polygon.as_ring(r))] for r in part.sort_values("id")["ring"]])
        outer = [r for r in rings if polygon.signed_area(r) > 0]
        return pd.DataFrame([(*[part[k].iloc[0] for k in keys], [{"x": x, "y": y} for x, y in r.tolist()], polygon.signed_area(r)) for r in outer], columns=[*keys, "ring", "area"])

    fields = ", ".join(f"{k} {regions.schema[k].dataType.simpleString()}" for k in keys)
    out = grouped.groupBy("g").applyInPandas(joined, f"{fields}, ring array<struct<x:double,y:double>>, area double")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), F.col("ring")[0])) - 1
    return out.select(*keys, rank.alias("part"), "ring", "area")


def bounding_regions(images: DataFrame, regions: DataFrame | None, bound: str | list[str] | None) -> DataFrame:
    """Parts that bound the tiling: the regions of that name or names, or, of images without one, the whole image."""
    whole = images.select("image_id", F.lit("tile").alias("name"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    if regions is None or bound is None:
        return whole
    named = _named(regions, bound)
    rest = whole.join(named.select("image_id").distinct(), "image_id", "left_anti")
    return named.unionByName(rest, allowMissingColumns=True) if "ring" in regions.columns else named.select(*rest.columns).unionByName(rest)


def _part_area(parts: DataFrame, t: Column) -> Column:
    exact = box_intersection(box("p"), t)
    return F.when(F.col("p_ring").isNull(), exact.cast("double")).otherwise(ring_area_in_box("p_ring", t.x0, t.y0, t.x1, t.y1)) if "p_ring" in parts.columns else exact


def _inside(tiles: DataFrame, parts: DataFrame, edge_thresh: float, tile_size: int, strict: bool = False) -> DataFrame:
    """Tiles whose area in all parts together reaches ``edge_thresh`` of their own.

    Parts are dealt to the grid cells of ``tile_size`` they cover, tiles to the
    cell of each corner; shares are summed over parts before the ratio is taken.
    """
    p = parts.select([F.col(c).alias(f"p_{c}") for c in parts.columns])
    b, t = box("p"), box()
    p = with_cells(p, tile_size, False, "p", ("p_cx", "p_cy"))
    dealt = with_cells(tiles, tile_size, False)
    once = (F.floor(F.greatest(b.x0, t.x0) / tile_size) == F.col("cx")) & (F.floor(F.greatest(b.y0, t.y0) / tile_size) == F.col("cy"))
    pairs = dealt.join(p, (F.col("image_id") == F.col("p_image_id")) & (F.col("cx") == F.col("p_cx")) & (F.col("cy") == F.col("p_cy")) & (box_intersection(b, t) > 0) & once)
    shares = pairs.withColumn("share", _part_area(p, t)).groupBy(*tiles.columns).agg(F.sum("share").alias("share"))
    need = t.area * edge_thresh
    return shares.where(F.col("share") > need if strict else (F.col("share") >= need) & (F.col("share") > 0)).select(*tiles.columns)


def tile_grid(images: DataFrame, regions: DataFrame | None = None, bound: str | list[str] | None = None, tile_size: int = 1024, edge_thresh: float = 1.0, slides: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Tiles aligned to 0 that lie in the bounding regions and the image by at least ``edge_thresh``.

    Each of ``slides`` moves the tiles kept so far; moved tiles must reach the
    ratio in the regions and lie in the image whole. ``name`` is the offset, such
    as ``(512, 0)``. Parts of one name count together.
    """
    parts = bounding_regions(images, regions, bound)
    b, t = box(), box()
    grid = parts.withColumn("i", F.explode(cells(b.x0, b.x1, tile_size))).withColumn("j", F.explode(cells(b.y0, b.y1, tile_size)))
    grid = grid.select("image_id", "i", "j").distinct()
    corner = [(F.col(k) * tile_size).cast("long").alias(c) for k, c in (("i", "x0"), ("j", "y0"))]
    far = [((F.col(k) + 1) * tile_size).cast("long").alias(c) for k, c in (("i", "x1"), ("j", "y1"))]
    base = grid.select("image_id", F.lit("(0, 0)").alias("name"), *corner, *far)
    size = images.select("image_id", "width", "height")
    in_image = (F.greatest(F.least(t.x1, F.col("width")) - F.greatest(t.x0, F.lit(0)), F.lit(0)) * F.greatest(F.least(t.y1, F.col("height")) - F.greatest(t.y0, F.lit(0)), F.lit(0)))
    base = _inside(base, parts, edge_thresh, tile_size).join(size, "image_id").where(in_image >= edge_thresh * t.area)
    moves = F.array(*[F.struct(F.lit(f"({dx}, {dy})").alias("n"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in slides])
    out = base.select("image_id", "name", "x0", "y0", "x1", "y1")
    if slides:
        moved = base.withColumn("m", F.explode(moves)).select("image_id", F.col("m.n").alias("name"), *[(F.col(c) + F.col(f"m.d{c[0]}")).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "width", "height")
        moved = moved.where(in_image >= t.area).select(*out.columns)
        out = out.unionByName(_inside(moved, parts, edge_thresh, tile_size))
    return out


def overlap_steps(dim: Column, tile_size: int, overlap: float) -> tuple[Column, int]:
    """How many tiles an axis has and their step: overlap = ceil(share * size), count = ceil((dim - overlap) / step)."""
    over = math.ceil(overlap * tile_size)
    step = tile_size - over
    return F.greatest(F.ceil((dim - over) / step), F.lit(0)).cast("long"), step


def tile_overlap(images: DataFrame, regions: DataFrame | None = None, bound: str | list[str] | None = None, tile_size: int = 1024, overlap: float = 0.5, edge_thresh: float = 1.0) -> DataFrame:
    """A regular overlapping grid, its last tiles clamped to the image: (image_id, name, tile_idx, x0, y0, x1, y1).

    With ``bound``, a name or several, tiles stay whose share inside those regions
    is above ``edge_thresh`` of their clamped area, and have the names joined by
    ``-`` as their own; regions that overlap each other count twice where they do,
    so :func:`dissolve` such first. ``tile_idx`` counts rows of tiles.
    """
    nx, step = overlap_steps(F.col("width"), tile_size, overlap)
    ny, _ = overlap_steps(F.col("height"), tile_size, overlap)
    grid = images.select("image_id", "width", "height", nx.alias("nx"), ny.alias("ny")).where("nx > 0 and ny > 0")
    grid = grid.withColumn("j", F.explode(F.expr("sequence(0L, ny - 1)"))).withColumn("i", F.explode(F.expr("sequence(0L, nx - 1)")))
    edge = lambda k, top: F.least(F.col(k) * step + tile_size, F.col(top))
    tiles = grid.select("image_id", F.lit(_joined_name(bound) if bound else "tile").alias("name"), (F.col("j") * F.col("nx") + F.col("i")).alias("tile_idx"), (F.col("i") * step).alias("x0"), (F.col("j") * step).alias("y0"), edge("i", "width").alias("x1"), edge("j", "height").alias("y1"))
    if regions is None or bound is None:
        return tiles
    return _inside(tiles, _named(regions, bound), edge_thresh, tile_size, strict=True)


_RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"])))
CLIP = T.StructType([T.StructField("area", T.DoubleType()), T.StructField("parts", _RINGS)])


@F.pandas_udf(CLIP)
def ring_clip(ring: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
    """Each ring inside its box: the area and the separate parts."""
    made = []
    for r, *b in zip(ring, x0, y0, x1, y1):
        own = polygon.as_ring(r)
        parts = polygon.clip_parts(own, *b)
        made.append((polygon.clip_area(own, *b), [[{"x": x, "y": y} for x, y in p.tolist()] for p in parts]))
    return pd.DataFrame(made, columns=["area", "parts"])


def tile_roi_join(tiles: DataFrame, rois: DataFrame, cell: int, overlap_thresh: float = 0.05, exclude: tuple[str, ...] = (), geometry: bool = False, keep_multipart: bool = False) -> DataFrame:
    """Tiles joined to the regions that have more than ``overlap_thresh`` of their own area inside: tile columns, roi_idx, class, clip_area.

    Regions of excluded names are left out. The join is on the image and grid
    cells, so neither side is compared with all of the other; rings are joined
    by the region's id to the pairs that boxes leave, and so not copied to every
    cell (``roi_idx`` must differ within an image). With ``geometry``, ``clip``
    holds the rings of the part inside the tile, and regions that fall into
    several parts there are left out unless ``keep_multipart``.
    """
    kept = rois.where(~F.col("name").isin(*exclude)) if exclude else rois
    ringed = "ring" in kept.columns
    r = kept.select([F.col(c).alias(f"p_{c}") for c in kept.columns if c != "ring"])
    b, t = box("p"), box()
    r = with_cells(r, cell, False, "p", ("p_cx", "p_cy"))
    dealt = with_cells(tiles, cell, False)
    once = (F.floor(F.greatest(b.x0, t.x0) / cell) == F.col("cx")) & (F.floor(F.greatest(b.y0, t.y0) / cell) == F.col("cy"))
    pairs = dealt.join(r, (F.col("image_id") == F.col("p_image_id")) & (F.col("cx") == F.col("p_cx")) & (F.col("cy") == F.col("p_cy")) & once & (box_intersection(b, t) > 0))
    own = b.area
    inner = ring_of(Box(F.greatest(b.x0, t.x0).cast("double"), F.greatest(b.y0, t.y0).cast("double"), F.least(b.x1, t.x1).cast("double"), F.least(b.y1, t.y1).cast("double")))
    if not ringed:
        pairs = pairs.withColumn("clip_area", box_intersection(b, t)).where(F.col("clip_area") > F.lit(overlap_thresh) * own)
        pairs = pairs.withColumn("clip", F.array(inner)) if geometry else pairs
    else:
        rings = kept.select(F.col("image_id").alias("q_image_id"), F.col("roi_idx").alias("q_roi_idx"), F.col("ring").alias("p_ring"))
        pairs = pairs.join(rings, (F.col("p_image_id") == F.col("q_image_id")) & (F.col("p_roi_idx") == F.col("q_roi_idx")))
        own = F.when(F.col("p_ring").isNull(), own.cast("double")).otherwise(F.col("p_area"))
        boxes = pairs.where("p_ring is null").withColumn("clip_area", box_intersection(b, t).cast("double"))
        shapes = pairs.where("p_ring is not null")
        if geometry:
            boxes = boxes.withColumn("clip", F.array(inner))
            shapes = shapes.withColumn("c", ring_clip("p_ring", t.x0, t.y0, t.x1, t.y1)).withColumns({"clip_area": F.col("c.area"), "clip": F.col("c.parts")}).drop("c")
        else:
            shapes = shapes.withColumn("clip_area", ring_area_in_box("p_ring", t.x0, t.y0, t.x1, t.y1))
        pairs = boxes.unionByName(shapes).where(F.col("clip_area") > F.lit(overlap_thresh) * own)
    if geometry and not keep_multipart:
        pairs = pairs.where(F.size("clip") == 1)
    return pairs.select(*tiles.columns, F.col("p_roi_idx").alias("roi_idx"), F.col("p_name").alias("class"), "clip_area", *(["clip"] if geometry else []))


def tile_records(joined: DataFrame, tile_columns: list[str]) -> DataFrame:
    """One row per tile with ``rois``: array<struct<roi_idx, class, clip_area>> by roi_idx."""
    return joined.groupBy(*tile_columns).agg(F.array_sort(F.collect_list(F.struct("roi_idx", "class", "clip_area"))).alias("rois"))


def empty_records(tiles: DataFrame) -> DataFrame:
    """Every tile as a negative example: no regions, class ``empty``."""
    return tiles.withColumn("rois", F.expr("cast(array() as array<struct<roi_idx:bigint,class:string,clip_area:double>>)")).withColumn("classes", F.array(F.lit("empty")))


def patch_sets(tiles: DataFrame) -> DataFrame:
    """How many tiles there are of each shape: (h, w, n)."""
    return tiles.groupBy((F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w")).agg(F.count("*").alias("n"))


def full_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Tiles that the image's edge does not cut."""
    return tiles.where((F.col("x1") - F.col("x0") == size) & (F.col("y1") - F.col("y0") == size))
