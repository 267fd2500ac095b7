"""Pixels: run-length masks, zonal statistics, thumbnails, levels, and hooks for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import polygon

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")]))


@F.arrow_udf(RUNS)
def fill_ring(ring: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Runs of the pixels that a ring holds in an image; a null ring has none. All rings of a batch are filled at once."""
    size = pc.list_value_length(ring).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (ring.flatten().field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    of, *runs = polygon.fill_many(x, y, size, *(v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (width, height)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in runs], ["y", "x0", "x1"]))


#: Pixel rows of an image that are painted together.
PAINTED = 16


def semantic_runs(runs: DataFrame, keys: list[str], cls: str = "class", order: str = "roi_idx") -> DataFrame:
    """(keys.., y, x0, x1, class) of a mask painted in ``order``: disjoint runs, a later region covering an earlier one.

    ``runs`` has one row per region with ``runs``. Each row of pixels is cut at
    the ends of its runs, and runs are painted over its parts in their order, so
    nothing is multiplied out. A task holds the runs of ``PAINTED`` rows of an image.
    """
    flat = runs.select(*keys, cls, order, F.explode("runs").alias("r")).select(*keys, F.col("r.y").alias("y"), F.col("r.x0").alias("x0"), F.col("r.x1").alias("x1"), cls, order).where("x1 > x0")
    names = [*keys, "y", "x0", "x1", "class"]

    def paint(band: pa.Table) -> pa.Table:
        y, x0, x1 = (band.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        low, left = y.min(), x0.min()
        # the rows of a band one after the other in one line
        wide = x1.max() - left + 1
        start = (y - low) * wide + x0 - left
        cuts = np.unique(np.concatenate([start, start + x1 - x0]))
        turn = pc.array_sort_indices(band.column(order).combine_chunks(), null_placement="at_start").to_numpy()
        a, b = np.searchsorted(cuts, start)[turn], np.searchsorted(cuts, start + x1 - x0)[turn]
        top = np.full(len(cuts), -1)
        for k, i, j in zip(turn.tolist(), a.tolist(), b.tolist()):
            top[i:j] = k
        some = np.flatnonzero(top >= 0)
        own, at = pa.array(top[some]), cuts[some]
        place = [at // wide + low, at % wide + left, at % wide + left + cuts[some + 1] - at]
        return pa.Table.from_arrays([*[band.column(k).take(own) for k in keys], *[pa.array(p, pa.int32()) for p in place], band.column(cls).take(own)], names=names)

    kinds = [runs.schema[c].dataType.simpleString() for c in keys] + ["int"] * 3 + [runs.schema[cls].dataType.simpleString()]
    banded = flat.withColumn("__band", F.floor(F.col("y") / PAINTED))
    return banded.groupBy(*keys, "__band").applyInArrow(paint, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def semantic_pixels(runs: DataFrame, keys: list[str], cls: str = "class", order: str = "roi_idx") -> DataFrame:
    """(keys.., y, x, class): the pixels of :func:`semantic_runs`, for masks that are small enough to be spelled out."""
    return semantic_runs(runs, keys, cls, order).select(*keys, "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"), "class")


#: Pixel rows a band of an image holds, by which runs and tiles meet.
BAND = 256


def mask_counts(runs: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of a 0/1 mask in each tile, where runs of a row do not overlap: tile columns and ``pixels``.

    Tiles are dealt to the bands of rows they cover and runs to the band they
    are in, so a run meets the tiles of its band alone; shares are added up over
    bands. Tiles that nothing meets have 0.
    """
    names = [f"m_{k}" for k in keys]
    flat = runs.select(*[F.col(k).alias(m) for k, m in zip(keys, names)], F.explode("runs").alias("r")).select(*names, F.floor(F.col("r.y") / BAND).alias("m_band"), F.col("r.y").alias("y"), F.col("r.x0").alias("rx0"), F.col("r.x1").alias("rx1"))
    banded = tiles.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / BAND), F.floor((F.col("y1") - 1) / BAND))))
    on = (F.col("band") == F.col("m_band")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("rx0") < F.col("x1")) & (F.col("rx1") > F.col("x0"))
    for k, m in zip(keys, names):
        on = on & (F.col(k) == F.col(m))
    # least and greatest pass over nulls, so bands that nothing meets are told apart
    shared = F.when(F.col("rx0").isNotNull(), F.greatest(F.least("rx1", "x1") - F.greatest("rx0", "x0"), F.lit(0)))
    return banded.join(flat, on, "left").groupBy(*tiles.columns).agg(F.coalesce(F.sum(shared), F.lit(0)).alias("pixels"))


def tile_mask(regions: DataFrame, tiles: DataFrame, keys: list[str], least_share: float = 0.0) -> DataFrame:
    """Pixels of the union of regions (keys.., runs) in each tile: tile columns and ``pixels``, tiles of at least ``least_share`` of their own pixels.

    Overlapping regions count once.
    """
    flat = regions.select(*keys, F.explode("runs").alias("r")).select(*keys, F.col("r.y").alias("y"), F.col("r.x0").alias("x0"), F.col("r.x1").alias("x1"))
    mask = merge_runs(flat, keys).select(*keys, F.array(F.struct("y", "x0", "x1")).alias("runs"))
    counted = mask_counts(mask, tiles, keys)
    return counted.where(F.col("pixels") >= least_share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint runs (keys.., y, x0, x1) that cover what overlapping runs cover."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("new", F.when(F.col("x0") > F.coalesce(reach, F.lit(-(1 << 31))), 1).otherwise(0))
    island = fresh.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "y", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("g")


def pixels_of(df: DataFrame, keys: list[str], values: str, width: int) -> DataFrame:
    """(keys.., y, x, v) of a flat array of pixels."""
    return df.select(*keys, F.posexplode(values).alias("k", "v")).select(*keys, F.floor(F.col("k") / width).cast("int").alias("y"), (F.col("k") % width).cast("int").alias("x"), "v")


def rle(pixels: DataFrame, keys: list[str], width: int, set_: Column) -> DataFrame:
    """Runs of equal mask values in row order, as (keys.., run, start, length, bit).

    Runs are found within each row of pixels, and numbered within each band of
    ``BAND`` rows; a row for each band then says whether its first run goes on
    from the band before and how many runs come before it. So a task orders the
    runs of a band, or the bands of an image, and never an image's runs.
    """
    at = pixels.select(*keys, "y", "x", set_.cast("int").alias("bit"))
    line = Window.partitionBy(*keys, "y").orderBy("x")
    begins = (F.col("bit") != F.lag("bit").over(line)) | (F.lag("x").over(line).isNull())
    inside = at.withColumn("r", F.sum(F.when(begins, 1).otherwise(0)).over(line))
    short = inside.groupBy(*keys, "y", "r", "bit").agg((F.col("y") * width + F.min("x")).alias("start"), F.count("*").alias("length"))
    band = Window.partitionBy(*keys, "band").orderBy("start")
    new = F.when(F.col("bit") != F.lag("bit").over(band), 1).otherwise(0)
    runs = short.withColumn("band", F.floor(F.col("y") / BAND)).withColumn("new", new).withColumn("own", F.sum("new").over(band))
    ends = runs.groupBy(*keys, "band").agg(F.min_by("bit", "start").alias("first"), F.max_by("bit", "start").alias("last"), F.sum("new").alias("news"))
    image = Window.partitionBy(*keys).orderBy("band")
    joint = F.when(F.col("first") != F.lag("last").over(image), 1).otherwise(0)
    before = ends.withColumn("joint", joint).withColumn("before", F.sum(F.col("joint") + F.col("news")).over(image) - F.col("news"))
    names = [f"b_{k}" for k in keys]
    before = before.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("band").alias("b_band"), "before")
    same = F.col("band") == F.col("b_band")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    numbered = runs.join(before, same).withColumn("run", F.col("own") + F.col("before"))
    return numbered.groupBy(*keys, "run", "bit").agg(F.min("start").alias("start"), F.sum("length").alias("length"))


def zonal_stats(pixels: DataFrame, zones: DataFrame, keys: list[str], cell: int = 256) -> DataFrame:
    """Mean, maximum and minimum of the pixels in each box zone: zone columns, mean, max, min.

    Zones are dealt to the cells of a grid they cover and pixels to their own, so
    a pixel meets the zones of its cell alone.
    """
    last = lambda c: F.floor((F.col(c) - 1) / cell)
    dealt = zones.withColumn("__cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), last("x1")))).withColumn("__cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), last("y1"))))
    placed = pixels.withColumns({"__cx": F.floor(F.col("x") / cell), "__cy": F.floor(F.col("y") / cell)})
    joined = dealt.join(placed, [*keys, "__cx", "__cy"]).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return joined.groupBy(*zones.columns).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))


def coarsen(pixels: DataFrame, keys: list[str], width: int, height: int, factor: int) -> DataFrame:
    """Means over ``factor`` by ``factor`` blocks; rows and columns past the last whole block are left out."""
    whole = pixels.where((F.col("x") < width // factor * factor) & (F.col("y") < height // factor * factor))
    return whole.groupBy(*keys, F.floor(F.col("y") / factor).cast("int").alias("ty"), F.floor(F.col("x") / factor).cast("int").alias("tx")).agg(F.avg("v").alias("mean"))


def thumbnail(pixels: DataFrame, keys: list[str], width: int, height: int, factor: int = 16) -> DataFrame:
    """Means over ``factor`` by ``factor`` blocks of 16-bit pixels, brought to 8 bits: (keys.., ty, tx, v)."""
    return coarsen(pixels, keys, width, height, factor).select(*keys, "ty", "tx", F.floor(F.col("mean") / 256).cast("int").alias("v"))


def normalize(pixels: DataFrame, top: float = 255.0) -> DataFrame:
    """Pixel values ``v`` brought to 0 to 1 as doubles."""
    return pixels.withColumn("v", F.col("v").cast("double") / top)


def project_channels(chunks: DataFrame, channels: list[int]) -> DataFrame:
    """The chosen channels of pixel chunks (``c0``, ``channels``, ``h``, ``w``, ``dtype``, ``data``), each as a chunk whose ``c0`` is its place in the list.

    Bytes are cut in the JVM; a channel that a chunk lacks gives no row.
    """
    size = F.expr("h * w * cast(case dtype when 'uint8' then 1 when 'int8' then 1 when 'uint16' then 2 when 'int16' then 2 when 'float32' then 4 when 'uint32' then 4 when 'int32' then 4 else 8 end as int)")
    each = chunks.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(i).alias("to"), F.lit(c).alias("at")) for i, c in enumerate(channels)])))
    at = F.col("__c.at") - F.col("c0")
    cut = each.where((at >= 0) & (at < F.col("channels"))).withColumn("data", F.substring("data", (at * size + 1).cast("int"), size))
    return cut.withColumns({"c0": F.col("__c.to"), "channels": F.lit(1)}).drop("__c")


def _mapped_tiles(tiles: DataFrame, channels: int, dtype: str, made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles (.., x0, y0, x1, y1, data) with ``data`` replaced by what ``made`` gives of (channels, height, width), and ``h`` and ``w``."""
    kept = [c for c in tiles.columns if c not in ("data", "h", "w")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [made(np.frombuffer(t.data, dtype).reshape(channels, t.y1 - t.y0, t.x1 - t.x0)) for t in batch.itertuples(index=False)]
            yield batch[kept].assign(data=[np.ascontiguousarray(d).tobytes() for d in done], h=[d.shape[1] for d in done], w=[d.shape[2] for d in done])

    schema = tiles.select(*kept, "data").schema.add("h", T.IntegerType()).add("w", T.IntegerType())
    return tiles.select(*kept, "data").mapInPandas(run, schema)


def pad_square(tiles: DataFrame, size: int, channels: int = 1, dtype: str = "uint8") -> DataFrame:
    """Tiles filled up with zeros at their right and lower sides to ``size`` by ``size``; larger ones raise an error."""

    def padded(pixels: np.ndarray) -> np.ndarray:
        _, h, w = pixels.shape
        if max(h, w) > size:
            raise ValueError(f"a tile of {h} by {w} does not fit {size}")
        return np.pad(pixels, ((0, 0), (0, size - h), (0, size - w)))

    return _mapped_tiles(tiles, channels, dtype, padded)


def resize(tiles: DataFrame, size: int = 224, channels: int = 1, dtype: str = "uint8") -> DataFrame:
    """Tiles brought to ``size`` by ``size`` by the nearest pixel, as a patch classifier takes them."""

    def sized(pixels: np.ndarray) -> np.ndarray:
        ys, xs = ((np.arange(size) + 0.5) * n // size for n in pixels.shape[1:])
        return pixels[:, ys.astype(int)][:, :, xs.astype(int)]

    return _mapped_tiles(tiles, channels, dtype, sized)


def select_level(levels: DataFrame, wanted: int) -> DataFrame:
    """(image_id, level): the level asked for where sizes strictly fall; else that of the n-th largest array."""
    w = Window.partitionBy("image_id").orderBy("level")
    marked = levels.withColumn("falls", F.coalesce(F.col("size") < F.lag("size").over(w), F.lit(True)))
    ranked = marked.withColumn("pyramid", F.min("falls").over(Window.partitionBy("image_id"))).withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("size"), "level")) - 1)
    picked = F.when(F.col("pyramid"), F.col("level") == wanted).otherwise(F.col("k") == wanted)
    return ranked.where(picked).select("image_id", "level")


def softmax_mask(pixels: DataFrame, logit0: Column, logit1: Column, threshold: float) -> DataFrame:
    """Pixels whose second class has a softmax probability of at least ``threshold``, with ``p``."""
    return pixels.withColumn("p", 1 / (1 + F.exp(logit0 - logit1))).where(F.col("p") >= threshold)


Model = Callable[[np.ndarray], list[tuple[int, float, np.ndarray]]]


def predict(tiles: DataFrame, model: Model, channels: int = 1, tolerance: float = 0.001, least_points: int = 15) -> DataFrame:
    """Detections of a model over tiles (image_id, x0, y0, x1, y1, data): (image_id, class_id, score, ring), in slide coordinates.

    ``model`` takes an array (channels, height, width) of a tile's bytes and
    gives (class, score, mask) for each object; outlines of at least
    ``least_points`` points are kept. Tiles stay in the partition they are in;
    tiles whose bytes do not fit their size raise an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                pixels = np.frombuffer(t.data, np.uint8).reshape(channels, t.y1 - t.y0, t.x1 - t.x0)
                for cls, score, mask in model(pixels):
                    for ring in polygon.trace(mask, tolerance, least_points):
                        out.append((t.image_id, int(cls), float(score), [{"x": x + t.x0, "y": y + t.y0} for x, y in ring.tolist()]))
            yield pd.DataFrame(out, columns=["image_id", "class_id", "score", "ring"])

    fields = f"image_id {tiles.schema['image_id'].dataType.simpleString()}, class_id int, score double, ring array<struct<x:double,y:double>>"
    return tiles.select("image_id", "x0", "y0", "x1", "y1", "data").mapInPandas(run, fields)


#: Gives logits (2, height, width), the second for what is looked for, of a tile's pixels.
Segmenter = Callable[[np.ndarray], np.ndarray]


def _likely(tile, model: Segmenter, channels: int, dtype: str) -> np.ndarray:
    """The softmax probability of the second class, (height, width); pixels reach the model as shares of their type's largest value."""
    pixels = np.frombuffer(tile.data, dtype).reshape(channels, tile.y1 - tile.y0, tile.x1 - tile.x0)
    top = np.iinfo(dtype).max if np.dtype(dtype).kind in "ui" else 1.0
    logits = np.asarray(model((pixels / top).astype(np.float32)), float)
    return 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -700, 700)))


def segment(tiles: DataFrame, model: Segmenter, threshold: float = 0.5, channels: int = 1, dtype: str = "uint8", tolerance: float = 0.001, least_points: int = 3) -> DataFrame:
    """Outlines of what a segmenter finds: (image_id, class_id, score, p_max, p_min, ring), in slide coordinates.

    Pixels of at least ``threshold`` are traced; an outline's ``score`` is the
    mean probability of the pixels inside it, with their maximum and minimum, and
    its class 0. Outlines without a pixel inside are left out. Tiles stay in the
    partition they are in, one at a time in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                p = _likely(t, model, channels, dtype)
                for ring in polygon.trace(p >= threshold, tolerance, least_points):
                    inside = [p[y, a:b] for y, a, b in polygon.fill_runs(ring, p.shape[1], p.shape[0])]
                    if inside:
                        own = np.concatenate(inside)
                        out.append((t.image_id, 0, float(own.mean()), float(own.max()), float(own.min()), [{"x": x + t.x0, "y": y + t.y0} for x, y in ring.tolist()]))
            yield pd.DataFrame(out, columns=["image_id", "class_id", "score", "p_max", "p_min", "ring"])

    fields = f"image_id {tiles.schema['image_id'].dataType.simpleString()}, class_id int, score double, p_max double, p_min double, ring array<struct<x:double,y:double>>"
    return tiles.select("image_id", "x0", "y0", "x1", "y1", "data").mapInPandas(run, fields)


def segment_masks(tiles: DataFrame, model: Segmenter, threshold: float = 0.5, channels: int = 1, dtype: str = "uint8") -> DataFrame:
    """The mask of each image instead of outlines: (image_id, y, x0, x1), disjoint runs in slide coordinates; tiles may overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                edges = np.diff(np.pad((_likely(t, model, channels, dtype) >= threshold).astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (y, a), (_, b) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                out.append(pd.DataFrame({"image_id": t.image_id, "y": y + t.y0, "x0": a + t.x0, "x1": b + t.x0}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["image_id", "y", "x0", "x1"])

    fields = f"image_id {tiles.schema['image_id'].dataType.simpleString()}, y long, x0 long, x1 long"
    return merge_runs(tiles.select("image_id", "x0", "y0", "x1", "y1", "data").mapInPandas(run, fields), ["image_id"])


def threshold_model(level: int) -> Model:
    """A model for tests: one object of class 1, all pixels of the first channel at or above ``level``."""

    def run(pixels: np.ndarray) -> list[tuple[int, float, np.ndarray]]:
        mask = pixels[0] >= level
        return [(1, float(pixels[0][mask].mean()) / 255, mask)] if mask.any() else []

    return run


#: Models that may be crossed with detections.
MOST_MODELS = 1000


def model_cross(dets: DataFrame, models: DataFrame) -> DataFrame:
    """Detections above each model's threshold: each detection meets the models it passes.

    Models are few: they are read to the driver, ``MOST_MODELS`` at most, and
    exploded from each detection's row, so no join is needed.
    """
    known = models.limit(MOST_MODELS + 1).collect()
    if len(known) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    names = [c for c in models.columns if c not in dets.columns]
    if not known:
        return dets.withColumns({c: F.lit(None).cast(models.schema[c].dataType) for c in names}).where("false")
    rows = F.array(*[F.struct(*[F.lit(m[c]).cast(models.schema[c].dataType).alias(c) for c in names]) for m in known])
    passed = F.filter(rows, lambda m: F.col("score") > m["threshold"])
    return dets.withColumn("__m", F.explode(passed)).select(*dets.columns, *[F.col(f"__m.{c}").alias(c) for c in names])


def tile_apply(tiles: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``func`` over batches of tiles."""
    return tiles.mapInPandas(lambda batches: (func(b) for b in batches), schema)
