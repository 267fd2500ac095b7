"""Training records with pixels: a tile's image, instance masks and boxes together, moved alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygon
from ..sources.images import crop, parts_of, pasted
from .dataset import MOVES

TILE = ["image_id", "x0", "y0", "x1", "y1"]
RECORD = (
    "x0 long, y0 long, x1 long, y1 long, move int, channels int, h int, w int, image binary, "
    "boxes array<array<double>>, labels array<int>, areas array<double>, iscrowd array<int>, rings array<array<double>>, masks array<array<struct<y:int,x0:int,x1:int>>>"
)


def moved_pixels(pixels: np.ndarray, move: tuple[int, bool]) -> np.ndarray:
    """Pixels (channels, height, width) mirrored left to right, if so said, and then turned; the same as ``augment_ring`` does to points."""
    turns, mirror = move
    return np.rot90(pixels[:, :, ::-1] if mirror else pixels, turns, (1, 2))


def moved_ring(ring: np.ndarray, move: tuple[int, bool], size: int) -> np.ndarray:
    """Points of a square tile after the same move."""
    turns, mirror = move
    if mirror:
        ring = np.stack([size - ring[:, 0], ring[:, 1]], axis=1)
    for _ in range(turns):
        ring = np.stack([ring[:, 1], size - ring[:, 0]], axis=1)
    return ring


def with_moves(tiles: DataFrame, seed: str = "") -> DataFrame:
    """``tiles`` with ``move``, a place in ``MOVES``, drawn by a hash of the tile and the seed: one seed for each pass over the data."""
    return tiles.withColumn("move", F.pmod(F.xxhash64(*TILE, F.lit(seed)), F.lit(len(MOVES))).cast("int"))


def patches(tiles: DataFrame, chunks: DataFrame, chunk_size: int, name: str = "name", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each tile as a patch with its pixels: (image_id, x0, y0, x1, y1, name, data), (channels, height, width); tiles of the excluded names are left out."""
    own = tiles.where(~F.coalesce(F.col(name).isin(list(exclude)), F.lit(False))) if exclude else tiles
    cut = crop(chunks, own, chunk_size)
    named = own.select(*[F.col(c).alias(f"tile_{c}") for c in TILE], F.col(name).alias("name"))
    return cut.join(named, [F.col(c) == F.col(f"tile_{c}") for c in TILE]).select(*TILE, "name", "data")


def training_arrays(tiles: DataFrame, chunks: DataFrame, rois: DataFrame, chunk_size: int, top: float = 255.0, keep_empty: bool = True) -> DataFrame:
    """One record a tile: its pixels as float32, and the boxes, labels, areas, rings and masks of its regions, in the order of ``roi_idx``.

    ``tiles`` are (image_id, x0, y0, x1, y1), with ``move`` (a place in ``MOVES``,
    null for none) where pixels and rings are to be moved; such tiles must be
    square, and their rings are first clamped to [1, side - 1]. ``chunks`` are
    pixel chunks on a grid of ``chunk_size``; ``rois`` are (the tile's columns,
    roi_idx, label, ring) in the slide's coordinates, as a join of tiles and
    regions gives them. Pixels are divided by the largest value of their type and
    multiplied by ``top``; ``image`` is (channels, h, w), little-endian.

    A mask is its runs (y, x0, x1); a region without a pixel is left out, and a
    tile without regions too unless ``keep_empty``. Chunks and regions meet by
    tile in one cogroup, so a task holds one tile at a time.
    """
    own = tiles.select(*TILE, F.col("move").cast("int").alias("move") if "move" in tiles.columns else F.lit(None).cast("int").alias("move"))
    # names of their own: both sides may come from one table
    theirs = [f"roi_{c}" for c in TILE]
    near = rois.select(*[F.col(c).alias(t) for c, t in zip(TILE, theirs)], "roi_idx", F.col("label").cast("int").alias("label"), F.transform("ring", lambda p: p["x"].cast("double")).alias("xs"), F.transform("ring", lambda p: p["y"].cast("double")).alias("ys"))

    def run(parts: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        names = [*TILE, *[f.split()[0] for f in ("move", "channels", "h", "w", "image", "boxes", "labels", "areas", "iscrowd", "rings", "masks")]]
        if not len(parts):
            return pd.DataFrame(columns=names)
        x0, y0, x1, y1 = sides = [int(parts[k].iloc[0]) for k in TILE[1:]]
        drawn = parts["move"].iloc[0]
        move = None if drawn is None or pd.isna(drawn) else MOVES[int(drawn)]
        pixels = pasted(parts["part"], *sides)
        if move is not None:
            if x1 - x0 != y1 - y0:
                raise ValueError("only square tiles are moved")
            pixels = moved_pixels(pixels, move)
        scale = np.iinfo(pixels.dtype).max if pixels.dtype.kind in "ui" else 1.0
        image = np.ascontiguousarray(pixels / scale * top, dtype="<f4")
        _, h, w = image.shape
        boxes, labels, areas, rings, masks = [], [], [], [], []
        for r in regions.sort_values("roi_idx").itertuples(index=False):
            ring = np.stack([np.asarray(r.xs, float) - x0, np.asarray(r.ys, float) - y0], axis=1)
            if move is not None:
                ring = moved_ring(np.clip(ring, 1, w - 1), move, w)
            runs = polygon.fill_runs(polygon.as_ring(ring), w, h)
            if runs:
                (a, b), (c, d) = ring.min(0), ring.max(0)
                boxes.append([a, b, c, d])
                labels.append(int(r.label))
                areas.append((c - a) * (d - b))
                rings.append(ring.ravel().tolist())
                masks.append([{"y": y, "x0": p, "x1": q} for y, p, q in runs])
        if not boxes and not keep_empty:
            return pd.DataFrame(columns=names)
        return pd.DataFrame([(parts["image_id"].iloc[0], *sides, drawn, *image.shape, image.tobytes(), boxes, labels, areas, [0] * len(boxes), rings, masks)], columns=names)

    kind = tiles.schema["image_id"].dataType.simpleString()
    pieces = parts_of(chunks, own, chunk_size).select(*TILE, "move", "part")
    return pieces.groupBy(*TILE).cogroup(near.groupBy(*theirs)).applyInPandas(run, f"image_id {kind}, {RECORD}")
