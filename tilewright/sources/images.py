"""Slide images as rows of chunks: Zarr arrays and pyramids read as files, and image rows without pixels."""

from __future__ import annotations

import gzip
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "image_id string, path string, level int, channels int, height long, width long, dtype string"
CHUNKS = "image_id string, level int, c0 int, y0 long, x0 long, channels int, h int, w int, dtype string, data binary"


def placeholder(spark: SparkSession, image_id: str, size: int = 1 << 18, channels: int = 3) -> DataFrame:
    """An image row without pixels, so that a slide can be tiled without its file."""
    return spark.createDataFrame([(image_id, None, 0, channels, size, size, "uint8")], IMAGES)


def _three(values: list[int], fill: int) -> list[int]:
    """Channels, height and width of a squeezed shape; two dimensions get one channel."""
    return [fill, fill, fill, *values][-3:]


def zarr_images(spark: SparkSession, path: str, image_id: str) -> DataFrame:
    """One row for each array of a Zarr (version 3) group, or for a lone array, from its metadata files.

    The level is the array's name where that is a number, else 0.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "zarr.json").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("meta"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, meta in zip(batch["path"], batch["meta"]):
                m = json.loads(meta)
                if m["node_type"] == "array":
                    name = p.rsplit("/", 2)[1]
                    out.append((image_id, p.rsplit("/", 1)[0], int(name) if name.isdigit() else 0, *_three(m["shape"], 1), m["data_type"]))
            yield pd.DataFrame(out, columns=["image_id", "path", "level", "channels", "height", "width", "dtype"])

    return rows.mapInPandas(parse, IMAGES)


def zarr_chunks(spark: SparkSession, path: str, image_id: str, level: int = 0) -> DataFrame:
    """The written chunks of one Zarr (version 3) array, decoded: little-endian bytes, plain or gzip, in row order.

    Each chunk file is a row, so Spark reads them in parallel and a predicate on
    y0 or x0 can follow; chunks that were never written have no row.
    """
    meta = json.loads(spark.read.text(f"{path}/zarr.json", wholetext=True).first()[0])
    codecs = [c["name"] for c in meta["codecs"]]
    if codecs not in (["bytes"], ["bytes", "gzip"]):
        raise ValueError(f"unsupported Zarr codecs: {codecs}")
    return _chunk_files(spark, path, image_id, level, meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(meta["data_type"]), gzip.decompress if codecs[-1] == "gzip" else bytes)


def zarr2_chunks(spark: SparkSession, path: str, image_id: str, meta: dict | None = None, level: int = 0) -> DataFrame:
    """The same of a Zarr array of version 2, plain, zlib or gzip, in C order.

    Its metadata, ``.zarray``, is a hidden file, which Spark does not read: pass
    its content as ``meta``, or a path that the driver can open.
    """
    if meta is None:
        with open(os.path.join(path.removeprefix("file://"), ".zarray")) as file:
            meta = json.load(file)
    name = (meta["compressor"] or {"id": None})["id"]
    packed = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}
    if name not in packed or meta.get("filters") or meta.get("order", "C") != "C":
        raise ValueError(f"unsupported Zarr array: {meta}")
    return _chunk_files(spark, path, image_id, level, meta["shape"], meta["chunks"], np.dtype(meta["dtype"]), packed[name])


def _chunk_files(spark: SparkSession, path: str, image_id: str, level: int, shape: list[int], chunk: list[int], dtype: np.dtype, unpack: Callable[[bytes], bytes]) -> DataFrame:
    depth = len(shape)
    shape, chunk = _three(shape, 1), _three(chunk, 1)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, raw in zip(batch["path"], batch["content"]):
                at = _three([int(k) for k in re.split(r"[/.]", p)[-depth:]], 0)
                block = np.frombuffer(unpack(raw), dtype).reshape(chunk).astype(dtype.newbyteorder("="))
                start = [i * n for i, n in zip(at, chunk)]
                block = block[tuple(slice(0, min(n, s - o)) for n, s, o in zip(chunk, shape, start))]
                out.append((image_id, level, *start, *block.shape, dtype.name, np.ascontiguousarray(block).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "level", "c0", "y0", "x0", "channels", "h", "w", "dtype", "data"])

    return files.mapInPandas(decode, CHUNKS)


def shrink(chunks: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th pixel of rows and columns, the middle one of its cell, at places divided by the factor; chunk by chunk.

    A last cell that is not whole gives no pixel if its middle is outside; chunks without a middle have no row.
    """
    if factor == 1:
        return chunks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                block = np.frombuffer(r.data, r.dtype).reshape(r.channels, r.h, r.w)
                fy, fx = (-(v - factor // 2) % factor for v in (r.y0, r.x0))
                own = np.ascontiguousarray(block[:, fy::factor, fx::factor])
                if own.size:
                    out.append((r.image_id, r.level, r.c0, (r.y0 + fy) // factor, (r.x0 + fx) // factor, *own.shape, r.dtype, own.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "level", "c0", "y0", "x0", "channels", "h", "w", "dtype", "data"])

    return chunks.mapInPandas(run, CHUNKS)


def parts_of(chunks: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """``tiles`` (image_id, x0, y0, x1, y1, ..) with a row for each chunk of ``size`` that a tile meets, in ``part``; null where there is none."""
    need = tiles.withColumn("gx", F.explode(F.expr(f"sequence(x0 div {size}, (x1 - 1) div {size})"))).withColumn("gy", F.explode(F.expr(f"sequence(y0 div {size}, (y1 - 1) div {size})")))
    c = chunks.select("image_id", (F.col("x0") / size).cast("long").alias("gx"), (F.col("y0") / size).cast("long").alias("gy"), F.struct(F.col("c0").alias("c"), F.col("y0").alias("y"), F.col("x0").alias("x"), "channels", "h", "w", "dtype", "data").alias("part"))
    return need.join(c, ["image_id", "gx", "gy"], "left").select(*tiles.columns, "part")


def pasted(rows: pd.Series, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """The pixels of a tile, (channels, height, width), from its parts; what no part covers is 0."""
    # whole numbers of a column with nulls come as floats
    parts = [{k: p[k] if k in ("dtype", "data") else int(p[k]) for k in ("c", "y", "x", "channels", "h", "w", "dtype", "data")} for p in rows if p is not None and p["data"] is not None]
    depth = max((p["c"] + p["channels"] for p in parts), default=1)
    out = np.zeros((depth, y1 - y0, x1 - x0), np.dtype(parts[0]["dtype"]) if parts else np.dtype("uint8"))
    for p in parts:
        block = np.frombuffer(p["data"], out.dtype).reshape(p["channels"], p["h"], p["w"])
        ys, xs = (max(p["y"], y0), min(p["y"] + p["h"], y1)), (max(p["x"], x0), min(p["x"] + p["w"], x1))
        if ys[0] < ys[1] and xs[0] < xs[1]:
            out[p["c"] : p["c"] + p["channels"], ys[0] - y0 : ys[1] - y0, xs[0] - x0 : xs[1] - x0] = block[:, ys[0] - p["y"] : ys[1] - p["y"], xs[0] - p["x"] : xs[1] - p["x"]]
    return out


def crop(chunks: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Pixels of tiles (image_id, x0, y0, x1, y1) cut out of chunks of ``size``: adds ``data``, channels by height by width.

    Tiles and chunks meet by an equi-join on the image and the chunk's grid
    place; the parts of a tile are put together by tile. Missing chunks are 0.
    """
    joined = parts_of(chunks, tiles.select("image_id", "x0", "y0", "x1", "y1"), size)

    def paste(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [int(rows[k].iloc[0]) for k in ("x0", "y0", "x1", "y1")]
        return pd.DataFrame([(rows["image_id"].iloc[0], *sides, pasted(rows["part"], *sides).tobytes())], columns=["image_id", "x0", "y0", "x1", "y1", "data"])

    kind = tiles.schema["image_id"].dataType.simpleString()
    return joined.groupBy("image_id", "x0", "y0", "x1", "y1").applyInPandas(paste, f"image_id {kind}, x0 long, y0 long, x1 long, y1 long, data binary")
