"""TIFF images of one or more levels as rows of chunks, and tiles as TIFF files named by their content."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import CHUNKS

# Fixed values of the format: tags, sizes and codes of its types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SUB_LEVELS, SAMPLE_FORMAT, PREDICTOR = 322, 323, 324, 325, 330, 339, 317
TYPES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000
KINDS = {1: "u", 2: "i", 3: "f"}


def directories(read: Callable[[int, int], bytes]) -> list[dict[int, list[int]]]:
    """The tags of each directory of a file that is read by (place, size), in file order, its sub-levels after it; TIFF and BigTIFF, either byte order."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    size = struct.calcsize("=" + word)
    out, todo = [], list(struct.unpack_from(order + word, head, 8 if big else 4))
    seen = set()
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        first = at + struct.calcsize("=" + count)
        n = struct.unpack(order + count, read(at, first - at))[0]
        raw = read(first, n * entry + size)
        tags = {0: [0 if order == "<" else 1]}
        for k in range(n):
            tag, kind, many = struct.unpack_from(order + "HH" + word, raw, k * entry)
            if kind in TYPES:
                code = f"{order}{many}{TYPES[kind]}"
                own, need = raw[k * entry + 4 + size : (k + 1) * entry], struct.calcsize(code)
                tags[tag] = list(struct.unpack(code, own[:need] if need <= size else read(struct.unpack(order + word, own)[0], need)))
        out.append(tags)
        todo = tags.get(SUB_LEVELS, []) + todo + list(struct.unpack_from(order + word, raw, n * entry))
    return out


def levels(raw: bytes) -> list[dict[int, list[int]]]:
    """The tags of each level of a whole file, in file order, a level's sub-levels after it."""
    return directories(lambda at, size: raw[at : at + size])


def unpacked(data: bytes, compression: int) -> bytes:
    """The bytes of a strip or tile."""
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if compression not in (PLAIN, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"unsupported TIFF compression: {compression}")
    return data if compression == PLAIN else zlib.decompress(data)


def blocks(raw: bytes, tags: dict[int, list[int]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(channel, y, x, pixels) of each strip or tile of a level; pixels are (channels, height, width), cut to the image."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    height, width, samples = one(HEIGHT, 0), one(WIDTH, 0), one(SAMPLES, 1)
    dtype = np.dtype(f"{'<' if tags[0] == [0] else '>'}{KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
    tiled = TILES in tags
    h, w = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    across, down = -(-width // w), -(-height // h)
    apart = one(PLANAR, 1) == 2
    for k, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
        plane, place = divmod(k, across * down) if apart else (0, k)
        y, x = place // across * h, place % across * w
        own = np.frombuffer(unpacked(raw[at : at + size], one(COMPRESSION, PLAIN)), dtype).reshape(-1, w, 1 if apart else samples)
        own = (np.cumsum(own, axis=1, dtype=dtype) if one(PREDICTOR, 1) == 2 else own)[: height - y, : width - x]
        yield plane, y, x, np.moveaxis(own, 2, 0).astype(dtype.newbyteorder("="))


def encode(pixels: np.ndarray) -> bytes:
    """A TIFF file of (channels, height, width), one deflated strip a channel."""
    channels, height, width = pixels.shape
    strips = [zlib.compress(np.ascontiguousarray(p).tobytes()) for p in pixels]
    kind = {v: k for k, v in KINDS.items()}[pixels.dtype.kind]
    starts = np.cumsum([8, *map(len, strips)]).tolist()
    values = {
        WIDTH: [width], HEIGHT: [height], BITS: [8 * pixels.dtype.itemsize] * channels, COMPRESSION: [DEFLATE], PHOTOMETRIC: [1], STRIPS: starts[:-1],
        SAMPLES: [channels], ROWS: [height], STRIP_BYTES: list(map(len, strips)), PLANAR: [2], SAMPLE_FORMAT: [kind] * channels,
    }
    at = starts[-1]
    tail, entries = b"", []
    for tag, value in sorted(values.items()):
        packed = struct.pack(f"<{len(value)}I", *value)
        if len(packed) > 4:
            entries.append(struct.pack("<HHII", tag, 4, len(value), at + len(tail)))
            tail += packed
        else:
            entries.append(struct.pack("<HHI", tag, 4, len(value)) + packed)
    directory = struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at + len(tail)) + b"".join(strips) + tail + directory


def tiff_chunks(spark: SparkSession, path: str, level: int = 0, channels: list[int] | None = None) -> DataFrame:
    """The strips or tiles of one level of TIFF files, decoded, as rows of chunks; ``image_id`` is the file's stem.

    Plain, deflated and Zstandard pixels are read. Each file is one value, so it must be
    under 2 GB; larger slides are read by ``slides.slide_chunks``. Files without that level, or of
    another compression, raise an error. With ``channels``, these alone are kept
    and renumbered in their order.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.ome)?\.[^./]+$", 1).alias("image_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["image_id"], batch["content"]):
                for plane, y, x, own in blocks(raw, levels(raw)[level]):
                    parts = [(plane, own)] if channels is None else [(to, own[c - plane : c - plane + 1]) for to, c in enumerate(channels) if 0 <= c - plane < len(own)]
                    yield pd.DataFrame([(name, level, c, y, x, *p.shape, p.dtype.name, np.ascontiguousarray(p).tobytes()) for c, p in parts], columns=["image_id", "level", "c0", "y0", "x0", "channels", "h", "w", "dtype", "data"])

    return files.mapInPandas(run, CHUNKS)


def tile_files(tiles: DataFrame, channels: int = 1, dtype: str = "uint8") -> DataFrame:
    """Tiles (image_id, x0, y0, x1, y1, data) as TIFF files: (image_id, x0, y0, x1, y1, name, content); ``name`` is the MD5 of the content."""
    kept = ["image_id", "x0", "y0", "x1", "y1"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [encode(np.frombuffer(t.data, dtype).reshape(channels, t.y1 - t.y0, t.x1 - t.x0)) for t in batch.itertuples(index=False)]
            yield batch[kept].assign(name=[hashlib.md5(m).hexdigest() + ".tif" for m in made], content=made)

    return tiles.select(*kept, "data").mapInPandas(run, tiles.select(*kept).schema.add("name", "string").add("content", "binary"))


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) as files of a folder that all executors mount; those that are there are left alone.

    Each is written under another name and then renamed, so a task that is lost
    leaves no half file, and one that runs twice changes nothing.
    """

    def run(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = os.path.join(folder, row["name"])
            if not os.path.exists(target):
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as file:
                    file.write(row["content"])
                os.replace(part, target)

    files.select("name", "content").foreachPartition(run)
