"""A Spark data source for slides: TIFF, CZI and Zarr, read by ranges of bytes, so that a task decodes only blocks that are asked for."""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import tiff
from .images import CHUNKS

Read = Callable[[int, int], bytes]
#: Bytes of a file that are one task's work.
SPLIT_BYTES = 64 << 20
NAMES = ["image_id", "level", "c0", "y0", "x0", "channels", "h", "w", "dtype", "data"]


@dataclass(frozen=True)
class Block:
    """Where a block of pixels lies in the image and in the file, and how it is turned into (channels, height, width)."""

    level: int
    c0: int
    y0: int
    x0: int
    channels: int
    h: int
    w: int
    at: int
    size: int
    dtype: str
    decode: tuple

    def meets(self, bounds: tuple[int, int, int, int] | None) -> bool:
        return bounds is None or (self.x0 < bounds[2] and self.x0 + self.w > bounds[0] and self.y0 < bounds[3] and self.y0 + self.h > bounds[1])


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


# --- TIFF


def tiff_blocks(read: Read) -> list[Block]:
    """Every strip or tile of a TIFF file. Pages of one size are the channels of a level; sizes, in order of appearance, are the levels."""
    pages: dict[tuple[int, int], list[dict]] = {}
    for tags in tiff.directories(read):
        pages.setdefault((tags[tiff.HEIGHT][0], tags[tiff.WIDTH][0]), []).append(tags)
    out = []
    for level, (size, own) in enumerate(sorted(pages.items(), key=lambda p: -p[0][0] * p[0][1])):
        first = 0
        for tags in own:
            one = lambda tag, default, tags=tags: tags.get(tag, [default])[0]
            height, width, samples = *size, one(tiff.SAMPLES, 1)
            dtype = f"{'<' if tags[0] == [0] else '>'}{tiff.KINDS[one(tiff.SAMPLE_FORMAT, 1)]}{one(tiff.BITS, 8) // 8}"
            tiled = tiff.TILES in tags
            h, w = (one(tiff.TILE_HEIGHT, 0), one(tiff.TILE_WIDTH, 0)) if tiled else (min(one(tiff.ROWS, height), height), width)
            across, down = -(-width // w), -(-height // h)
            apart = one(tiff.PLANAR, 1) == 2
            for k, (at, size_) in enumerate(zip(tags[tiff.TILES if tiled else tiff.STRIPS], tags[tiff.TILE_BYTES if tiled else tiff.STRIP_BYTES])):
                plane, place = divmod(k, across * down) if apart else (0, k)
                y, x = place // across * h, place % across * w
                depth = 1 if apart else samples
                how = ("tiff", one(tiff.COMPRESSION, 1), one(tiff.PREDICTOR, 1), w, depth, h)
                out.append(Block(level, first + plane, y, x, depth, min(h, height - y), min(w, width - x), at, size_, dtype, how))
            first += samples
    return out


# --- CZI: fixed values of the format

SEGMENT = "<16sqq"
#: Pixel type: (type, samples).
PIXELS = {0: ("<u1", 1), 1: ("<u2", 1), 2: ("<f4", 1), 3: ("<u1", 3), 4: ("<u2", 3), 8: ("<f4", 3), 9: ("<u1", 4), 12: ("<i4", 1), 13: ("<f8", 1)}
CZI_PLAIN, CZI_ZSTD, CZI_ZSTD_PACKED = 0, 5, 6
#: Bytes before a subblock's own metadata, at least: sizes and its directory entry.
SUBBLOCK_HEAD = 256


def _segment(read: Read, at: int, kind: bytes) -> int:
    name, _, used = struct.unpack(SEGMENT, read(at, 32))
    if name.rstrip(b"\0") != kind:
        raise ValueError(f"not a {kind.decode()} segment")
    return used


def czi_blocks(read: Read) -> list[Block]:
    """Every subblock of a CZI file, at its own offset in the mosaic.

    Level k has the blocks stored 2 ** k times smaller; later tiles of a mosaic
    come after, and so above, earlier ones. Only the first of scenes in time and
    depth is read.
    """
    _segment(read, 0, b"ZISRAWFILE")
    directory = struct.unpack("<q", read(32 + 52, 8))[0]
    used = _segment(read, directory, b"ZISRAWDIRECTORY")
    raw = read(directory + 32, used)
    count, at = struct.unpack_from("<i", raw)[0], 128
    found = []
    for _ in range(count):
        schema, pixel, place, _, packing, _, _, dims = struct.unpack_from("<2siqiiB5si", raw, at)
        if schema != b"DV":
            raise ValueError(f"unsupported directory entry: {schema!r}")
        axes = {}
        for d in range(dims):
            name, start, size, _, stored = struct.unpack_from("<4siifi", raw, at + 32 + 20 * d)
            axes[name.rstrip(b"\0").decode()] = (start, size, stored or size)
        at += 32 + 20 * dims
        found.append((pixel, place, packing, 32 + 20 * dims, axes))
    first = {axis: min(e[4][axis][0] for e in found if axis in e[4]) for axis in {a for e in found for a in e[4]}}
    out = []
    for pixel, place, packing, entry, axes in found:
        if any(axes[a][0] != first[a] for a in axes if a not in ("X", "Y", "C", "M", "S")):
            continue
        (x, size_x, w), (y, size_y, h) = axes["X"], axes["Y"]
        level = max(0, round(np.log2(size_x / w)))
        dtype, samples = PIXELS[pixel]
        channel = axes.get("C", (0,))[0] - first.get("C", 0)
        depth = min(samples, 3)
        scale = 2**level
        out.append((axes.get("M", (0,))[0], Block(level, channel * depth, (y - first["Y"]) // scale, (x - first["X"]) // scale, depth, h, w, place, max(0, h * w * samples * np.dtype(dtype).itemsize), dtype, ("czi", packing, samples, entry))))
    return [b for _, b in sorted(out, key=lambda m: (m[1].level, m[1].c0, m[0]))]


def _czi_pixels(read: Read, block: Block) -> bytes:
    _, packing, samples, entry = block.decode
    _segment(read, block.at, b"ZISRAWSUBBLOCK")
    meta, _, size = struct.unpack("<iiq", read(block.at + 32, 16))
    data = read(block.at + 32 + max(SUBBLOCK_HEAD, 16 + entry) + meta, size)
    if packing == CZI_PLAIN:
        return data
    if packing not in (CZI_ZSTD, CZI_ZSTD_PACKED):
        raise ValueError(f"unsupported CZI compression: {packing}")
    import zstandard

    head, split = (data[0], data[0] == 3 and data[2] & 1) if packing == CZI_ZSTD_PACKED else (0, False)
    out = zstandard.ZstdDecompressor().decompress(data[head:], max_output_size=block.size)
    # low bytes of all values, then the high ones
    return np.frombuffer(out, np.uint8).reshape(2, -1).T.tobytes() if split else out


def pixels(read: Read, block: Block) -> np.ndarray:
    """The decoded pixels of a block, (channels, height, width)."""
    dtype = np.dtype(block.dtype)
    if block.decode[0] == "czi":
        own = np.frombuffer(_czi_pixels(read, block), dtype).reshape(block.h, block.w, block.decode[2])
        # colours are stored blue first
        own = own[:, :, 2::-1] if block.decode[2] >= 3 else own
    else:
        _, packing, predictor, w, depth, h = block.decode
        data = tiff.unpacked(read(block.at, block.size), packing)
        own = np.frombuffer(data, dtype)[: len(data) // dtype.itemsize].reshape(-1, w, depth)
        if predictor == 2:
            own = np.cumsum(own, axis=1, dtype=dtype)
        own = own[: block.h, : block.w]
    return np.ascontiguousarray(np.moveaxis(own, 2, 0)).astype(dtype.newbyteorder("="), copy=False)


# --- Zarr


@dataclass(frozen=True)
class ZarrArray:
    """An array of a store and its level."""

    folder: str
    level: int
    shape: tuple[int, int, int]
    chunk: tuple[int, int, int]
    depth: int
    dtype: str
    packing: str | None
    prefix: str
    mark: str

    @property
    def grid(self) -> tuple[int, int, int]:
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunk))

    def key(self, place: tuple[int, int, int]) -> str:
        return f"{self.folder}/{self.prefix}{self.mark.join(map(str, ([0] * (self.depth - 3) + list(place))[-self.depth :]))}"


def _json(fs: pafs.FileSystem, path: str) -> dict | None:
    try:
        with fs.open_input_stream(path) as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


def zarr_arrays(fs: pafs.FileSystem, path: str) -> list[ZarrArray]:
    """The arrays of a Zarr store of version 2 or 3, or the store itself where it is one; more than three axes are squeezed from the front."""
    three = lambda v: tuple([1, 1, 1, *v][-3:])

    def array(folder: str, level: int) -> list[ZarrArray]:
        if (m := _json(fs, f"{folder}/.zarray")) is not None:
            if m.get("filters") or m.get("order", "C") != "C":
                raise ValueError(f"unsupported Zarr array: {folder}")
            return [ZarrArray(folder, level, three(m["shape"]), three(m["chunks"]), len(m["shape"]), m["dtype"], (m["compressor"] or {"id": None})["id"], "", m.get("dimension_separator", "."))]
        m = _json(fs, f"{folder}/zarr.json")
        if m is None or m["node_type"] != "array":
            return []
        codecs = [c["name"] for c in m["codecs"] if c["name"] != "bytes"]
        if len(codecs) > 1:
            raise ValueError(f"unsupported Zarr codecs: {codecs}")
        return [ZarrArray(folder, level, three(m["shape"]), three(m["chunk_grid"]["configuration"]["chunk_shape"]), len(m["shape"]), m["data_type"], codecs[0] if codecs else None, "c/", "/")]

    lone = array(path, 0)
    if lone:
        return lone
    below = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory and f.base_name.isdigit())
    return [a for name in sorted(below, key=int) for a in array(f"{path}/{name}", int(name))]


def _unzarr(data: bytes, packing: str | None) -> bytes:
    if packing == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    unpack = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}.get(packing)
    if unpack is None:
        raise ValueError(f"unsupported Zarr compression: {packing}")
    return unpack(data)


# --- the source


@dataclass
class Range(InputPartition):
    """Blocks of a file that begin between two of its bytes, or chunks of a Zarr array between two numbers."""

    uri: str
    image_id: str
    begin: int
    end: int
    array: ZarrArray | None = None


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0].removesuffix(".ome")


class SlideReader(DataSourceReader):
    """Deals files into ranges of bytes and keeps the filters that spare blocks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"].split(",")
        self.level = None if options.get("level", "0") == "all" else int(options.get("level", "0"))
        self.channels = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None
        self.bounds = tuple(int(v) for v in options["bounds"].split(",")) if options.get("bounds") else None
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.kept: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of single columns spare blocks; Spark applies all filters again."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        self.kept = [(signs[type(f)], f.attribute[0], f.value) for f in filters if type(f) in signs and len(f.attribute) == 1]
        return filters

    def _wanted(self, image_id: str, b: Block) -> bool:
        if self.level is not None and b.level != self.level or not b.meets(self.bounds):
            return False
        if self.channels is not None and not any(0 <= c - b.c0 < b.channels for c in self.channels):
            return False
        own = {"image_id": image_id, "level": b.level, "y0": b.y0, "x0": b.x0, "h": b.h, "w": b.w}
        if self.channels is None:
            own |= {"c0": b.c0, "channels": b.channels}
        holds = {"=": lambda x, v: x == v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "in": lambda x, v: x in v}
        return all(column not in own or holds[sign](own[column], value) for sign, column, value in self.kept)

    def partitions(self) -> list[Range]:
        """Ranges of bytes, from the listing alone; of Zarr, ranges of chunks, from an array's metadata."""
        out = []
        for uri in self.paths:
            fs, path = opened(uri.rstrip("/"))
            head = uri.rstrip("/").removesuffix(path) if "://" in uri else ""
            info = fs.get_file_info(path)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(uri)
            stores = [path] if info.type == pafs.FileType.Directory and zarr_arrays(fs, path) else []
            files = [] if stores else [info]
            if info.type == pafs.FileType.Directory and not stores:
                below = fs.get_file_info(pafs.FileSelector(path))
                stores = [f.path for f in below if f.type == pafs.FileType.Directory and f.base_name.endswith(".zarr")]
                files = [f for f in below if f.type == pafs.FileType.File and f.base_name.lower().endswith((".tif", ".tiff", ".czi"))]
            for f in files:
                for begin in range(0, f.size, self.split):
                    out.append(Range(head + f.path, _stem(f.path), begin, begin + self.split))
            for store in stores:
                for a in zarr_arrays(fs, store):
                    if self.level is None or a.level == self.level:
                        many = int(np.prod(a.grid))
                        step = max(1, self.split // int(np.prod(a.chunk) * np.dtype(a.dtype).itemsize))
                        out += [Range(head + store, _stem(store), k, min(many, k + step), a) for k in range(0, many, step) if any(self._wanted(_stem(store), self._chunk(a, j)) for j in range(k, min(many, k + step)))]
        return out or [Range("", "", 0, 0)]

    @staticmethod
    def _chunk(a: ZarrArray, k: int) -> Block:
        place = np.unravel_index(k, a.grid)
        c, y, x = (int(p) * n for p, n in zip(place, a.chunk))
        return Block(a.level, c, y, x, *(min(n, s - o) for n, s, o in zip(a.chunk, a.shape, (c, y, x))), k, 0, np.dtype(a.dtype).str, ("zarr",))

    def _decoded(self, p: Range) -> Iterator[tuple[Block, np.ndarray]]:
        fs, path = opened(p.uri)
        if p.array is not None:
            for k in range(p.begin, p.end):
                b = self._chunk(p.array, k)
                if self._wanted(p.image_id, b):
                    try:
                        with fs.open_input_stream(p.array.key(tuple(int(i) for i in np.unravel_index(k, p.array.grid)))) as file:
                            data = _unzarr(file.read(), p.array.packing)
                    except FileNotFoundError:
                        continue  # a chunk that was never written has no row
                    own = np.frombuffer(data, p.array.dtype).reshape(p.array.chunk)[: b.channels, : b.h, : b.w]
                    yield b, np.ascontiguousarray(own).astype(own.dtype.newbyteorder("="), copy=False)
            return
        with fs.open_input_file(path) as file:
            read = lambda at, size: file.read_at(size, at)
            index = czi_blocks(read) if read(0, 10) == b"ZISRAWFILE" else tiff_blocks(read)
            for b in index:
                if p.begin <= b.at < p.end and self._wanted(p.image_id, b):
                    yield b, pixels(read, b)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """A record batch a block, so that a task holds one block at a time."""
        if not partition.uri:
            return
        for b, own in self._decoded(partition):
            parts = [(b.c0, own)] if self.channels is None else [(to, own[c - b.c0 : c - b.c0 + 1]) for to, c in enumerate(self.channels) if 0 <= c - b.c0 < len(own)]
            rows = [(partition.image_id, b.level, c, b.y0, b.x0, *o.shape, o.dtype.name, np.ascontiguousarray(o).tobytes()) for c, o in parts]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)


class SlideSource(DataSource):
    """``spark.read.format("slide")``: blocks of TIFF, BigTIFF, CZI and Zarr slides as rows of chunks."""

    @classmethod
    def name(cls) -> str:
        return "slide"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> SlideReader:
        return SlideReader(self.options)


def slide_chunks(spark: SparkSession, path: str, level: int | None = 0, channels: list[int] | None = None, bounds: tuple[int, int, int, int] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Blocks of slides as rows of chunks; ``image_id`` is the stem of the file or store.

    ``path`` is a file, a Zarr store, or a folder of them, on any file system
    that Arrow opens. Files of any size are dealt to tasks by ranges of bytes;
    each task reads the file's index and then the blocks that begin in its range,
    belong to ``level`` (None: to any), hold one of ``channels`` (kept alone and
    renumbered in their order) and meet ``bounds`` (x0, y0, x1, y1 in pixels of
    that level). Comparisons on image_id, level, y0, x0, h and w spare blocks too:
    the session is set to push filters to Python sources, which Spark asks of a
    source that takes any.

    Read are plain, deflated and Zstandard blocks, those of TIFF with or without
    differences along rows; others raise an error. CZI mosaics lie at their own
    offsets, colours come red first. Chunks of Zarr that were never written have
    no row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideSource)
    options = {"level": "all" if level is None else str(level), "splitBytes": str(split_bytes)}
    options |= {"channels": ",".join(map(str, channels))} if channels is not None else {}
    options |= {"bounds": ",".join(map(str, bounds))} if bounds is not None else {}
    return spark.read.format("slide").options(**options).load(path)
