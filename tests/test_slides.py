"""Slides read by ranges of bytes: only blocks that are asked for, files of any size, three formats."""

import json
import struct
import zlib

import numpy as np
import pytest
import zstandard

from tilewright.sources import images, slides, tiff


def _image(rows, shape, dtype="uint8"):
    out = np.zeros(shape, dtype)
    for r in rows:
        out[r["c0"] : r["c0"] + r["channels"], r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["channels"], r["h"], r["w"])
    return out


def _big_tiff(path, levels, edge, far=0, packing=1, predictor=1, pages=None):
    """A BigTIFF of tiled pages; ``far`` bytes of nothing stand before the pixels. levels: arrays (h, w, c)."""
    with open(path, "wb") as f:
        f.seek(16)
        heads, at = [], 16
        for own in levels:
            h, w, c = own.shape
            f.seek(max(at, 16 + far) if far else at)
            starts, sizes = [], []
            for y in range(0, h, edge):
                for x in range(0, w, edge):
                    tile = np.zeros((edge, edge, c), own.dtype)
                    part = own[y : y + edge, x : x + edge]
                    tile[: part.shape[0], : part.shape[1]] = part
                    if predictor == 2:
                        tile[:, 1:] = tile[:, 1:] - tile[:, :-1]
                    raw = {1: bytes, 8: zlib.compress, 50000: zstandard.ZstdCompressor().compress}[packing](tile.tobytes())
                    starts.append(f.tell())
                    sizes.append(len(raw))
                    f.write(raw)
            places = []
            for values in (starts, sizes):
                places.append(f.tell())
                f.write(struct.pack(f"<{len(values)}Q", *values))
            n = len(starts)
            one = places if n > 1 else [starts[0], sizes[0]]
            entries = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 8 * own.dtype.itemsize), (259, 3, 1, packing), (277, 3, 1, c), (317, 3, 1, predictor), (322, 3, 1, edge), (323, 3, 1, edge), (324, 16, n, one[0]), (325, 16, n, one[1])]
            heads.append((f.tell(), f.tell() + 8 + 20 * len(entries)))
            f.write(struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in entries) + struct.pack("<Q", 0))
            at = f.tell()
        for (_, link), (after, _) in zip(heads, heads[1:]):
            f.seek(link)
            f.write(struct.pack("<Q", after))
        f.seek(0)
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, heads[0][0]))


@pytest.mark.parametrize("packing,predictor", [(1, 1), (8, 2), (50000, 1)])
def test_a_pyramid_beyond_four_gigabytes(spark, tmp_path, packing, predictor):
    rng = np.random.default_rng(4)
    whole = [rng.integers(0, 60000, (100, 130, 2)).astype(np.uint16), rng.integers(0, 60000, (50, 65, 2)).astype(np.uint16)]
    _big_tiff(tmp_path / "far.ome.tif", whole, 16, far=5 << 30, packing=packing, predictor=predictor)
    for level, want in enumerate(whole):
        got = slides.slide_chunks(spark, str(tmp_path), level, split_bytes=1 << 30).collect()
        assert {r["image_id"] for r in got} == {"far"} and {r["level"] for r in got} == {level}
        assert (_image(got, (2, *want.shape[:2]), "uint16") == np.moveaxis(want, 2, 0)).all()
    # a region: the four tiles it meets, one channel
    got = slides.slide_chunks(spark, str(tmp_path), 0, channels=[1], bounds=(30, 30, 34, 34), split_bytes=1 << 30).collect()
    assert sorted((r["y0"], r["x0"]) for r in got) == [(16, 16), (16, 32), (32, 16), (32, 32)]
    assert all((np.frombuffer(bytes(r["data"]), "uint16").reshape(r["h"], r["w"]) == whole[0][r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"], 1]).all() and r["c0"] == 0 for r in got)


class _Counted:
    def __init__(self, path):
        self.file, self.bytes = open(path, "rb"), 0

    def __call__(self, at, size):
        self.file.seek(at)
        self.bytes += size
        return self.file.read(size)


def test_only_the_blocks_asked_for_are_read(spark, tmp_path):
    own = np.arange(512 * 512, dtype=np.uint16).reshape(512, 512, 1)
    _big_tiff(tmp_path / "s.tif", [own], 32)
    read = _Counted(tmp_path / "s.tif")
    index = slides.tiff_blocks(read)
    assert len(index) == 256 and read.bytes < 10_000
    # ranges of bytes: every block belongs to one task; and a pushed filter spares all blocks but one
    reader = slides.SlideReader({"path": str(tmp_path / "s.tif"), "splitBytes": "70000"})
    parts = reader.partitions()
    assert len(parts) > 5 and sum(len(list(reader._decoded(p))) for p in parts) == 256
    reader.pushFilters([slides.EqualTo(("y0",), 64), slides.LessThan(("x0",), 32)])
    assert [(b.y0, b.x0) for p in parts for b, _ in reader._decoded(p)] == [(64, 0)]
    got = slides.slide_chunks(spark, str(tmp_path / "s.tif")).where("y0 = 64 and x0 < 32").collect()
    assert len(got) == 1 and (_image(got, (1, 512, 512), "uint16")[0, 64:96, :32] == own[64:96, :32, 0]).all()


def test_pages_of_one_size_are_channels(spark, tmp_path):
    rng = np.random.default_rng(5)
    planes = [rng.integers(0, 255, (40, 40, 1)).astype(np.uint8) for _ in range(3)] + [rng.integers(0, 255, (20, 20, 1)).astype(np.uint8) for _ in range(3)]
    _big_tiff(tmp_path / "c.tif", planes, 16, packing=8)
    for level in (0, 1):
        got = slides.slide_chunks(spark, str(tmp_path), level, channels=[2, 0]).collect()
        edge = 40 >> level
        assert (_image(got, (2, edge, edge)) == np.stack([planes[3 * level + 2][:, :, 0], planes[3 * level][:, :, 0]])).all()
    with pytest.raises(Exception, match="not a TIFF"):
        (tmp_path / "d.tif").write_bytes(b"nothing of the kind")
        slides.slide_chunks(spark, str(tmp_path / "d.tif")).collect()


def _czi(path, tiles):
    """tiles: (C, M, y, x, size over stored size, packing, pixels (h, w) or (h, w, 3))."""

    def segment(kind, body):
        return struct.pack("<16sqq", kind, len(body), len(body)) + body

    entries, out = [], bytearray(segment(b"ZISRAWFILE", bytes(512)))
    for c, m, y, x, scale, packing, own in tiles:
        h, w = own.shape[:2]
        kind = {("uint8", 2): 0, ("uint16", 2): 1, ("uint8", 3): 3}[own.dtype.name, own.ndim]
        axes = [(b"X", x, w * scale, w), (b"Y", y, h * scale, h), (b"C", c, 1, 1), (b"M", m, 1, 1), (b"T", 0, 1, 1)]
        entry = struct.pack("<2siqiiB5si", b"DV", kind, len(out), 0, packing, int(scale > 1), bytes(5), len(axes)) + b"".join(struct.pack("<4siifi", a, start, size, 0.0, stored) for a, start, size, stored in axes)
        raw = own.tobytes()
        if packing == 5:
            raw = zstandard.ZstdCompressor().compress(raw)
        elif packing == 6:
            raw = bytes([3, 1, 1]) + zstandard.ZstdCompressor().compress(np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes())
        head = struct.pack("<iiq", 7, 0, len(raw)) + entry
        entries.append(entry)
        out += segment(b"ZISRAWSUBBLOCK", head.ljust(256, b"\0") + b"<meta/>" + raw)
    struct.pack_into("<q", out, 32 + 52, len(out))
    out += segment(b"ZISRAWDIRECTORY", struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries))
    path.write_bytes(out)


def test_mosaics_of_czi(spark, tmp_path):
    rng = np.random.default_rng(6)
    whole = rng.integers(0, 60000, (2, 60, 80)).astype(np.uint16)
    tiles = [(c, 2 * j + i, 30 * j - 100, 40 * i - 7, 1, packing, whole[c, 30 * j : 30 * j + 30, 40 * i : 40 * i + 40]) for c in (0, 1) for j, packing in ((0, 0), (1, 5 + c)) for i in (0, 1)]
    small = whole[:, ::2, ::2]
    tiles += [(c, 0, -100, -7, 2, 0, np.ascontiguousarray(small[c])) for c in (0, 1)]
    _czi(tmp_path / "slide.czi", tiles)
    got = slides.slide_chunks(spark, str(tmp_path / "slide.czi"), split_bytes=2000).collect()
    assert len(got) == 8 and (_image(got, whole.shape, "uint16") == whole).all()
    assert (_image(slides.slide_chunks(spark, str(tmp_path / "slide.czi"), 1).collect(), small.shape, "uint16") == small).all()
    assert len(slides.slide_chunks(spark, str(tmp_path), bounds=(0, 0, 10, 10)).collect()) == 2
    # every third pixel of rows and columns, the middle of its cell, whatever the tiles
    shrunk = images.shrink(slides.slide_chunks(spark, str(tmp_path)), 3).collect()
    assert (_image(shrunk, (2, 20, 27), "uint16") == whole[:, 1::3, 1::3]).all()
    colour = rng.integers(0, 255, (9, 11, 3)).astype(np.uint8)
    _czi(tmp_path / "colour.czi", [(0, 0, 0, 0, 1, 0, colour)])
    assert (_image(slides.slide_chunks(spark, str(tmp_path / "colour.czi")).collect(), (3, 9, 11)) == np.moveaxis(colour[:, :, ::-1], 2, 0)).all()


@pytest.mark.parametrize("version", [2, 3])
def test_a_store_of_mostly_unwritten_chunks(spark, tmp_path, version):
    """The layout of the survey's test slide: a group with array 0 of 3 x 65,536 x 65,536 in chunks of 3 x 1024 x 1024."""
    folder = tmp_path / "test.zarr" / "0"
    folder.mkdir(parents=True)
    shape, chunk = [3, 1 << 16, 1 << 16], [3, 1024, 1024]
    if version == 2:
        (tmp_path / "test.zarr" / ".zgroup").write_text('{"zarr_format": 2}')
        (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": "|u1", "compressor": {"id": "zlib", "level": 1}, "order": "C", "fill_value": 0, "filters": None}))
    else:
        (folder / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "data_type": "uint8", "codecs": [{"name": "bytes"}, {"name": "gzip"}], "fill_value": 0}))
    own = np.full(chunk, 7, np.uint8)
    own[1] = 9
    for y, x in ((0, 0), (63, 63), (5, 9)):
        if version == 2:
            (folder / f"0.{y}.{x}").write_bytes(zlib.compress(own.tobytes()))
        else:
            import gzip

            (folder / "c" / "0" / str(y)).mkdir(parents=True, exist_ok=True)
            (folder / "c" / "0" / str(y) / str(x)).write_bytes(gzip.compress(own.tobytes()))
    every = slides.slide_chunks(spark, str(tmp_path / "test.zarr"))
    assert sorted((r["y0"], r["x0"]) for r in every.select("y0", "x0").collect()) == [(0, 0), (5120, 9216), (64512, 64512)]
    some = slides.slide_chunks(spark, str(tmp_path), channels=[1], bounds=(9000, 5000, 9300, 5200)).collect()
    assert [(r["image_id"], r["y0"], r["x0"], r["channels"]) for r in some] == [("test", 5120, 9216, 1)] and set(bytes(some[0]["data"])) == {9}
    reader = slides.SlideReader({"path": str(tmp_path), "bounds": "9000,5000,9300,5200"})
    # two rows of chunks meet the bounds, and each lies in a range of its own
    assert len(reader.partitions()) == 2
