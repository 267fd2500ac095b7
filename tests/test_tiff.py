import struct

import numpy as np
import pytest

from tilewright.sources import images, tiff


def _put(name, folder, raw):
    (folder / name).write_bytes(raw)


def test_tiles_become_files_and_chunks_again(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = [rng.integers(0, 60000, (3, 20, 31)).astype(np.uint16) for _ in range(4)]
    rows = [("s", 31 * k, 0, 31 * k + 31, 20, bytearray(pixels[min(k, 3)].tobytes())) for k in range(5)]
    tiles = spark.createDataFrame(rows, "image_id string, x0 long, y0 long, x1 long, y1 long, data binary")
    files = tiff.tile_files(tiles, 3, "uint16")
    names = [r["name"] for r in files.orderBy("x0").collect()]
    assert names[3] == names[4] and len(set(names)) == 4
    tiff.write_files(files, str(tmp_path / "out"))
    tiff.write_files(files, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(set(names))
    got = {}
    for c in tiff.tiff_chunks(spark, str(tmp_path / "out")).collect():
        got.setdefault(c["image_id"], np.zeros((3, 20, 31), np.uint16))[c["c0"]] = np.frombuffer(bytes(c["data"]), c["dtype"]).reshape(c["h"], c["w"])
    assert all((got[n[:-4]] == pixels[min(k, 3)]).all() for k, n in enumerate(names))
    chosen = tiff.tiff_chunks(spark, str(tmp_path / "out" / names[0]), channels=[2, 0]).collect()
    assert {c["c0"]: bytes(c["data"]) for c in chosen} == {0: pixels[0][2].tobytes(), 1: pixels[0][0].tobytes()}


def _tiled(order, level0, level1):
    """A tiled, uncompressed, interleaved file of two levels, written by hand."""
    out, places = bytearray(8), []
    for level in (level0, level1):
        h, w, c = level.shape
        starts, size = [], 16 * 16 * c
        for y in range(0, h, 16):
            for x in range(0, w, 16):
                tile = np.zeros((16, 16, c), np.uint8)
                own = level[y : y + 16, x : x + 16]
                tile[: own.shape[0], : own.shape[1]] = own
                starts.append(len(out))
                out += tile.tobytes()
        arrays = []
        for values in (starts, [size] * len(starts)):
            arrays.append(len(out))
            out += struct.pack(f"{order}{len(values)}I", *values)
        n = len(starts)
        # one value sits in its entry
        at = [arrays[0], arrays[1]] if n > 1 else [starts[0], size]
        entries = [(256, w, 1), (257, h, 1), (259, 1, 1), (277, c, 1), (322, 16, 1), (323, 16, 1), (324, at[0], n), (325, at[1], n)]
        places.append((len(out), len(out) + 2 + 12 * len(entries)))
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHII", tag, 4, many, value) for tag, value, many in entries) + b"\0" * 4
    struct.pack_into(order + "2sHI", out, 0, b"II" if order == "<" else b"MM", 42, places[0][0])
    struct.pack_into(order + "I", out, places[0][1], places[1][0])
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_levels_of_tiled_files(spark, tmp_path, order):
    rng = np.random.default_rng(2)
    whole = [rng.integers(0, 255, (40, 50, 3)).astype(np.uint8), rng.integers(0, 255, (10, 12, 3)).astype(np.uint8)]
    _put("slide.ome.tif", tmp_path, _tiled(order, *whole))
    for k, want in enumerate(whole):
        got = np.zeros_like(np.moveaxis(want, 2, 0))
        for c in tiff.tiff_chunks(spark, str(tmp_path), k).collect():
            assert c["image_id"] == "slide"
            got[:, c["y0"] : c["y0"] + c["h"], c["x0"] : c["x0"] + c["w"]] = np.frombuffer(bytes(c["data"]), np.uint8).reshape(c["channels"], c["h"], c["w"])
        assert (got == np.moveaxis(want, 2, 0)).all()
    with pytest.raises(ValueError):
        tiff.levels(b"no such file")


def test_older_zarr_arrays(spark, tmp_path):
    import json
    import zlib

    pixels = np.arange(3 * 6 * 7, dtype=np.uint16).reshape(3, 6, 7)
    meta = {"zarr_format": 2, "shape": [3, 6, 7], "chunks": [3, 4, 4], "dtype": "<u2", "compressor": {"id": "zlib", "level": 1}, "order": "C", "fill_value": 0, "filters": None}
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / ".zarray").write_text(json.dumps(meta))
    for j in range(2):
        for i in range(2):
            block = np.zeros((3, 4, 4), np.uint16)
            own = pixels[:, 4 * j : 4 * j + 4, 4 * i : 4 * i + 4]
            block[:, : own.shape[1], : own.shape[2]] = own
            (tmp_path / "0" / f"0.{j}.{i}").write_bytes(zlib.compress(block.tobytes()))
    for given in (None, meta):
        got = np.zeros_like(pixels)
        for c in images.zarr2_chunks(spark, str(tmp_path / "0"), "s", given).collect():
            got[:, c["y0"] : c["y0"] + c["h"], c["x0"] : c["x0"] + c["w"]] = np.frombuffer(bytes(c["data"]), np.uint16).reshape(c["channels"], c["h"], c["w"])
        assert (got == pixels).all()
