"""Training records: pixels, masks and boxes of a tile move together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import polygon
from tilewright.operators import dataset, training
from tilewright.plans import load_all

TILES = "image_id string, x0 long, y0 long, x1 long, y1 long, move int"
CHUNKS = "image_id string, level int, c0 int, y0 long, x0 long, channels int, h int, w int, dtype string, data binary"
ROIS = "image_id string, x0 long, y0 long, x1 long, y1 long, roi_idx int, label int, ring array<struct<x:double,y:double>>"


def _chunks(spark, whole, size):
    _, height, width = whole.shape
    rows = []
    for y in range(0, height, size):
        for x in range(0, width, size):
            own = whole[:, y : y + size, x : x + size]
            rows.append(("s", 0, 0, y, x, *own.shape, own.dtype.name, bytearray(np.ascontiguousarray(own).tobytes())))
    return spark.createDataFrame(rows, CHUNKS)


def _mask(runs, h, w):
    out = np.zeros((h, w), bool)
    for r in runs:
        out[r["y"], r["x0"] : r["x1"]] = True
    return out


def test_all_eight_moves(spark):
    whole = np.random.default_rng(1).integers(0, 60000, (2, 50, 60)).astype(np.uint16)
    rings = [[(14.0, 12.0), (27.0, 12.0), (27.0, 19.0), (20.0, 19.0), (20.0, 27.0), (14.0, 27.0)], [(13.5, 13.0), (29.0, 21.5), (17.0, 28.0)]]
    tiles = [("s", 12, 11, 30, 29, k) for k in [*range(8), None]]
    # one tile a move: the image's name tells them apart
    tiles = [(f"s{k}", *t[1:]) for k, t in enumerate(tiles)]
    chunks = _chunks(spark, whole, 16)
    chunks = chunks.drop("image_id").crossJoin(spark.createDataFrame([(t[0],) for t in tiles], "image_id string")).select(*[c.split()[0] for c in CHUNKS.split(", ")])
    rois = [(*t[:5], k, k + 1, ring) for t in tiles for k, ring in enumerate(rings)]
    got = {r["image_id"]: r for r in training.training_arrays(spark.createDataFrame(tiles, TILES), chunks, spark.createDataFrame(rois, ROIS), 16).collect()}
    assert len(got) == 9
    cut = whole[:, 11:29, 12:30].astype(float) / 65535 * 255
    plain = got["s8"]
    base = [_mask(m, 18, 18) for m in plain["masks"]]
    for k, ring in enumerate(rings):
        inside = polygon.fill_runs(polygon.as_ring([(x - 12, y - 11) for x, y in ring]), 18, 18)
        assert base[k].sum() == sum(b - a for _, a, b in inside) > 20
    for name, r in got.items():
        image = np.frombuffer(bytes(r["image"]), "<f4").reshape(2, 18, 18)
        move = dataset.MOVES[r["move"]] if r["move"] is not None else (0, False)
        want = cut[:, :, ::-1] if move[1] else cut
        want = np.rot90(want, move[0], (1, 2))
        assert np.allclose(image, want, atol=1e-4) and r["labels"] == [1, 2] and r["iscrowd"] == [0, 0]
        for k, own in enumerate(base):
            moved = np.rot90(own[:, ::-1] if move[1] else own, move[0])
            mask = _mask(r["masks"][k], 18, 18)
            # corners on whole pixels move exactly; a slanted side may take a pixel whose middle it meets
            assert (mask == moved).all() if k == 0 else (mask != moved).sum() <= 2
            ring = np.array(r["rings"][k]).reshape(-1, 2)
            assert r["boxes"][k] == [*ring.min(0).tolist(), *ring.max(0).tolist()]
            expr = spark.range(1).select(dataset.augment_ring(F.array(*[F.struct(F.lit(float(x - 12)).alias("x"), F.lit(float(y - 11)).alias("y")) for x, y in rings[k]]), move, 18).alias("r")).first()["r"]
            assert np.allclose(ring, [(p["x"], p["y"]) for p in expr])


def test_tiles_without_regions_chunks_or_shape(spark):
    whole = np.full((1, 20, 20), 255, np.uint8)
    tiles = spark.createDataFrame([("s", 0, 0, 10, 10, None), ("s", 10, 10, 30, 16, None), ("none", 0, 0, 4, 4, 3)], TILES)
    rois = spark.createDataFrame([("s", 0, 0, 10, 10, 1, 2, [(3.0, 3.0), (3.2, 3.0), (3.2, 3.1)]), ("s", 0, 0, 10, 10, 0, 7, [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0)])], ROIS)
    got = {(r["image_id"], r["x0"]): r for r in training.training_arrays(tiles, _chunks(spark, whole, 8), rois, 8, top=1.0).collect()}
    assert got["s", 0]["labels"] == [7] and got["s", 10]["labels"] == got["none", 0]["labels"] == []
    image = np.frombuffer(bytes(got["s", 10]["image"]), "<f4").reshape(1, 6, 20)
    assert (image[:, :, :10] == 1).all() and (image[:, :, 10:] == 0).all()
    assert not np.frombuffer(bytes(got["none", 0]["image"]), "<f4").any()
    assert [r["x0"] for r in training.training_arrays(tiles, _chunks(spark, whole, 8), rois, 8, keep_empty=False).collect()] == [0]
    with pytest.raises(Exception, match="only square tiles"):
        training.training_arrays(tiles.withColumn("move", F.lit(1)), _chunks(spark, whole, 8), rois, 8).collect()


def test_moves_are_drawn_by_seed(spark):
    tiles = spark.range(400).select(F.lit("s").alias("image_id"), F.col("id").alias("x0"), F.lit(0).alias("y0"), F.col("id").alias("x1"), F.lit(9).alias("y1"))
    one, two = ({r["x0"]: r["move"] for r in training.with_moves(tiles, seed).collect()} for seed in ("1", "2"))
    assert set(one.values()) == set(range(8)) and one != two and one == {r["x0"]: r["move"] for r in training.with_moves(tiles, "1").collect()}


def test_segmenter_outputs(spark):
    """Two overlapping tiles of a disc: outlines with scores, and one mask of the image without overlaps."""
    from tilewright.operators import raster

    y, x = np.mgrid[0:60, 0:80]
    whole = np.where((x - 40) ** 2 + (y - 30) ** 2 <= 200, 200, 20).astype(np.uint8)
    rows = [("s", a, 0, a + 50, 60, bytearray(whole[:, a : a + 50].tobytes())) for a in (0, 30)] + [("empty", 0, 0, 4, 4, bytearray(16))]
    tiles = spark.createDataFrame(rows, "image_id string, x0 long, y0 long, x1 long, y1 long, data binary")
    model = lambda pixels: np.stack([np.zeros(pixels.shape[1:]), (pixels[0] - 0.5) * 10])
    got = raster.segment(tiles, model, 0.6).orderBy("image_id").collect()
    likely = 1 / (1 + np.exp(-(200 / 255 - 0.5) * 10))
    assert len(got) == 2 and all(r["image_id"] == "s" and r["class_id"] == 0 and r["score"] == pytest.approx(likely, abs=0.05) and r["p_max"] == pytest.approx(likely) for r in got)
    assert max(p["x"] for r in got for p in r["ring"]) > 50
    mask = np.zeros((60, 80), int)
    for r in raster.segment_masks(tiles, model, 0.6).collect():
        mask[r["y"], r["x0"] : r["x1"]] += 1
    assert (mask == (whole == 200)).all()


def test_patches_with_pixels_and_lookups(spark):
    whole = np.random.default_rng(3).integers(0, 255, (3, 40, 40)).astype(np.uint8)
    tiles = spark.createDataFrame([("s", 5, 6, 25, 30, "a"), ("s", 0, 0, 8, 8, "foreground"), ("s", 30, 30, 40, 40, None)], "image_id string, x0 long, y0 long, x1 long, y1 long, name string")
    got = {r["x0"]: r for r in training.patches(tiles, _chunks(spark, whole, 16), 16, exclude=("foreground",)).collect()}
    assert set(got) == {5, 30} and got[5]["name"] == "a" and got[30]["name"] is None
    assert (np.frombuffer(bytes(got[5]["data"]), np.uint8).reshape(3, 24, 20) == whole[:, 6:30, 5:25]).all()
    own = spark.createDataFrame([(1, 7, 2, 5.0, 0), (2, 7, 3, 9.0, 1), (3, 8, 2, 50.0, 0), (4, 8, 2, 9.0, 0)], "id long, image_id long, category_id int, area double, iscrowd int")
    images, categories = dataset.annotation_index(own)
    assert {r["image_id"]: r["ann_ids"] for r in images.collect()} == {7: [1, 2], 8: [3, 4]} and {r["category_id"]: r["image_ids"] for r in categories.collect()} == {2: [7, 8], 3: [7]}
    ids = lambda **k: sorted(r["id"] for r in dataset.find_annotations(own, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids(images=[8], categories=[2], area=(5, 10)) == [4] and ids(crowd=True) == [2] and ids(images=[]) == []


def _moved(x, y, turns, mirror, size=1024):
    """One point, step by step; what is null lies at the edge, as it is clamped."""
    x, y = (min(max(1 if v is None else v, 1), size - 1) for v in (x, y))
    x = size - x if mirror else x
    for _ in range(turns):
        x, y = y, size - x
    return x, y


def test_odd_rings_are_moved_in_one_pass(spark):
    rings = [None, [], [None, (3.5, None)], [(0.1, 2000.7), (-4.0, 1023.0), (float("nan"), 5.25)]]
    df = spark.createDataFrame(list(enumerate(rings)), "id int, ring array<struct<x:double,y:double>>")
    moves = df.select("id", *[dataset.augment_ring(F.col("ring"), m).alias(f"m{k}") for k, m in enumerate(dataset.MOVES)])
    assert moves._jdf.queryExecution().optimizedPlan().toString().count("transform(") == len(dataset.MOVES)
    for r in moves.collect():
        for k, move in enumerate(dataset.MOVES):
            # Spark takes NaN for larger than any number
            want = rings[r["id"]] and [_moved(*[2000.0 if v is not None and v != v else v for v in p or (None, None)], *move) for p in rings[r["id"]]]
            assert (r[f"m{k}"] is None) == (want is None) and [tuple(p) for p in r[f"m{k}"] or []] == (want or [])


def test_augment_moves_every_corner_and_compiles_its_generators(spark, tmp_path):
    rows = [(7, 30), (7, 30), (8, 12345), (None, 4), (9, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").selectExpr("*", "'1-URGENT' as o_orderpriority", "1.5D as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    df = load_all()[0]["augment"](spark, str(tmp_path))
    want = []
    for key, cust in rows:
        corners = [None, None, None, None]
        if key is not None:
            x, w = key * 7919 % 8192 % 1024, 16 + key % 48
            corners[0], corners[2] = x, x + w
        if key is not None and cust is not None:
            y, h = (cust * 10473 + key * 31) % 8192 % 1024, 16 + cust % 48
            corners[1], corners[3] = y, y + h
        ring = [(corners[a], corners[b]) for a, b in ((0, 1), (2, 1), (2, 3), (0, 3))]
        want += [(key, k, turns, mirror, *map(float, _moved(*p, turns, mirror))) for turns, mirror in dataset.MOVES for k, p in enumerate(ring)]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    generators = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    assert len(generators) == 2 and all("*(" in line and "transform(" not in line for line in generators)
