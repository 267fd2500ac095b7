"""Tilings of known outlines, and the newer tile, pixel and record operators against brute force."""

import random

import numpy as np
import pytest

from tilewright.functions import polygon as P
from tilewright.graph import connected_components
from tilewright.operators import dataset, raster, sampling, tiling

# Outlines in slide pixels, and how many tiles of a 65536 by 65536 image lie in them.
TWO_PARTS = [
    [(11187, 10978), (8009, 12191), (8009, 12207), (9943, 16672), (9959, 16643), (10619, 17426), (12906, 16689), (13674, 14525)],
    [(20428, 7816), (17143, 8031), (16698, 10994), (17036, 13419), (18709, 14663), (18740, 14663), (21104, 13772), (21887, 10656), (21887, 10641), (20444, 7816)],
]
TISSUE = [
    [
        (13904, 2395), (13889, 2410), (13858, 2457), (11340, 4606), (10051, 6862), (3511, 12911), (3097, 13724), (3097, 13740), (2805, 14953), (2805, 14968),
        (2805, 15045), (4248, 15628), (4310, 15628), (4878, 15828), (4908, 15843), (4908, 15889), (4878, 15966), (4571, 17823), (4586, 17823), (4601, 17869),
        (4632, 17915), (6228, 19343), (6259, 19343), (6275, 19358), (8485, 19819), (8516, 19834), (10327, 21262), (10312, 21277), (10312, 21308), (10312, 21339),
        (11325, 23549), (11387, 23549), (14073, 24378), (14088, 24394), (14104, 24394), (17803, 24225), (18049, 22889), (18049, 22874), (18064, 22874), (18632, 21201),
        (18632, 21185), (18648, 21155), (18709, 21139), (20091, 20970), (20106, 20986), (20152, 21032), (20260, 21108), (20382, 21201), (24143, 23043), (24236, 23043),
        (28565, 16273), (28764, 12312), (28396, 10163), (27260, 8766), (27244, 8751), (27137, 8689), (15608, 2410),
    ]
]
COUNTS = [(TWO_PARTS, 224, (878, 919, 983), 2), (TWO_PARTS, 1024, (27, 32, 45), 2), (TISSUE, 224, (7211, 7288, 7423), 1), (TISSUE, 1024, (303, 330, 353), 1)]
SLIDES = [(TWO_PARTS, (27, 23, 23, 21)), (TISSUE, (303, 296, 294, 290))]

REGION = "image_id string, roi_idx long, name string, x0 double, y0 double, x1 double, y1 double, area double, ring array<struct<x:double,y:double>>"


def _regions(spark, parts, name="bound"):
    rows = [("s", i, name, *P.bounds([P.as_ring(p)]), P.area([P.as_ring(p)]), [tuple(map(float, q)) for q in p]) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, REGION)


def _image(spark, size=65536):
    return spark.createDataFrame([("s", size, size)], "image_id string, width long, height long")


@pytest.mark.parametrize("parts, tile, counts, groups", COUNTS)
def test_golden_grids(spark, parts, tile, counts, groups):
    for threshold, want in zip((1.0, 0.9, 0.5), counts):
        tiles = tiling.tile_grid(_image(spark), _regions(spark, parts), "bound", tile, threshold)
        at = {(r["x0"] // tile, r["y0"] // tile) for r in tiles.collect()}
        assert len(at) == want
        if threshold == 1.0:
            edges = [(x << 20 | y, (x + a) << 20 | (y + b)) for x, y in at for a, b in ((0, 1), (1, 0)) if (x + a, y + b) in at]
            joined = connected_components(spark.createDataFrame(edges, "a long, b long"))
            lone = len(at) - joined.count()
            assert joined.select("component").distinct().count() + lone == groups


@pytest.mark.parametrize("parts, counts", SLIDES)
def test_golden_slides(spark, parts, counts):
    tiles = tiling.tile_grid(_image(spark), _regions(spark, parts), "bound", 1024, 1.0, tiling.DEFAULT_SLIDES)
    got = {r["name"]: r["count"] for r in tiles.groupBy("name").count().collect()}
    assert [got[n] for n in ("(0, 0)", "(512, 0)", "(0, 512)", "(512, 512)")] == list(counts)


def test_clipped_geometry_and_parts(spark):
    # a comb: two teeth reach into the tiles of the lower row
    comb = [(0, 0), (90, 0), (90, 90), (70, 90), (70, 30), (20, 30), (20, 90), (0, 90)]
    rois = _regions(spark, [comb, [(10, 10), (40, 10), (40, 35), (10, 35)]], "r")
    tiles = spark.createDataFrame([("s", i, x, y, x + 100, y + 50) for i, (x, y) in enumerate(((0, 0), (0, 50)))], "image_id string, tile_idx long, x0 long, y0 long, x1 long, y1 long")
    got = {(r["tile_idx"], r["roi_idx"]): r for r in tiling.tile_roi_join(tiles, rois, 64, geometry=True, keep_multipart=True).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0)} and len(got[1, 0]["clip"]) == 2
    for r in got.values():
        assert sum(P.area([P.as_ring(c)]) for c in r["clip"]) == pytest.approx(r["clip_area"])
    one = {(r["tile_idx"], r["roi_idx"]) for r in tiling.tile_roi_join(tiles, rois, 64, geometry=True).collect()}
    assert one == {(0, 0), (0, 1)}
    plain = {(r["tile_idx"], r["roi_idx"]): r["clip_area"] for r in tiling.tile_roi_join(tiles, rois, 64).collect()}
    assert plain == pytest.approx({k: r["clip_area"] for k, r in got.items()})
    boxes = tiling.tile_roi_join(tiles, rois.drop("ring"), 64, geometry=True).collect()
    assert all(P.area([P.as_ring(r["clip"][0])]) == r["clip_area"] for r in boxes) and boxes


def test_dissolve_and_several_bound_names(spark):
    r = random.Random(1)
    squares = [[(x, y), (x + 30, y), (x + 30, y + 20), (x, y + 20)] for x, y in ((r.randrange(300), r.randrange(300)) for _ in range(25))]
    cells = {(x, y) for s in squares for x in range(s[0][0], s[1][0]) for y in range(s[0][1], s[2][1])}
    got = tiling.dissolve(_regions(spark, [s[::-1] if i % 2 else s for i, s in enumerate(squares)])).collect()
    # no hole is left out as long as the areas agree
    assert sum(x["area"] for x in got) >= len(cells) and sorted(x["part"] for x in got) == list(range(len(got)))
    filled = sum(x1 - x0 for x in got for _, x0, x1 in P.fill_runs(P.as_ring(x["ring"]), 400, 400))
    assert filled == sum(x["area"] for x in got)
    both = _regions(spark, TWO_PARTS[:1], "a").union(_regions(spark, TWO_PARTS[1:], "b"))
    names = tiling.tile_overlap(_image(spark, 24000), both, ["a", "b"], 1024, 0.5, 0.9).collect()
    apart = [tiling.tile_overlap(_image(spark, 24000), both, n, 1024, 0.5, 0.9).count() for n in ("a", "b")]
    assert len(names) == sum(apart) and {t["name"] for t in names} == {"a-b"}


def test_validity_of_many_rings_is_that_of_each(spark):
    r = random.Random(2)
    rings = [np.array([(r.randrange(6), r.randrange(6)) for _ in range(r.randrange(2, 9))], float) for _ in range(400)]
    rings += [np.array([(np.cos(t), np.sin(t)) for t in np.linspace(0, 6, 40)]), np.array([(np.cos(2 * t), np.sin(t)) for t in np.linspace(0, 6, 40)])]

    def brute(ring):
        n = len(ring)
        if n < 3 or P.signed_area(ring) == 0 or len({tuple(p) for p in ring.tolist()}) < n:
            return False
        return not any(P._touching(ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]) for i in range(n) for j in range(i + 2, n - (i == 0)))

    want = [brute(x) for x in rings]
    assert P.are_valid(rings).tolist() == want and [P.is_valid(x) for x in rings] == want and 0 < sum(want) < len(want)


def test_masks_by_runs_are_those_by_pixels(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        y, x = r.randrange(500), r.randrange(80)
        rows.append(("s", i, f"c{i % 3}", [(y + k, x, x + r.randrange(1, 20)) for k in range(r.randrange(1, 40))]))
    runs = spark.createDataFrame(rows, "image_id string, roi_idx int, class string, runs array<struct<y:int,x0:int,x1:int>>")
    painted = {}
    for _, _, c, own in rows:
        painted |= {(y, x): c for y, a, b in own for x in range(a, b)}
    got = {(t["y"], x): t["class"] for t in raster.semantic_runs(runs, ["image_id"]).collect() for x in range(t["x0"], t["x1"])}
    assert got == painted and {(t["y"], t["x"]): t["class"] for t in raster.semantic_pixels(runs, ["image_id"]).collect()} == painted
    tiles = spark.createDataFrame([("s", x, y, x + 37, y + 190) for x in range(0, 120, 37) for y in range(0, 560, 190)], "image_id string, x0 int, y0 int, x1 int, y1 int")
    for t in raster.tile_mask(runs, tiles, ["image_id"]).collect():
        assert t["pixels"] == sum(t["x0"] <= x < t["x1"] and t["y0"] <= y < t["y1"] for y, x in painted)


def test_rle_joins_runs_over_lines(spark):
    bits = [[1, 1, 0], [0, 0, 1], [1, 1, 1], [1, 0, 0]]
    pixels = spark.createDataFrame([(7, y, x, v) for y, line in enumerate(bits) for x, v in enumerate(line)], "image_id int, y int, x int, v int").repartition(3)
    got = sorted((t["start"], t["length"], t["bit"]) for t in raster.rle(pixels, ["image_id"], 3, pixels["v"] > 0).collect())
    assert got == [(0, 2, 1), (2, 3, 0), (5, 5, 1), (10, 2, 0)]


def test_tiles_are_padded_resized_and_projected(spark):
    a = np.arange(2 * 3 * 5, dtype=np.uint8).reshape(2, 3, 5)
    tiles = spark.createDataFrame([("s", 10, 20, 15, 23, bytearray(a.tobytes()))], "image_id string, x0 long, y0 long, x1 long, y1 long, data binary")
    t = raster.pad_square(tiles, 8, 2).first()
    padded = np.frombuffer(bytes(t["data"]), np.uint8).reshape(2, 8, 8)
    assert (t["h"], t["w"]) == (8, 8) and (padded[:, :3, :5] == a).all() and padded.sum() == a.sum()
    t = raster.resize(tiles, 10, 2).first()
    sized = np.frombuffer(bytes(t["data"]), np.uint8).reshape(2, 10, 10)
    assert (sized[:, ::9, ::9] == a[:, [0, 2]][:, :, [0, 4]]).all() and (sized[0, 0, ::2] == a[0, 0]).all()
    wide = a.astype(np.uint16)
    chunks = spark.createDataFrame([("s", 0, 0, 0, 0, 2, 3, 5, "uint16", bytearray(wide.tobytes()))], "image_id string, level int, c0 int, y0 long, x0 long, channels int, h int, w int, dtype string, data binary")
    got = {c["c0"]: np.frombuffer(bytes(c["data"]), np.uint16).reshape(3, 5) for c in raster.project_channels(chunks, [1, 5, 0]).collect()}
    assert set(got) == {0, 2} and (got[0] == wide[1]).all() and (got[2] == wide[0]).all()


def test_batches_and_counts_of_a_hot_key(spark):
    rows = [(i, "hot") for i in range(500)] + [(1000 + i, "cold") for i in range(7)] + [(2000, None)]
    df = spark.createDataFrame(rows, "id int, key string").repartition(5)
    got = {r["id"]: r["batch"] for r in sampling.batches(df, "id", 12, ["key"]).collect()}
    assert got == {i: (k // 12) for own in ([r[0] for r in rows if r[1] == key] for key in ("hot", "cold", None)) for k, i in enumerate(own)}
    padded = [r for r in sampling.batches(df, "id", 12, ["key"], pad=True).collect() if r["key"] == "cold"]
    assert sorted(r["id"] for r in padded) == sorted(1000 + k % 7 for k in range(12))
    for rows in (1, 1 << 20):
        ranks = sorted((r["rank"], r["total"]) for r in sampling.hash_order(df, "id", "s", rows).collect())
        assert ranks == [(k, 508) for k in range(1, 509)]


def test_flips_and_keypoints(spark):
    df = spark.createDataFrame([(1, 2, 8, [(0, 1, 4)], [3, 5, 2, 9, 9, 0])], "id int, x0 int, x1 int, runs array<struct<y:int,x0:int,x1:int>>, keypoints array<int>")
    from pyspark.sql import functions as F

    r = dataset.flip_horizontal(df, F.lit(20)).first()
    assert (r["x0"], r["x1"], r["keypoints"]) == (12, 18, [17, 5, 2, 0, 0, 0]) and tuple(r["runs"][0]) == (0, 16, 19)
    images = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    points = lambda n: [1, 1, 2] * n + [0, 0, 0]
    notes = spark.createDataFrame([(1, 5, 5, points(6)), (1, 5, 5, points(4)), (2, 5, 5, points(9)), (3, 1, 5, points(12))], "image_id int, w int, h int, keypoints array<int>")
    assert [x["id"] for x in dataset.drop_unannotated(images, notes).collect()] == [1]
    assert sorted(x["id"] for x in dataset.drop_unannotated(images, notes.drop("keypoints")).collect()) == [1, 2]


def test_training_sets_and_their_settings(spark, tmp_path):
    from tilewright.operators.regions import class_index
    from tilewright.sources.config import TrainingConfig, read_training_config

    joined = spark.createDataFrame([("s", t, i, f"c{i % 2}", 1.0) for t in range(20) for i in range(t % 3 + 1)], "image_id string, tile_idx long, roi_idx long, class string, clip_area double")
    empty = spark.createDataFrame([("s", 100 + t) for t in range(50)], "image_id string, tile_idx long")
    got = dataset.training_set(joined, empty, ["image_id", "tile_idx"], class_index(joined, "class"), 0.5, 0.9).collect()
    full, bare = [r for r in got if r["rois"]], [r for r in got if not r["rois"]]
    assert (len(full), len(bare)) == (20, 10) and sum(r["split"] == "train" for r in got) == 27
    assert all([(x["roi_idx"], x["label"]) for x in r["rois"]] == [(i, i % 2 + 1) for i in range(r["tile_idx"] % 3 + 1)] for r in full)
    (tmp_path / "t.yaml").write_text("train_images: a.zarr\ntrain_rois: [a.json]\nneg_proportion: 0\nsolver_steps: [10, 20]\nother: 1\n")
    read = read_training_config(str(tmp_path / "t.yaml"))
    assert (read.train_images, read.neg_proportion, read.solver_steps, read.train_class) == (["a.zarr"], 0, [10, 20], "train-area")
    with pytest.raises(ValueError):
        TrainingConfig(["a"], [])
