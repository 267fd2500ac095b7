import random

from tilewright.functions import polygon as P
from tilewright.operators import raster, sampling, tiling

IMAGES = "image_id string, width long, height long"
REGION = "image_id string, roi_idx long, name string, x0 double, y0 double, x1 double, y1 double, area double, ring array<struct<x:double,y:double>>"


def _region(idx, name, points):
    ring = P.as_ring(points)
    return ("s", idx, name, *P.bounds([ring]), P.area([ring]), [tuple(map(float, p)) for p in points])


PARTS = [[(100, 80), (700, 120), (640, 700), (380, 420), (120, 660)], [(800, 800), (1400, 820), (1380, 1300), (820, 1250)]]


def _kept(tile, thr, parts=PARTS):
    return sum(P.clip_area(P.as_ring(p), *tile) for p in parts) >= thr * (tile[2] - tile[0]) * (tile[3] - tile[1])


def test_grid_and_slides_in_polygons_match_brute_force(spark):
    images = spark.createDataFrame([("s", 1500, 1400)], IMAGES)
    regions = spark.createDataFrame([_region(i, "r", p) for i, p in enumerate(PARTS)] + [_region(9, "other", PARTS[0])], REGION)
    for thr in (0.5, 0.9, 1.0):
        got = {(t["name"], t["x0"], t["y0"], t["x1"], t["y1"]) for t in tiling.tile_grid(images, regions, "r", 64, thr, ((32, 0), (0, 32))).collect()}
        base = [(x * 64, y * 64, x * 64 + 64, y * 64 + 64) for x in range(24) for y in range(22) if _kept((x * 64, y * 64, x * 64 + 64, y * 64 + 64), thr) and x * 64 + 64 <= 1500 and y * 64 + 64 <= 1400]
        want = {("(0, 0)", *b) for b in base}
        for dx, dy in ((32, 0), (0, 32)):
            moved = [(a + dx, b + dy, c + dx, d + dy) for a, b, c, d in base]
            want |= {(f"({dx}, {dy})", *m) for m in moved if _kept(m, thr) and m[2] <= 1500 and m[3] <= 1400}
        assert got == want


def test_unknown_names_fall_back_to_the_image(spark):
    images = spark.createDataFrame([("s", 256, 128)], IMAGES)
    assert tiling.tile_grid(images, None, None, 64).count() == 8
    regions = spark.createDataFrame([_region(0, "r", PARTS[0])], REGION)
    assert tiling.tile_grid(images, regions, "no such", 64).count() == 8


def test_overlapping_steps_and_clamping(spark):
    images = spark.createDataFrame([("a", 2048, 1024), ("b", 2500, 1024), ("c", 512, 4000)], IMAGES)
    got = {}
    for t in tiling.tile_overlap(images).collect():
        got.setdefault(t["image_id"], []).append((t["x0"], t["x1"]))
    assert sorted(got["a"]) == [(0, 1024), (512, 1536), (1024, 2048)] and sorted(got["b"])[-1] == (1536, 2500) and "c" not in got


def test_tile_roi_join_with_polygons_matches_brute_force(spark):
    r = random.Random(2)
    rois = []
    for i in range(40):
        x, y = r.randrange(0, 900), r.randrange(0, 900)
        rois.append([(x, y), (x + r.randrange(20, 200), y + r.randrange(0, 30)), (x + r.randrange(10, 60), y + r.randrange(40, 200))])
    regions = spark.createDataFrame([_region(i, "ab"[i % 2], p) for i, p in enumerate(rois)], REGION)
    tiles = tiling.tile_overlap(spark.createDataFrame([("s", 1024, 1024)], IMAGES), tile_size=256).select("image_id", "x0", "y0", "x1", "y1")
    got = {(t["x0"], t["y0"], t["roi_idx"]): t["clip_area"] for t in tiling.tile_roi_join(tiles, regions, 256, exclude=("b",)).collect()}
    want = {}
    for t in tiles.collect():
        for i, p in enumerate(rois):
            a = P.clip_area(P.as_ring(p), t["x0"], t["y0"], t["x1"], t["y1"])
            if i % 2 == 0 and a > 0.05 * P.area([P.as_ring(p)]):
                want[t["x0"], t["y0"], i] = a
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    records = tiling.tile_records(tiling.tile_roi_join(tiles, regions, 256), tiles.columns)
    assert records.count() == len({k[:2] for k in {(t["x0"], t["y0"]) for t in tiling.tile_roi_join(tiles, regions, 256).collect()}})


def test_batches_lose_nothing_and_negatives_are_drawn(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    assert sampling.batches(df, "k", 12).groupBy("batch").count().orderBy("batch").toPandas()["count"].tolist() == [12, 12, 6]
    assert sampling.with_negatives(df, spark.range(100, 150).withColumnRenamed("id", "k"), "k", 0.5).count() == 45
    assert sampling.train_val_split(df.where("k < 0"), "k").count() == 0


def test_merged_runs_are_disjoint(spark):
    runs = spark.createDataFrame([("s", 1, 0, 5), ("s", 1, 3, 9), ("s", 1, 9, 12), ("s", 1, 20, 22), ("s", 2, 0, 1)], "image_id string, y int, x0 int, x1 int")
    assert sorted((r["y"], r["x0"], r["x1"]) for r in raster.merge_runs(runs, ["image_id"]).collect()) == [(1, 0, 12), (1, 20, 22), (2, 0, 1)]


def test_painting_in_order_multiplies_nothing_out(spark):
    """Regions of several rows, types of keys and classes of any kind: against pixels; the plan has no join."""
    import random

    from tilewright.operators import raster

    r = random.Random(3)
    rows = [(r.choice("ab"), k, r.choice(["x", "y", None]), [(y, x, x + r.randrange(0, 30)) for y in range(r.randrange(-40, 20), 40) for x in (r.randrange(-50, 50),)]) for k in range(80)]
    r.shuffle(rows)
    want = {}
    for image, _, cls, runs in sorted(rows, key=lambda q: q[1]):
        want |= {(image, y, x): cls for y, a, b in runs for x in range(a, b)}
    runs = spark.createDataFrame(rows, "image string, roi_idx long, class string, runs array<struct<y:int,x0:int,x1:int>>")
    painted = raster.semantic_runs(runs, ["image"])
    got = [(q["image"], q["y"], x, q["class"]) for q in painted.collect() for x in range(q["x0"], q["x1"])]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    assert "Join" not in painted._jdf.queryExecution().executedPlan().toString()
