"""Queries over whole tables against brute force."""

import os
import random
from collections import Counter

import pytest

from tilewright.plans import load_all
from tilewright.plans.views import view

SF = "/root/testdata/sf0.001"
QUERIES, _ = load_all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_every_box_is_painted(spark):
    painted, sizes = {}, {}
    for d in sorted(view(spark, SF, "det").collect(), key=lambda d: d["id"]):
        x0, y0 = d["x0"] % 256, d["y0"] % 256
        x1, y1 = min(x0 + 16 + d["id"] % 48, 256), min(y0 + 20, 256)
        sizes[d["id"]] = (x1 - x0) * (y1 - y0)
        painted |= {(d["image_id"], x, y): d["category_id"] for x in range(x0, x1) for y in range(y0, y1)}
    assert {r["roi_idx"]: r["pixels"] for r in QUERIES["rasterize"](spark, SF).collect()} == sizes
    got = {(r["image_id"], r["class"]): r["pixels"] for r in QUERIES["semantic_records"](spark, SF).collect()}
    assert got == Counter((image, c) for (image, _, _), c in painted.items())
    tiles = Counter((image, x // 64, y // 64) for image, x, y in painted)
    got = {(r["image_id"], r["tx"], r["ty"]): r["pixels"] for r in QUERIES["tile_mask"](spark, SF).collect()}
    assert got == {k: n for k, n in tiles.items() if 4 * n >= 64 * 64}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_no_row_or_pixel_is_left_out(spark):
    assert QUERIES["normalize"](spark, SF).count() == 64 * view(spark, SF, "embeddings").count()
    assert QUERIES["patch_records"](spark, SF).count() == view(spark, SF, "det").count() + view(spark, SF, "gt").count()
    good = {r["image_id"] for r in view(spark, SF, "gt").collect() if (r["x1"] - r["x0"]) % 30 > 1 and (r["y1"] - r["y0"]) % 30 > 1}
    assert max(good) >= 20 and {r["id"] for r in QUERIES["drop_unannotated"](spark, SF).collect()} == good


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Orders four at a time with one upper left corner and different sizes, so that truths are contested and unions repeat."""
    r, path = random.Random(3), tmp_path_factory.mktemp("crowded")
    orders = []
    for base in r.sample(range(1, 8192), 60):
        cust, rank = r.randrange(100), r.choice(["1-URGENT", "2-HIGH"])
        # 8192 more keep the left side, 25 times 8192 the upper side and the image
        orders += [(base + 8192 * k, cust + 25 * 8192 * (-k % 3), rank, float(r.randrange(1000, 400000))) for k in range(4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return str(path)


def _iou(a, b):
    w, h = (min(a[f"{c}1"], b[f"{c}1"]) - max(a[f"{c}0"], b[f"{c}0"]) for c in "xy")
    shared = max(w, 0) * max(h, 0)
    size = lambda d: (d["x1"] - d["x0"]) * (d["y1"] - d["y0"])
    return shared / (size(a) + size(b) - shared)


def test_all_pairs_are_matched(spark, crowded):
    preds, truth = view(spark, crowded, "det").collect(), view(spark, crowded, "gt").collect()
    taken, matched = set(), {}
    for d in sorted(preds, key=lambda d: (-d["score"], d["id"])):
        free = [(-_iou(d, g), g["id"]) for g in truth if (g["image_id"], g["category_id"]) == (d["image_id"], d["category_id"]) and g["id"] not in taken]
        if free and -min(free)[0] >= 0.5:
            matched[d["id"]] = min(free)[1]
            taken.add(min(free)[1])
    got = {r["pred_id"]: r["gt_id"] for r in QUERIES["evaluate_images"](spark, crowded).collect()}
    assert got == matched and any(a != b for a, b in got.items())
    want = {}
    for c in {g["category_id"] for g in truth}:
        total, tp, curve = sum(g["category_id"] == c for g in truth), 0, []
        for n, d in enumerate(sorted((d for d in preds if d["category_id"] == c), key=lambda d: (-d["score"], d["id"])), 1):
            tp += d["id"] in matched
            curve.append((int(tp / total * 100 + 1e-9), tp / n))
        want[c] = sum(max((p for last, p in curve if last >= k), default=0) for k in range(101)) / 101
    got = {r["category_id"]: r["ap"] for r in QUERIES["average_precision"](spark, crowded).collect()}
    assert got == pytest.approx(want, abs=1e-6)
