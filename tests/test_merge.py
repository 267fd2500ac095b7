import os
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import polygon as P
from tilewright.graph import connected_components
from tilewright.operators import merge as M
from tilewright.plans.views import view

SF = "/root/testdata/sf0.01"


def _box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def _bars(order):
    bars = {"A": (0, 35, 0.9), "B": (30, 40, 0.6), "C": (38, 90, 0.8)}
    return [M.Piece([_box(bars[k][0], 0, bars[k][1], 10)], bars[k][2], [i]) for i, k in enumerate(order)]


def test_greedy_depends_on_order_and_is_not_transitive():
    first = M.greedy(_bars("ABC"), "rtree", 0.2, 0.2)[0]
    assert sorted((p.bounds[0], p.bounds[2], round(p.score, 6)) for p in first) == [(0, 40, 0.833333), (38, 90, 0.8)]
    second = M.greedy(_bars("BAC"), "rtree", 0.2, 0.2)[0]
    assert [(p.bounds[0], p.bounds[2], round(p.score, 6)) for p in second] == [(0, 90, 0.815464)]


def _by_cells(dets, variant, iou_threshold, part_threshold):
    """The work list on sets of unit cells: nothing of the library is used. dets: (id, score, (x0, y0, x1, y1)) in order; (members, score, area) of what is left."""
    queue = deque(({(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])}, b, s, [i]) for i, s, b in dets)
    done = []
    while queue:
        cells, box, score, ids = queue.popleft()
        near, rest = [], deque()
        for other in queue:
            c = other[1]
            shared = len(cells & other[0]) if box[0] < c[2] and c[0] < box[2] and box[1] < c[3] and c[1] < box[3] else 0
            n, m = len(cells), len(other[0])
            takes = 0 < shared < min(n, m) and shared / (n + m - shared) > iou_threshold
            if variant != "iou":
                takes = takes or (shared > 0 and (shared / n >= part_threshold or shared / m >= part_threshold))
            if variant == "centroid" and takes:
                mid = [[sum(p[k] + 0.5 for p in part) / len(part) for k in (0, 1)] for part in (cells, other[0])]
                takes = (mid[0][0] - mid[1][0]) ** 2 + (mid[0][1] - mid[1][1]) ** 2 <= 1000**2
            (near if takes else rest).append(other)
        queue = rest
        if not near:
            done.append((tuple(sorted(ids)), score, len(cells)))
            continue
        group = [(cells, box, score, ids), *near]
        whole = set().union(*[g[0] for g in group])
        if variant == "iou":
            score = sum(g[2] for g in group) / len(group)
        elif variant == "centroid":
            score = max(g[2] for g in group)
        else:
            score = sum(g[2] * len(g[0]) for g in group) / sum(len(g[0]) for g in group)
        boxes = [g[1] for g in group]
        queue.append((whole, (*(min(b[k] for b in boxes) for k in (0, 1)), *(max(b[k] for b in boxes) for k in (2, 3))), score, [i for g in group for i in g[3]]))
    return done


def _compare(got, want):
    got = {(r["class"], *r["key"], tuple(r["members"])): (r["score"], r["area"]) for r in got}
    assert set(got) == set(want)
    # the outer ring has no less than the cells: holes are filled
    assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-9) and got[k][1] >= want[k][1] - 1e-6 for k in want)
    return sum(got[k][1] > want[k][1] + 1e-6 for k in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("variant, threshold", [("iou", 0.3), ("centroid", 0.2), ("rtree", 0.2)])
def test_all_detections_against_unit_cells(spark, variant, threshold):
    dets = view(spark, SF, "det")
    groups = defaultdict(list)
    for d in sorted(dets.collect(), key=lambda d: d["id"]):
        groups[d["class"], d["image_id"]].append((d["id"], d["score"], (d["x0"], d["y0"], d["x1"], d["y1"])))
    want = {(*k, m): (s, n) for k, g in groups.items() for m, s, n in _by_cells(g, variant, threshold, 0.2)}
    assert sum(len(k[2]) > 1 for k in want) > 10
    merged = M.merge_detections(dets.withColumn("ring", G.ring_of(G.box())), ["image_id", "class"], variant, threshold, 0.2)
    _compare(merged.select("class", F.array("image_id").alias("key"), "members", "score", G.ring_area(F.col("ring")).alias("area")).collect(), want)


@pytest.mark.parametrize("variant", ["iou", "centroid", "rtree"])
def test_one_dense_component_over_many_blocks(spark, variant, monkeypatch):
    """Small blocks, so that chains cross them again and again; ids at random and along the rows."""
    monkeypatch.setattr(M, "A_BLOCK", 1)
    r = random.Random(6)
    rows = []
    for c, wide in (("a", 150), ("b", 400)):
        for i in range(260 if c == "a" else 420):
            x, y = (r.randrange(0, wide), r.randrange(0, wide)) if c == "a" else (i * 7, 10 + i % 3)
            rows.append((i, c, r.randrange(1, 100) / 100, (x, y, x + r.randrange(4, 12), y + r.randrange(4, 12))))
    df = spark.createDataFrame([(i, c, s, [tuple(p) for p in _box(*b).tolist()]) for i, c, s, b in rows], "id long, class string, score double, ring array<struct<x:double,y:double>>")
    got = M.merge_detections(df, ["class"], variant, 0.1, 0.15).select("class", F.array().cast("array<int>").alias("key"), "members", "score", G.ring_area(F.col("ring")).alias("area")).collect()
    want = {(c, m): (s, n) for c in "ab" for m, s, n in _by_cells([(i, s, b) for i, k, s, b in rows if k == c], variant, 0.1, 0.15)}
    _compare(got, want)


def test_unions_of_boxes_equal_the_overlay():
    r = random.Random(9)
    for _ in range(150):
        boxes = np.array([(x, y, x + r.randrange(1, 6), y + r.randrange(1, 6)) for x, y in ((r.randrange(8), r.randrange(8)) for _ in range(r.randrange(1, 6)))], float)
        cells = {(x, y) for b in boxes.astype(int).tolist() for x in range(b[0], b[2]) for y in range(b[1], b[3])}
        size, (mx, my) = P.boxes_measure(boxes)
        assert size == len(cells) and (mx, my) == pytest.approx((sum(x + 0.5 for x, _ in cells) / size, sum(y + 0.5 for _, y in cells) / size))
        rings = P.boxes_outline(boxes)
        assert P.area(rings) == len(cells) and all(P.is_valid(ring) for ring in rings)
        k = r.randrange(len(boxes) + 1)
        if 0 < k < len(boxes):
            parts = [{(x, y) for b in own.astype(int).tolist() for x in range(b[0], b[2]) for y in range(b[1], b[3])} for own in (boxes[:k], boxes[k:])]
            assert P.boxes_shared(boxes[:k], boxes[k:]) == len(parts[0] & parts[1])


def test_invalid_rings_are_dropped(spark):
    df = spark.createDataFrame([(1, "a", 0.5, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]), (2, "a", 0.5, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0)]), (3, "a", 0.1, None)], "id long, class string, score double, ring array<struct<x:double,y:double>>")
    assert [x["members"] for x in M.merge_detections(df, ["class"]).collect()] == [[2]]


def test_components_match_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = {}
    for a, b in edges:
        if a is not None and a != b:
            name.setdefault(a, a)
            name.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in name and b in name and name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    assert got == name
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_of_boxes_are_linked_without_their_pairs(spark, monkeypatch):
    """Heaps and strings of boxes over several cells and strips, some only touching: the components of all pairs, from fewer links than boxes in cells."""
    import random

    from tilewright.operators import spatial_join as S

    r = random.Random(6)
    rows = [(i, "a", x, y, x + r.randrange(0, 40), y + r.randrange(0, 40)) for i in range(400) for x, y in ((r.randrange(-100, 700), r.randrange(-100, 700)),)]
    rows += [(1000 + i, "b", 5, 5 + i % 3, 30, 30) for i in range(120)] + [(2000 + i, "c", 20 * i, 64, 20 * i + 20, 64) for i in range(30)] + [(3000, None, 0, 0, 9, 9), (3001, None, 0, 0, 9, 9), (3002, "a", None, 0, 9, 9)]
    boxes = spark.createDataFrame(rows, "id long, class string, x0 long, y0 long, x1 long, y1 long")
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 50)
    links = S.meeting_chains(boxes, 128, keys=["class"])
    pairs = S.box_self_join(boxes, 64, keys=["class"]).select("l_id", "r_id")
    got, want = ({tuple(x) for x in connected_components(df, *df.columns).collect()} for df in (links, pairs))
    assert got == want and len({c for _, c in want}) > 20
    assert links.where("i >= 1000 and i < 2000").count() == 119 and pairs.where("l_id >= 1000 and l_id < 2000").count() == 119 * 60


def test_near_centres_are_dealt_to_half_the_cells_around(spark):
    import random

    from tilewright.operators import spatial_join as S

    r = random.Random(9)
    rows = [(i, i % 2, x, y, x + 4, y + 6) for i in range(300) for x, y in ((r.randrange(-90, 90), r.randrange(-90, 90)),)]
    boxes = spark.createDataFrame(rows, "id long, class int, x0 long, y0 long, x1 long, y1 long")
    want = sorted((a[0], b[0], 4 * ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 400)
    near = S.centroid_pairs(boxes, 20, keys=["class"])
    assert sorted(map(tuple, near.collect())) == want and len(want) > 300
