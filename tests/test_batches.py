"""Batches of one group each against a loop over the stream."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import sampling as S


def _loop(rows, size):
    """rows: (order, key) in order; the batches as lists of orders."""
    buffers, seen, out = {}, {}, []
    for order, key in rows:
        buffers.setdefault(key, []).append(order)
        seen.setdefault(key, []).append(order)
        if len(buffers[key]) == size:
            out.append(buffers.pop(key))
    for key in sorted(buffers, key=lambda k: -len(buffers[k])):
        if len(out) == len(rows) // size:
            break
        own = buffers[key]
        while len(own) < size:
            own = own + seen[key][: size - len(own)]
        out.append(own)
    return out


@pytest.mark.parametrize("n, size, groups", [(300, 7, 9), (100, 30, 3), (50, 64, 4), (64, 1, 5), (90, 8, 40)])
def test_batches_match_a_loop(spark, n, size, groups):
    r = random.Random(n)
    # a third of all rows in one group, one group without a name
    rows = [(3 * i, "hot" if r.random() < 0.3 else None if r.random() < 0.1 else f"g{r.randrange(groups)}") for i in range(n)]
    df = spark.createDataFrame(r.sample(rows, n), "at long, kind string").repartition(5)
    got = {}
    for row in S.grouped_batches(df, "at", "kind", size).collect():
        assert got.setdefault(row["batch"], {}).setdefault(row["place"], row["at"]) == row["at"]
    want = _loop(rows, size)
    assert [[got[b][k] for k in sorted(got[b])] for b in sorted(got)] == want and sorted(got) == list(range(len(want)))


def test_no_rows(spark):
    assert S.grouped_batches(spark.createDataFrame([], "at long, kind string"), "at", "kind", 4).withColumn("x", F.lit(1)).collect() == []


def test_runs_over_bands(spark, monkeypatch):
    """Runs of an image over bands of rows, some without a change inside, some missing."""
    from tilewright.operators import raster

    monkeypatch.setattr(raster, "BAND", 2)
    r = random.Random(2)
    images = {"a": [[0] * 5] * 9, "b": [[int(r.random() < 0.5) for _ in range(5)] for _ in range(11)], "c": [[1] * 5] * 3 + [[0, 1, 1, 1, 1]] + [[1] * 5] * 6, None: [[1, 0, 1, 0, 1]] * 3}
    rows = [(k, y, x, v) for k, image in images.items() for y, line in enumerate(image) for x, v in enumerate(line)]
    got = raster.rle(spark.createDataFrame(rows, "k string, y int, x int, v int").repartition(7), ["k"], 5, F.col("v") == 1).collect()
    for k, image in images.items():
        want, flat = [], [v for line in image for v in line]
        for i, v in enumerate(flat):
            if not want or want[-1][2] != v:
                want.append([i, 0, v])
            want[-1][1] += 1
        assert [[x["start"], x["length"], x["bit"]] for x in sorted((x for x in got if x["k"] == k), key=lambda x: x["run"])] == want
        assert sorted(x["run"] for x in got if x["k"] == k) == list(range(len(want)))
