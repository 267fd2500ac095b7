"""GeoJSON arrays filled by many tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tilewright.sources import geojson_files as W


def _features(spark, n=700):
    rows = [(f"s{i % 3}" if i % 5 else "hot", i, None if i == 8 else json.dumps({"type": "Feature", "id": i, "name": "é" * (i % 40)}, ensure_ascii=False)) for i in range(n)]
    rows += [("hot", 3, json.dumps({"again": k})) for k in (1, 1, 2)] + [("one", 0, '{"id": 5}')]
    return rows, spark.createDataFrame(rows, "image_id string, n int, feature string").repartition(13)


def test_files_are_arrays_in_order(spark, tmp_path, monkeypatch):
    rows, df = _features(spark)
    for _ in range(2):
        W.write_geojson_arrays(df, str(tmp_path), "cells", 0.25, order=("n",))
    names = {s: f"{s}-cells-thresh-0.25.json" for s in ("s0", "s1", "s2", "hot", "one")}
    assert sorted(os.listdir(tmp_path)) == sorted(names.values())
    for stem, name in names.items():
        own = sorted((n, text) for s, n, text in rows if s == stem and text is not None)
        assert json.loads((tmp_path / name).read_text()) == [json.loads(text) for _, text in own]


def test_places_follow_each_other(spark):
    _, df = _features(spark)
    rows = W.placed(df.where("feature is not null"), F.col("image_id"), [F.col("n"), F.col("feature")]).collect()
    for name in {r["name"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["name"] == name), key=lambda r: r["at"]):
            assert r["at"] == at
            at += len(r["value"].encode())
        assert at == r["total"]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    _, df = _features(spark)
    broken = df.withColumn("feature", F.when(F.col("n") == 650, F.raise_error(F.lit("lost"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="lost"):
        W.write_geojson_arrays(broken, str(tmp_path / "a"), order=("n",))
    assert not (tmp_path / "a").exists() or os.listdir(tmp_path / "a") == []
    # a file that lacks a part is taken back
    writer = W.ArrayWriter({"path": str(tmp_path / "b"), "job": "j"})
    done = writer.write(iter([W.Row(name="x.json", at=0, total=9, value="[1,")]))
    with pytest.raises(RuntimeError, match="not whole"):
        writer.commit([done, None])
    assert os.listdir(tmp_path / "b") == []
