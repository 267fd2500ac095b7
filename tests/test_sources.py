import gzip
import json

import numpy as np
import pytest

from tilewright.functions import geometry as G
from tilewright.operators import raster, tiling
from tilewright.sources import coco, config, geojson, images, text_rois
from tilewright.streaming import annotations

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
SMALL = [[20, 20], [24, 20], [24, 24], [20, 24], [20, 20]]


def _feature(coordinates, kind="Polygon", name=None):
    properties = {"classification": {"name": name}} if name else {}
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


def test_geojson_ladder_scale_and_offset(spark, tmp_path):
    features = [_feature([SQUARE, SMALL], name="a"), _feature([[SMALL], [SQUARE]], "MultiPolygon"), _feature(SQUARE, "LineString"), _feature([], name="none")]
    (tmp_path / "slide.ome.json").write_text(json.dumps(features))
    (tmp_path / "one.geojson").write_text(json.dumps(features[0]))
    rows = geojson.read_geojson_rois(spark, str(tmp_path), 2, (100, 0)).orderBy("image_id", "roi_idx").collect()
    assert [(r["image_id"], r["roi_idx"], r["name"], r["area"], r["x0"]) for r in rows] == [("one", 0, "a", 25.0, 100.0), ("slide", 0, "a", 25.0, 100.0), ("slide", 1, "unnamed", 25.0, 100.0), ("slide", 2, "unnamed", 25.0, 100.0)]


def test_text_and_xml_regions_and_dispatch(spark, tmp_path):
    (tmp_path / "s.txt").write_text("roi#x#[0,4,4,0,0]_[0,0,4,4,0]\nnull#[0, 8,8,0,0]_[0,0,8,8,0]\ntile#x#[0,4,4,0,0]_[0,0,4,4,0]\nfew#x#[0,1,1]_[0,0,1]\nbroken\n")
    point = lambda p: " ".join(f"{x},{y}" for x, y in p)
    polygons = "".join(f"<Polygon><Geometry><Points>{point(p)}</Points></Geometry><Attributes>{n}</Attributes></Polygon>" for p, n in ((SQUARE, ""), (SMALL, "<Name>n</Name>")))
    (tmp_path / "z.cz").write_text(f"<Document><Elements><Rectangle/>{polygons}</Elements></Document>")
    (tmp_path / "g.json").write_text(json.dumps([_feature([SQUARE])]))
    rows = text_rois.import_annotations(spark, [f"{tmp_path}/{f}" for f in ("s.txt", "z.cz", "g.json", "other.bin")], ds=2).collect()
    assert sorted((r["image_id"], r["name"], r["area"]) for r in rows) == [("g", "unnamed", 25.0), ("s", "roi", 4.0), ("s", "unnamed", 16.0), ("z", "n", 16.0), ("z", "unnamed", 100.0)]
    with pytest.raises(ValueError):
        text_rois.import_annotations(spark, ["x.bin"])


def test_geojson_is_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("i", "n", 0.5, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])], "image_id string, name string, score double, ring array<struct<x:double,y:double>>")
    out = rows.select("image_id", geojson.to_feature(rows["name"], rows["score"], rows["ring"], "detection").alias("feature"))
    geojson.write_geojson(out, f"{tmp_path}/out")
    back = json.loads(spark.read.text(f"{tmp_path}/out").first()["value"])
    assert back["geometry"]["coordinates"][0][0] == back["geometry"]["coordinates"][0][-1] == [0, 0]
    assert back["properties"]["classification"] == {"name": "n", "colorRGB": -3140401} and back["properties"]["object_type"] == "detection"


@pytest.mark.parametrize("packed", [False, True])
def test_zarr_chunks_crop_and_predict(spark, tmp_path, packed):
    image = np.zeros((1, 90, 120), np.uint8)
    image[0, 20:60, 30:80] = 200
    path = tmp_path / "slide.zarr" / "0"
    path.mkdir(parents=True)
    codecs = [{"name": "bytes"}, {"name": "gzip"}] if packed else [{"name": "bytes"}]
    (path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [1, 90, 120], "data_type": "uint8", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 32, 32]}}, "codecs": codecs}))
    (path.parent / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
    for j in range(3):
        for i in range(4):
            block = np.zeros((1, 32, 32), np.uint8)
            part = image[:, j * 32 : j * 32 + 32, i * 32 : i * 32 + 32]
            block[:, : part.shape[1], : part.shape[2]] = part
            if block.any():
                (path / f"c/0/{j}").mkdir(parents=True, exist_ok=True)
                (path / f"c/0/{j}/{i}").write_bytes(gzip.compress(block.tobytes()) if packed else block.tobytes())
    row = images.zarr_images(spark, str(tmp_path / "slide.zarr"), "s").first()
    assert (row["level"], row["channels"], row["height"], row["width"], row["dtype"]) == (0, 1, 90, 120, "uint8")
    tiles = tiling.tile_overlap(spark.createDataFrame([("s", 120, 90)], "image_id string, width long, height long"), tile_size=64).select("image_id", "x0", "y0", "x1", "y1")
    cut = images.crop(images.zarr_chunks(spark, str(path), "s"), tiles, 32)
    for t in cut.collect():
        assert (np.frombuffer(t["data"], np.uint8).reshape(1, t["y1"] - t["y0"], t["x1"] - t["x0"]) == image[:, t["y0"] : t["y1"], t["x0"] : t["x1"]]).all()
    found = raster.predict(cut, raster.threshold_model(100), least_points=3).withColumn("area", G.ring_area(raster.F.col("ring"))).collect()
    assert found and max(r["area"] for r in found) <= 40 * 50 and images.placeholder(spark, "p").count() == 1


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "height": 5, "width": 6, "file_name": "f"}], "categories": [{"id": 3, "name": "c"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    pictures, categories, notes = coco.read_coco(spark, str(tmp_path / "c.json"))
    r = notes.first()
    assert (r["x"], r["y"], r["w"], r["h"]) == (1, 2, 3, 4)
    coco.write_coco(pictures, categories, notes, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/annotations")).count() == 1


def test_config_honours_zero_and_checks_lengths():
    c = config.from_mapping({"test_images": ["a"], "model_path": ["m", "n"], "prediction_class": ["x", "y"], "threshold": 0, "tile_overlap": 0, "unknown": 1, "train_channels": [0, 2]})
    assert c.threshold == [0, 0] and c.tile_overlap == 0 and c.tile_size == 1024 and c.tissue_rois == [None] and c.n_channels == 2
    with pytest.raises(ValueError):
        config.from_mapping({"test_images": ["a"], "model_path": ["m"], "prediction_class": ["x", "y"]})
    with pytest.raises(ValueError):
        config.from_mapping({"test_images": ["a", "b"], "model_path": "m", "prediction_class": "x", "tissue_rois": ["t"]})


def test_features_stream_into_regions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s1.json").write_text("\n".join(json.dumps(_feature([r], name="n")) for r in (SQUARE, SMALL)))
    for _ in range(2):
        annotations.write_regions(annotations.feature_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    (tmp_path / "in/s2.json").write_text(json.dumps(_feature([SMALL])))
    annotations.write_regions(annotations.feature_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    counted = annotations.region_counts(spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r["image_id"], r["name"], r["n"], r["area"]) for r in counted.collect()) == [("s1", "n", 2, 116.0), ("s2", "unnamed", 1, 16.0)]
