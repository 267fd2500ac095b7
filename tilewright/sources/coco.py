"""COCO tables from and to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """images array<struct<id:bigint,height:bigint,width:bigint,file_name:string>>, categories array<struct<id:bigint,name:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int,segmentation:array<array<double>>,keypoints:array<double>,num_keypoints:int>>"""


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of COCO files; boxes also as x, y, w, h."""
    doc = spark.read.schema(_SCHEMA).json(path, multiLine=True)
    images, categories, notes = (doc.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "categories", "annotations"))
    return images, categories, notes.withColumns({k: F.get("bbox", F.lit(i)) for i, k in enumerate("xywh")})


def write_coco(images: DataFrame, categories: DataFrame, annotations: DataFrame, path: str) -> None:
    """The three tables as folders of JSON lines under ``path``, written by any number of tasks."""
    for name, df in (("images", images), ("categories", categories), ("annotations", annotations)):
        df.write.mode("overwrite").json(f"{path}/{name}")
