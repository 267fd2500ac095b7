"""A stream of GeoJSON features, one a line, merged batch by batch into a table of regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.geojson import parse_features


def feature_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """Features from a folder that files are added to: (image_id, roi_idx, json); the index is a hash of the feature."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path).where("value <> ''")
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]+$", 1).alias("image_id"), F.xxhash64("value").alias("roi_idx"), F.col("value").alias("json"))


def region_counts(regions: DataFrame) -> DataFrame:
    """Running counts and areas of a stream of regions by image and name."""
    return regions.groupBy("image_id", "name").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def write_regions(features: DataFrame, target: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write every batch's regions as Parquet under its batch number, so a batch run again replaces itself; ends when the folder is read."""

    def run(batch: DataFrame, number: int) -> None:
        regions = parse_features(batch)
        (then(regions) if then else regions).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return features.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
