"""Regions in lines of text and in Zeiss XML, and the choice of reader by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .geojson import DEFAULT_NAME, read_geojson_rois

_STEM = r"([^/]+?)(\.ome)?\.[^./]+$"


def parse_text_rois(lines: DataFrame, ds: float = 1) -> DataFrame:
    """Regions from ``value``: ``name#ignored#[x,..]_[y,..]``, or ``null#[x,..]_[y,..]`` without a name; other columns stay.

    Coordinates are divided by ``ds``. Lines named ``tile``, of four points or
    fewer, or that do not parse are left out.
    """
    parts = F.split("value", "#")
    nameless = parts[0] == "null"
    numbers = lambda text: F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double") / ds)
    axes = F.split(F.when(nameless, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))), "_")
    ring = F.transform(F.arrays_zip(numbers(F.get(axes, F.lit(0))).alias("x"), numbers(F.get(axes, F.lit(1))).alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = lines.withColumns({"name": F.when(nameless, DEFAULT_NAME).otherwise(parts[0]), "ring": ring}).drop("value")
    return rows.where((F.col("name") != "tile") & (F.size("ring") > 4) & ~F.exists("ring", lambda p: p["x"].isNull() | p["y"].isNull()))


def _shaped(rows: DataFrame, kind: str) -> DataFrame:
    b = G.ring_bounds(F.col("ring"))
    return rows.select("image_id", "roi_idx", "name", F.lit(kind).alias("type"), "ring", *[getattr(b, k).alias(k) for k in b._fields], G.ring_area(F.col("ring")).alias("area"))


def read_text_rois(spark: SparkSession, path: str, ds: float = 1) -> DataFrame:
    """Regions of text files; ``roi_idx`` is the line's number in its file."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), _STEM, 1).alias("image_id"), F.posexplode(F.split("value", r"\r?\n")).alias("roi_idx", "value"))
    return _shaped(parse_text_rois(files.where("value <> ''"), ds), "Polygon")


def read_cz_rois(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of Zeiss XML files; points are single precision, as in the files' own reader."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), _STEM, 1).alias("image_id"), "value")
    points = F.expr("xpath(value, '(//Elements)[1]/Polygon/Geometry/Points/text()')")
    # names are looked up by place, so a polygon without one shifts no other
    places = files.select("image_id", "value", F.posexplode(points).alias("roi_idx", "points"))
    named = places.withColumn("block", F.get(F.regexp_extract_all("value", F.lit(r"(?s)<Polygon\b.*?</Polygon>"), F.lit(0)), F.col("roi_idx")))
    name = F.nullif(F.regexp_extract("block", r"(?s)<Attributes>.*?<Name>(.*?)</Name>", 1), F.lit(""))
    pairs = F.transform(F.split(F.trim("points"), r"\s+"), lambda p: F.struct(F.split(p, ",")[0].cast("float").cast("double").alias("x"), F.split(p, ",")[1].cast("float").cast("double").alias("y")))
    return _shaped(named.select("image_id", "roi_idx", F.coalesce(name, F.lit(DEFAULT_NAME)).alias("name"), pairs.alias("ring")), "Polygon")


def import_annotations(spark: SparkSession, paths: list[str], ds: float = 1, offset: tuple[float, float] | None = None) -> DataFrame:
    """Regions of all files by their suffix: .cz, .json or .geojson, .txt; other files are passed over."""
    out = None
    for path in paths:
        suffix = path.rsplit(".", 1)[-1].lower()
        read = {"cz": lambda p: read_cz_rois(spark, p), "json": lambda p: read_geojson_rois(spark, p, ds, offset), "geojson": lambda p: read_geojson_rois(spark, p, ds, offset), "txt": lambda p: read_text_rois(spark, p, ds)}.get(suffix)
        if read is not None:
            out = read(path) if out is None else out.unionByName(read(path))
    if out is None:
        raise ValueError("no annotation file with a known suffix")
    return out
