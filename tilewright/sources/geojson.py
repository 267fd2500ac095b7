"""GeoJSON regions: reading with its ladder of shapes, and writing features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.ring_columns import joined_parts

# Fixed values of the format.
COLOUR = -3140401
DEFAULT_NAME, DEFAULT_TYPE = "unnamed", "Polygon"

_FEATURE = "struct<geometry:struct<type:string,coordinates:string>,properties:struct<classification:struct<name:string>>>"


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def parse_features(features: DataFrame, ds: float = 1, offset: tuple[float, float] | None = None, name: str = DEFAULT_NAME, kind: str = DEFAULT_TYPE) -> DataFrame:
    """Regions (image_id, roi_idx, name, type, ring, x0 .. area) from (image_id, roi_idx, json), one feature a row.

    The first ring of a polygon counts, and of several parts the largest; bare
    points are a ring; of parts that are no rings, the first two are grown by 1 and
    joined. Rings are scaled by 1 / ds about the origin, then moved
    by ``offset``. Features without a name get ``name``, those without usable
    coordinates are left out.
    """
    f = features.withColumn("f", F.from_json("json", _FEATURE))
    c = F.col("f.geometry.coordinates")
    one, many, bare = F.from_json(c, "array<array<array<double>>>"), F.from_json(c, "array<array<array<array<double>>>>"), F.from_json(c, "array<array<double>>")
    parts = F.array_sort(F.transform(many, lambda p: F.struct((-G.ring_area(_ring(p[0]))).alias("a"), _ring(p[0]).alias("r"))), lambda a, b: F.when(a["a"] < b["a"], -1).when(a["a"] > b["a"], 1).otherwise(0))
    good = lambda r: r.isNotNull() & (F.size(r) > 2) & ~F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull())
    first, largest, flat = _ring(F.try_element_at(one, F.lit(1))), F.try_element_at(parts, F.lit(1))["r"], _ring(bare)
    f = f.withColumns({"r1": first, "r2": largest, "r3": flat})
    ring = F.when(good(F.col("r1")), F.col("r1")).when(good(F.col("r2")), F.col("r2")).when(good(F.col("r3")), F.col("r3"))
    # the last rung: two parts of which neither is a ring by itself
    thin = F.when(ring.isNull(), F.transform(F.filter(many, lambda p: F.size(p[0]) > 0), lambda p: F.filter(_ring(p[0]), lambda q: q["x"].isNotNull() & q["y"].isNotNull())))
    ring = F.coalesce(ring, joined_parts(thin))
    dx, dy = offset or (0.0, 0.0)
    f = f.withColumn("ring", ring).where("ring is not null").withColumn("ring", G.ring_translate(G.ring_scale(F.col("ring"), 1 / ds), dx, dy))
    b = G.ring_bounds(F.col("ring"))
    return f.select("image_id", "roi_idx", F.coalesce("f.properties.classification.name", F.lit(name)).alias("name"), F.lit(kind).alias("type"), "ring", *[getattr(b, k).alias(k) for k in b._fields], G.ring_area(F.col("ring")).alias("area"))


def read_geojson_rois(spark: SparkSession, path: str, ds: float = 1, offset: tuple[float, float] | None = None) -> DataFrame:
    """Regions of GeoJSON files, each an array of features or one feature; ``image_id`` is the file's stem, ``roi_idx`` the place in it."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.ome)?\.[^./]+$", 1).alias("image_id"), F.trim("value").alias("value"))
    listed = F.from_json(F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), "array<string>")
    return parse_features(files.select("image_id", F.posexplode(listed).alias("roi_idx", "json")), ds, offset)


def to_feature(name: Column, score: Column, ring: Column, object_type: str = "annotation") -> Column:
    """A detection as the text of a GeoJSON feature; its ring is closed."""
    points = F.transform(G.ring_close(ring), lambda p: F.array(p["x"], p["y"]))
    classification = F.struct(name.alias("name"), F.lit(COLOUR).alias("colorRGB"))
    measured = F.array(F.struct(F.lit("detection_score").alias("name"), score.alias("value")))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry"),
        F.struct(classification.alias("classification"), F.lit(False).alias("isLocked"), measured.alias("measurements"), F.lit(object_type).alias("object_type")).alias("properties"),
    ))


def write_geojson(features: DataFrame, path: str, keys: tuple[str, ...] = ("image_id",), column: str = "feature") -> None:
    """Features as lines of text, one folder for each image; any number of tasks write at once."""
    features.select(*keys, F.col(column).alias("value")).write.partitionBy(*keys).mode("overwrite").text(path)
