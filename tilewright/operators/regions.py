"""Filters and summaries of regions and detections: (.., name, x0, y0, x1, y1[, ring])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size_filter(df: DataFrame, area: Column, size: float) -> DataFrame:
    """Rows whose area is strictly above ``size``."""
    return df.where(area > size)


def exclude_names(df: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Rows of other names; equality, never part of a name. Rows without a name stay."""
    return df.where(~F.coalesce(F.col(column).isin(names), F.lit(False))) if names else df


def exclude_names_within(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Rows whose name is not a part of ``text``, for those who rely on that older reading."""
    return df.where(F.instr(F.lit(text), F.col(column)) == 0)


def name_counts(df: DataFrame, column: str = "name") -> DataFrame:
    """(name, n) in order of the names."""
    return df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).orderBy("name")


def class_index(df: DataFrame, column: str = "name", background: bool = False) -> DataFrame:
    """(name, id): ids by sorted name from 0, or from 1 with a background class.

    Only the distinct names are ordered together.
    """
    names = df.select(F.col(column).alias("name")).where("name is not null").distinct()
    return names.select("name", (F.dense_rank().over(Window.orderBy("name")) - 1 + int(background)).alias("id"))


def reverse_map(classes: Column) -> Column:
    """A map turned round."""
    return F.map_from_entries(F.transform(F.map_entries(classes), lambda e: F.struct(e["value"], e["key"])))


def nth_region(df: DataFrame, name: str, index: int, order: str = "roi_idx", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The region at ``index`` (from 0) among those of a name, for each image."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.where(F.col("name") == name).withColumn("__k", rank).where(F.col("__k") == index + 1).drop("__k")


def train_area_offsets(df: DataFrame, name: str, downsampling: float = 1, index: int = 0) -> DataFrame:
    """(image_id, min_x, max_x, min_y, max_y) of a training area, over ``downsampling`` and cut to whole numbers."""
    cut = lambda c: (F.col(c) / downsampling).cast("bigint")
    return nth_region(df, name, index).select("image_id", cut("x0").alias("min_x"), cut("x1").alias("max_x"), cut("y0").alias("min_y"), cut("y1").alias("max_y"))


def keyed_join(images: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Images with their annotations by key; ``matched`` tells images that have none, and no pair is made by position."""
    return images.join(annotations.withColumn("__has", F.lit(True)), key, "left").withColumn("matched", F.coalesce("__has", F.lit(False))).drop("__has")


def largest_part(df: DataFrame, keys: list[str], area: Column, value: Column) -> DataFrame:
    """The value at the largest area of each key; ties by the smaller value."""
    best = F.max(F.struct(area.alias("a"), (-value).alias("v")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.a").alias("area"), (-F.col("b.v")).alias("part"))


def hash_dedup(df: DataFrame, value: Column, order: str) -> DataFrame:
    """(hash, first): one row for each MD5 of ``value``, with the smallest ``order``."""
    return df.groupBy(F.md5(value).alias("hash")).agg(F.min(order).alias("first"))


def of_class(df: DataFrame, classes: list, column: str = "class") -> DataFrame:
    """Rows of the listed classes."""
    return df.where(F.col(column).isin(classes))


def scored_above(df: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    """Rows whose score is strictly above ``threshold``; rows without a score go."""
    return df.where(F.col(column) > threshold)


def with_vertices(df: DataFrame, least: int, ring: str = "ring") -> DataFrame:
    """Rows whose ring has at least ``least`` points; rows without a ring go."""
    return df.where(F.size(ring) >= least)


def region_counts(df: DataFrame, name: str, column: str = "name", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys.., n): how many regions of a name each image has; images without one have no row."""
    return df.where(F.col(column) == name).groupBy(*keys).agg(F.count("*").alias("n"))


def first_of_each(df: DataFrame, keys: list[str], order: str, columns: list[str] = ()) -> DataFrame:
    """(keys.., order, columns..): the row of the smallest ``order`` of each key; minima combine map-side."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in columns])


def class_names(column: Column, names: dict, default: str) -> Column:
    """The name of a class id, ``default`` for one that is not listed."""
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(F.try_element_at(known, column), F.lit(default))


def class_histogram(df: DataFrame, keys: list[str], column: str = "class") -> DataFrame:
    """(keys.., class, n)."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def concatenated(tables: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """All rows of the tables, each with the name of its table."""
    named = [df.withColumn(origin, F.lit(name)) for name, df in tables.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have, each once."""
    return left.select(key).intersect(right.select(key))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks, each once."""
    return left.select(key).subtract(right.select(key))


def annotated(images: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Images with ``annotated``: whether any annotation has their key."""
    held = annotations.select(key, F.lit(True).alias("annotated")).distinct()
    return images.join(held, key, "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))
