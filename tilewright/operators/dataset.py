"""Training records and COCO tables from tiles, regions and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, ring_bounds, ring_translate, xyxy_to_xywh
from ..storage import materialize, small_enough
from .sampling import running_counts, train_val_split, with_negatives


def _ids(classes: DataFrame, column: str, shift: int = 0) -> DataFrame:
    """(class, column): the classes' ids; broadcast if a count shows them to be few."""
    ids = materialize(classes.select(F.col("name").alias("class"), (F.col("id") + shift).alias(column)), "classes")
    return F.broadcast(ids) if small_enough(ids.count(), 200) else ids


def local_annotations(records: DataFrame) -> DataFrame:
    """One row per region of a tile, in the tile's coordinates: adds ``local`` (ring) and bx0 .. by1, its bounding box."""
    local = records.withColumn("local", ring_translate(F.col("ring"), -F.col("tx0"), -F.col("ty0")))
    b = ring_bounds(F.col("local"))
    return local.withColumns({"bx0": b.x0, "by0": b.y0, "bx1": b.x1, "by1": b.y1})


def instance_records(records: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes, labels (background is 0), the area of the box and iscrowd, one row per region; a class that is not listed has a null label."""
    area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    return local_annotations(records).join(_ids(classes, "label", 1), "class", "left").withColumns({"box_area": area, "iscrowd": F.lit(0)})


def detectron_records(records: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes, flattened segmentation and category (no background), one row per region; height and width are the tile's own.

    A class that is not listed has a null category.
    """
    flat = F.flatten(F.transform("local", lambda p: F.array(p["x"], p["y"])))
    return local_annotations(records).join(_ids(classes, "category_id"), "class", "left").withColumns({"segmentation": flat, "height": F.col("ty1") - F.col("ty0"), "width": F.col("tx1") - F.col("tx0")})


def patch_records(patches: DataFrame, classes: DataFrame) -> DataFrame:
    """A patch's one class as an id from 0, one row per patch; null for a class that is not listed. Sets of records are joined by ``unionByName``."""
    return patches.join(_ids(classes, "class_id"), "class", "left")


def to_coco(annotations: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, categories, annotations): boxes as x, y, width, height; annotation ids from 1 in ``order``.

    Ids run on over images, put together from ranges of images and ``order``, so
    no task numbers them all.
    """
    images = annotations.groupBy("image_id").agg(F.count("*").alias("n"))
    categories = annotations.select(F.col("class_id").alias("id")).distinct().orderBy("id")
    b = box()
    rows = running_counts(annotations, [], [F.col("image_id"), *[F.col(c) for c in order]], {"ann_id": F.lit(1)})
    w, h = b.x1 - b.x0, b.y1 - b.y0
    rows = rows.select("ann_id", "image_id", F.col("class_id").alias("category_id"), b.x0.alias("x"), b.y0.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
    return images.select(F.col("image_id").alias("id")), categories, rows


def annotation_index(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id, ann_ids) and (category_id, image_ids): the annotations of each image, the images of each category, in order.

    An image's ids, and a category's images, are one row each.
    """
    of_image = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list("id")).alias("ann_ids"))
    of_category = annotations.select("category_id", "image_id").distinct().groupBy("category_id").agg(F.sort_array(F.collect_list("image_id")).alias("image_ids"))
    return of_image, of_category


def find_annotations(annotations: DataFrame, images: list | None = None, categories: list | None = None, area: tuple[float, float] | None = None, crowd: bool | None = None) -> DataFrame:
    """Annotations of the listed images and categories, with an area strictly between two values, crowds or not; None asks for any."""
    for column, wanted in (("image_id", images), ("category_id", categories)):
        annotations = annotations.where(F.col(column).isin(wanted)) if wanted is not None else annotations
    annotations = annotations.where((F.col("area") > area[0]) & (F.col("area") < area[1])) if area is not None else annotations
    return annotations.where(F.col("iscrowd") == int(crowd)) if crowd is not None else annotations


def coco_results(predictions: DataFrame) -> DataFrame:
    """One row per object from arrays of boxes, scores and labels of an image."""
    each = predictions.select("image_id", F.explode(F.arrays_zip("boxes", "scores", "labels")).alias("o"))
    b = lambda k: F.col("o.boxes")[k]
    return each.select("image_id", F.col("o.labels").alias("category_id"), F.col("o.scores").alias("score"), b(0).alias("x"), b(1).alias("y"), (b(2) - b(0)).alias("w"), (b(3) - b(1)).alias("h"))


def load_results(results: DataFrame, order: list[str]) -> DataFrame:
    """Result boxes with area and a rectangle as segmentation, and ids from 1 within an image."""
    x, y, w, h = (F.col(c) for c in "xywh")
    return results.withColumns({"area": w * h, "segmentation": F.array(x, y, x, y + h, x + w, y + h, x + w, y), "id": F.row_number().over(Window.partitionBy("image_id").orderBy(*order))})


def category_filter(annotations: DataFrame, categories: list[int], remap: bool = True) -> DataFrame:
    """Annotations of the listed categories; with ``remap``, ids become places in the list."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category_id")) - 1
    kept = annotations.where(F.col("category_id").isin(categories))
    return kept.withColumn("category_id", place) if remap else kept


def drop_unannotated(images: DataFrame, annotations: DataFrame, least_keypoints: int = 10) -> DataFrame:
    """Images with at least one annotation whose sides are both above 1.

    Where annotations have ``keypoints`` (x, y, visibility by turns), an image
    must also show ``least_keypoints`` visible ones in all.
    """
    kept = F.max(((F.col("w") > 1) & (F.col("h") > 1)).cast("int")) == 1
    if "keypoints" in annotations.columns:
        seen = F.size(F.filter(F.coalesce("keypoints", F.array().cast("array<int>")), lambda v, i: (i % 3 == 2) & (v > 0)))
        kept = kept & (F.sum(seen) >= least_keypoints)
    good = annotations.groupBy("image_id").agg(kept.alias("good")).where("good")
    return images.join(good, images["id"] == good["image_id"], "left_semi")


def clean_boxes(annotations: DataFrame, width: Column, height: Column) -> DataFrame:
    """No crowds; boxes as corners clamped to the image, those without an inside dropped."""
    cut = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    out = annotations.where("iscrowd = 0").withColumns({"x0": cut(F.col("x"), width), "y0": cut(F.col("y"), height), "x1": cut(F.col("x") + F.col("w"), width), "y1": cut(F.col("y") + F.col("h"), height)})
    return out.where("x1 > x0 and y1 > y0")


def flip_horizontal(df: DataFrame, width: Column) -> DataFrame:
    """Boxes mirrored left to right, and with them ``runs`` of a mask and ``keypoints`` (x, y, visibility by turns) where there are such columns.

    Keypoints that are not visible become 0.
    """
    mirrored = {"x0": width - F.col("x1"), "x1": width - F.col("x0")}
    if "runs" in df.columns:
        mirrored["runs"] = F.transform("runs", lambda r: F.struct(r["y"].alias("y"), (width - r["x1"]).cast("int").alias("x0"), (width - r["x0"]).cast("int").alias("x1")))
    if "keypoints" in df.columns:
        seen = lambda i: F.get("keypoints", (F.floor(i / 3) * 3 + 2).cast("int")) > 0
        mirrored["keypoints"] = F.transform("keypoints", lambda v, i: F.when(~seen(i), 0).when(i % 3 == 0, width - v).otherwise(v))
    return df.withColumns(mirrored)


#: The eight right-angled moves of a square, as (turns by 90 degrees, mirrored).
MOVES = tuple((turns, mirror) for mirror in (False, True) for turns in range(4))


def augment_ring(ring: Column, move: tuple[int, bool], size: int = 1024) -> Column:
    """A ring in a square tile after one of ``MOVES``; points are first clamped to [1, size - 1]. Each point is moved at once, so that a ring is gone through once."""
    turns, mirror = move
    inside = lambda v: F.least(F.greatest(v, F.lit(1)), F.lit(size - 1))

    def moved(p: Column) -> Column:
        x, y = inside(p["x"]), inside(p["y"])
        x = size - x if mirror else x
        for _ in range(turns):
            x, y = y, size - x
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


def bbox_column() -> Column:
    """The box columns as COCO's x, y, width, height."""
    return xyxy_to_xywh(box())


def training_set(joined: DataFrame, empty: DataFrame, tile_columns: list[str], classes: DataFrame, neg_proportion: float = 0.5, train_share: float = 0.95, seed: str = "") -> DataFrame:
    """One record per tile with ``split``: (tile columns, rois: array<struct<roi_idx, class, label, clip_area>>, split).

    ``joined`` are tiles joined to regions, ``empty`` tiles without any; of
    these, ceil(``neg_proportion`` * n) are drawn by hash for n tiles with
    regions. Labels count classes by name from 1, 0 being the background.
    """
    known = joined.join(_ids(classes, "label", 1), "class", "left")
    records = known.groupBy(*tile_columns).agg(F.array_sort(F.collect_list(F.struct("roi_idx", "class", F.col("label").cast("long").alias("label"), F.col("clip_area").cast("double").alias("clip_area")))).alias("rois"))
    none = F.expr("cast(array() as array<struct<roi_idx:bigint,class:string,label:bigint,clip_area:double>>)")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in tile_columns]))
    drawn = with_negatives(records.withColumn("__key", key), empty.select(*tile_columns, none.alias("rois")).withColumn("__key", key), "__key", neg_proportion)
    return train_val_split(drawn, "__key", train_share, seed).drop("__key")
