"""Queries of the geometry functions and of region filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import regions as R
from .registry import register
from .views import view, with_views


def notched(b: G.Box) -> Column:
    """A box without a 6 by 5 notch at its far corner, as an open ring."""
    points = ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1 - 5), (b.x1 - 6, b.y1 - 5), (b.x1 - 6, b.y1), (b.x0, b.y1))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "det").withColumn("ring", notched(G.box()))


def _det(name: str, sql: str):
    return register(name, with_views(sql, "det"))


@_det("poly_area", "select id, cast((x1-x0)*(y1-y0) - 30 as double) as area from det")
def poly_area(spark, sf_dir):
    return _rings(spark, sf_dir).select("id", G.ring_area(F.col("ring")).alias("area"))


@_det("poly_bounds", "select id, cast(x0 as double) as bx0, cast(y0 as double) as by0, cast(x1 as double) as bx1, cast(y1 as double) as by1 from det")
def poly_bounds(spark, sf_dir):
    b = G.ring_bounds(F.col("ring"))
    return _rings(spark, sf_dir).select("id", b.x0.alias("bx0"), b.y0.alias("by0"), b.x1.alias("bx1"), b.y1.alias("by1"))


@_det("make_box", "select id, (x1-x0)*(y1-y0) as area, x0, y0, x1, y1 from det")
def make_box(spark, sf_dir):
    b = G.box()
    return view(spark, sf_dir, "det").select("id", b.area.alias("area"), *b._fields)


@_det("centroid", "select id, round(((x0+x1)/2.0*(x1-x0)*(y1-y0) - 30*(x1-3.0)) / ((x1-x0)*(y1-y0) - 30), 4) as cx, round(((y0+y1)/2.0*(x1-x0)*(y1-y0) - 30*(y1-2.5)) / ((x1-x0)*(y1-y0) - 30), 4) as cy from det")
def centroid(spark, sf_dir):
    x, y = G.ring_centroid(F.col("ring"))
    return _rings(spark, sf_dir).select("id", F.round(x, 4).alias("cx"), F.round(y, 4).alias("cy"))


@_det("poly_scale", "select id, x1 / 4.0 as sx, (y1 - 5) / 4.0 as sy from det")
def poly_scale(spark, sf_dir):
    p = G.ring_scale(F.col("ring"), 1 / 4)[2]
    return _rings(spark, sf_dir).select("id", p["x"].alias("sx"), p["y"].alias("sy"))


@_det("poly_translate", "select id, 7 as points, cast(x0 - 100 as double) as last_x, cast(y0 + 50 as double) as last_y from det")
def poly_translate(spark, sf_dir):
    ring = G.ring_to_slide(F.col("ring"), F.lit(-100), F.lit(50))
    return _rings(spark, sf_dir).select("id", F.size(ring).alias("points"), F.element_at(ring, -1)["x"].alias("last_x"), F.element_at(ring, -1)["y"].alias("last_y"))


@_det("ring_to_uint32", "select id, greatest(x0 - 4000, 0) as ux, greatest(y0 - 4000, 0) as uy from det")
def ring_to_uint32(spark, sf_dir):
    p = G.ring_to_uint32(G.ring_translate(F.col("ring"), -3999.5, -3999.5))[0]
    return _rings(spark, sf_dir).select("id", p["x"].alias("ux"), p["y"].alias("uy"))


@_det("ring_bbox", "select id, cast(0 as double) as bx0, cast(0 as double) as by0, cast(x1-x0 as double) as bx1, cast(y1-y0 as double) as by1 from det")
def ring_bbox(spark, sf_dir):
    b = G.ring_bounds(G.ring_translate(F.col("ring"), -F.col("x0"), -F.col("y0")))
    return _rings(spark, sf_dir).select("id", b.x0.alias("bx0"), b.y0.alias("by0"), b.x1.alias("bx1"), b.y1.alias("by1"))


@_det("xyxy_to_xywh", "select id, x0 as x, y0 as y, x1-x0 as w, y1-y0 as h from det")
def xyxy_to_xywh(spark, sf_dir):
    a = G.xyxy_to_xywh(G.box())
    return view(spark, sf_dir, "det").select("id", *[a[i].alias(c) for i, c in enumerate("xywh")])


@_det("tile_check", "select id, greatest(least(x1, x0//1024*1024+1024) - x0, 0) * greatest(least(y1, y0//1024*1024+1024) - y0, 0) * 2 >= 1024 as inside, greatest(least(x1, x0//1024*1024+1024) - x0, 0) * greatest(least(y1, y0//1024*1024+1024) - y0, 0) as shared from det")
def tile_check(spark, sf_dir):
    x, y = F.floor(F.col("x0") / 1024) * 1024, F.floor(F.col("y0") / 1024) * 1024
    shared = G.box_intersection(G.box(), G.Box(x, y, x + 1024, y + 1024))
    return view(spark, sf_dir, "det").select("id", (shared * 2 >= 1024).alias("inside"), shared.alias("shared"))


@_det("is_empty", "select id, x1 < 1024 or x0 > 2048 or y1 < 1024 or y0 > 2048 as empty from det")
def is_empty(spark, sf_dir):
    tile = G.Box(*[F.lit(v) for v in (1024, 1024, 2048, 2048)])
    return view(spark, sf_dir, "det").select("id", (~G.box_meets(G.box(), tile)).alias("empty"))


@_det("size_filter", "select id, (x1-x0)*(y1-y0) as area from det where (x1-x0)*(y1-y0) > 1500")
def size_filter(spark, sf_dir):
    b = G.box()
    return R.size_filter(view(spark, sf_dir, "det"), b.area, 1500).select("id", b.area.alias("area"))


@_det("exclude_names", "select id, class from det where class not in ('1-URGENT', '5-LOW')")
def exclude_names(spark, sf_dir):
    return R.exclude_names(view(spark, sf_dir, "det"), ["1-URGENT", "5-LOW"], "class").select("id", "class")


@_det("exclude_names_substring", "select id, class from det where instr('1-URGENT and 5-LOW', class) = 0")
def exclude_names_substring(spark, sf_dir):
    return R.exclude_names_within(view(spark, sf_dir, "det"), "1-URGENT and 5-LOW", "class").select("id", "class")


@_det("name_counts", "select class as name, count(*) as n from det group by class")
def name_counts(spark, sf_dir):
    return R.name_counts(view(spark, sf_dir, "det"), "class")


@register("annotation_tree", with_views("select class as name, count(*) as n from roi group by class", "roi"))
def annotation_tree(spark, sf_dir):
    return R.name_counts(view(spark, sf_dir, "roi"), "class")


@_det("class_index", "select class as name, cast(dense_rank() over (order by class) as int) as id from (select distinct class from det)")
def class_index(spark, sf_dir):
    return R.class_index(view(spark, sf_dir, "det"), "class", background=True)


@_det("reverse_class_map", "select cast(dense_rank() over (order by class) - 1 as int) as id, class as name from (select distinct class from det)")
def reverse_class_map(spark, sf_dir):
    index = R.class_index(view(spark, sf_dir, "det"), "class")
    one = index.agg(F.map_from_entries(F.collect_list(F.struct("name", "id"))).alias("m"))
    return one.select(F.explode(R.reverse_map(F.col("m"))).alias("id", "name"))


@_det("class_filter", "select id, score from det where category_id = 2")
def class_filter(spark, sf_dir):
    return R.of_class(view(spark, sf_dir, "det"), [2], "category_id").select("id", "score")


@_det("score_threshold", "select id, class from det where score > 150000")
def score_threshold(spark, sf_dir):
    return R.scored_above(view(spark, sf_dir, "det"), 150000).select("id", "class")


@_det("min_vertices", "select id from det where 4 + id % 20 >= 15")
def min_vertices(spark, sf_dir):
    ring = F.transform(F.expr("sequence(1L, 4 + id % 20)"), lambda k: F.struct(k.alias("x"), (k * k).alias("y")))
    return R.with_vertices(view(spark, sf_dir, "det").withColumn("ring", ring), 15).select("id")


@_det("get_train_area_offsets", "select image_id, x0//4 as min_x, x1//4 as max_x, y0//4 as min_y, y1//4 as max_y from (select *, row_number() over (partition by image_id order by id) as k from det where class = '3-MEDIUM') where k = 2")
def get_train_area_offsets(spark, sf_dir):
    return R.train_area_offsets(view(spark, sf_dir, "det").withColumnsRenamed({"class": "name", "id": "roi_idx"}), "3-MEDIUM", 4, 1)


@_det("get_n_train_areas", "select image_id, count(*) as n from det where class = '3-MEDIUM' group by image_id")
def get_n_train_areas(spark, sf_dir):
    return R.region_counts(view(spark, sf_dir, "det"), "3-MEDIUM", "class")


@_det("argmax_part", "select image_id, class, (x1-x0)*(y1-y0) as area, id as part from (select *, row_number() over (partition by image_id, class order by (x1-x0)*(y1-y0) desc, id) as k from det) where k = 1")
def argmax_part(spark, sf_dir):
    return R.largest_part(view(spark, sf_dir, "det"), ["image_id", "class"], G.box().area, F.col("id"))


@_det("first_by_name", "select class, min(id) as id, arg_min(x0, id) as x0 from det group by class")
def first_by_name(spark, sf_dir):
    return R.first_of_each(view(spark, sf_dir, "det"), ["class"], "id", ["x0"])


@_det("class_lookup", "select id, case category_id when 1 then 'urgent' when 2 then 'high' when 3 then 'medium' else 'rest' end as label from det")
def class_lookup(spark, sf_dir):
    label = R.class_names(F.col("category_id"), {1: "urgent", 2: "high", 3: "medium"}, "rest")
    return view(spark, sf_dir, "det").select("id", label.alias("label"))


@_det("class_histogram", "select image_id, class, count(*) as n from det group by image_id, class")
def class_histogram(spark, sf_dir):
    return R.class_histogram(view(spark, sf_dir, "det"), ["image_id"])


@register("hash_dedup", "select md5(text) as hash, min(doc_id) as first from documents where text is not null group by md5(text)")
def hash_dedup(spark, sf_dir):
    return R.hash_dedup(view(spark, sf_dir, "documents").where("text is not null"), F.col("text"), "doc_id")


@register("concat", with_views("select id, 'det' as origin from det union all select id, 'gt' as origin from gt", "det", "gt"))
def concat(spark, sf_dir):
    return R.concatenated({name: view(spark, sf_dir, name).select("id") for name in ("det", "gt")})


@register("set_intersect", "select doc_id from documents intersect select doc_id from labels")
def set_intersect(spark, sf_dir):
    return R.common(view(spark, sf_dir, "documents"), view(spark, sf_dir, "labels"), "doc_id")


@register("set_except", "select doc_id from documents except select doc_id from labels")
def set_except(spark, sf_dir):
    return R.missing(view(spark, sf_dir, "documents"), view(spark, sf_dir, "labels"), "doc_id")


@register("merge_unique", with_views("select image_id, min(id) as first from det group by image_id", "det"))
def merge_unique(spark, sf_dir):
    return R.first_of_each(view(spark, sf_dir, "det"), ["image_id"], "id").withColumnRenamed("id", "first")


@register("keyed_image_join", "select n_nationkey as image_id, s_suppkey, s_suppkey is not null as matched from nation left join supplier on s_nationkey = n_nationkey")
def keyed_image_join(spark, sf_dir):
    images = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"))
    return R.keyed_join(images, view(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image_id"), "s_suppkey"))


@register("semi_anti_images", with_views("select image_id, exists (select 1 from gt where gt.image_id = image.image_id and category_id = 1) as annotated from image", "det", "gt", "image"))
def semi_anti_images(spark, sf_dir):
    images, truth = view(spark, sf_dir, "image"), view(spark, sf_dir, "gt").where("category_id = 1")
    return R.annotated(images, truth).select("image_id", "annotated")
