"""Queries of sampling, rasters, records and evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..operators import dataset as D
from ..operators import evaluate as E
from ..operators import masks as K
from ..operators import raster as P
from ..operators import regions as R
from ..operators import sampling as S
from ..operators import training as TR
from ..sources.geojson import to_feature
from ..sources.text_rois import parse_text_rois
from .registry import ORACLES, register
from .views import view, with_views


def _det(name: str, sql: str):
    return register(name, with_views(sql, "det"))


def _gt(name: str, sql: str):
    return register(name, with_views(sql, "det", "gt"))


@register("train_val_split", "select doc_id, case when row_number() over (order by md5('s' || doc_id), doc_id) <= floor(0.95 * count(*) over ()) then 'train' else 'val' end as split from documents")
def train_val_split(spark, sf_dir):
    return S.train_val_split(view(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.95, "s")


@register("split_counts", "with r as (select row_number() over (order by md5('' || doc_id), doc_id) <= floor(0.95 * count(*) over ()) as t from documents) select count(*) filter (where t) as train, count(*) filter (where not t) as val, cast(ceil(0.5 * count(*) filter (where t)) as bigint) as negatives from r")
def split_counts(spark, sf_dir):
    split = S.train_val_split(view(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    train = F.count_if(F.col("split") == "train")
    return split.agg(train.alias("train"), F.count_if(F.col("split") == "val").alias("val"), F.ceil(train * 0.5).alias("negatives"))


@register("batch_ranges", "select doc_id, (row_number() over (partition by source order by doc_id) - 1) // 12 as batch from documents")
def batch_ranges(spark, sf_dir):
    return S.batches(view(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 12, ["source"]).select("doc_id", "batch")


@register("grouped_batches", "select b as bin, batch, count(*) as n, min(doc_id) as first from (select doc_id, b, (row_number() over (partition by b, lang order by doc_id) - 1) // 8 as batch, lang from (select *, case when n_chars >= 4000 then 2 when n_chars >= 1000 then 1 else 0 end as b from documents)) group by b, lang, batch")
def grouped_batches(spark, sf_dir):
    binned = view(spark, sf_dir, "documents").select("doc_id", "lang", S.quantize(F.col("n_chars"), [1000, 4000]).alias("bin"))
    return S.batches(binned, "doc_id", 8, ["bin", "lang"]).groupBy("bin", "lang", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).drop("lang")


@_det("quantize", "select id, (case when (x1-x0) >= 0.5*(y1-y0) then 1 else 0 end) + (case when (x1-x0) >= (y1-y0) then 1 else 0 end) + (case when (x1-x0) >= 2*(y1-y0) then 1 else 0 end) as bin from det")
def quantize(spark, sf_dir):
    ratio = S.aspect_ratio(G.box())
    return view(spark, sf_dir, "det").select("id", S.quantize(ratio, S.aspect_bins(1)).alias("bin"))


@_det("aspect_ratio", "select id, round((x1-x0) / (y1-y0), 6) as ratio from det")
def aspect_ratio(spark, sf_dir):
    return view(spark, sf_dir, "det").select("id", F.round(S.aspect_ratio(G.box()), 6).alias("ratio"))


@_det("aspect_bin_counts", "select case when (x1-x0) >= (y1-y0) then 1 else 0 end as bin, count(*) as n from det group by 1")
def aspect_bin_counts(spark, sf_dir):
    ratio = S.aspect_ratio(G.box())
    return view(spark, sf_dir, "det").groupBy(S.quantize(ratio, S.aspect_bins(0)).alias("bin")).agg(F.count("*").alias("n"))


@register("rolling_meter", """
with w as (select event_id, user_id, value, list_sort(list(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row)) as v from events)
select event_id, v[(len(v) - 1) // 2 + 1] as median, round(list_avg(v), 6) as avg, list_max(v) as max, value from w
""")
def rolling_meter(spark, sf_dir):
    out = S.rolling_meter(view(spark, sf_dir, "events"), ["ts", "event_id"], "value", keys=["user_id"])
    return out.select("event_id", "median", F.round("avg", 6).alias("avg"), "max", "value")


@register("meter", "select event_type, round(sum(value * (event_id % 5 + 1)), 4) as total, cast(sum(event_id % 5 + 1) as bigint) as count, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) as global_avg from events group by event_type")
def meter(spark, sf_dir):
    out = S.global_meter(view(spark, sf_dir, "events"), ["event_type"], F.col("value"), F.col("event_id") % 5 + 1)
    return out.select("event_type", F.round("total", 4).alias("total"), "count", F.round("global_avg", 6).alias("global_avg"))


@register("log_every", "with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events) select event_id, i, n - 1 - i as remaining from r where i % 10 = 0 or i = n - 1")
def log_every(spark, sf_dir):
    out = S.log_every(view(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], 10, ["user_id"])
    return out.select("event_id", F.col("i").cast("long").alias("i"), "remaining")


@register("warmup_lr", "select p_partkey as step, round(case when p_partkey >= 1000 then 1.0 else 0.001 * (1 - p_partkey / 1000.0) + p_partkey / 1000.0 end, 9) as factor from part")
def warmup_lr(spark, sf_dir):
    step = F.col("p_partkey")
    return view(spark, sf_dir, "part").select(step.alias("step"), F.round(S.warmup_factor(step, 1000, 0.001), 9).alias("factor"))


def _probs(spark, sf_dir):
    return P.pixels_of(view(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", 8)


_PIXELS = "with px as (select vec_id, k // 8 as y, k % 8 as x, cast(embedding[k + 1] as double) as v from embeddings, range(64) r(k))"


@register("zonal_stats", f"{_PIXELS} select vec_id, vec_id % 4 as x0, round(avg(v), 5) as mean, max(v) as max, min(v) as min from px where x >= vec_id % 4 and x < vec_id % 4 + 3 and y >= 2 and y < 6 group by vec_id")
def zonal_stats(spark, sf_dir):
    pixels = _probs(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    zones = view(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("x0"), F.lit(2).alias("y0"), (F.col("vec_id") % 4 + 3).alias("x1"), F.lit(6).alias("y1"))
    return P.zonal_stats(pixels, zones, ["vec_id"]).select("vec_id", "x0", F.round("mean", 5).alias("mean"), "max", "min")


# Sixteen embeddings make an image of 32 by 32 pixels of 16 bits.
@register("thumbnail16", "with px as (select vec_id // 16 as image_id, (vec_id % 16) * 2 + k // 32 as y, k % 32 as x, cast(floor(abs(embedding[k + 1]) * 16384) as bigint) as v from embeddings, range(64) r(k)) select image_id, cast(y // 16 as int) as ty, cast(x // 16 as int) as tx, cast(floor(avg(v) / 256) as int) as v from px group by all")
def thumbnail16(spark, sf_dir):
    place = F.col("vec_id") % 16 * 64 + F.col("k")
    each = view(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    pixels = each.select(F.floor(F.col("vec_id") / 16).alias("image_id"), F.floor(place / 32).alias("y"), (place % 32).alias("x"), F.floor(F.abs("e") * 16384).alias("v"))
    return P.thumbnail(pixels, ["image_id"], 32, 32)


@register("rle", f"{_PIXELS}, b as (select vec_id, y*8+x as k, cast(v > 0 as int) as bit from px), n as (select *, case when bit <> lag(bit) over (partition by vec_id order by k) then 1 else 0 end as f from b), r as (select *, sum(f) over (partition by vec_id order by k) as run from n) select vec_id, cast(run as bigint) as run, bit, cast(min(k) as int) as start, count(*) as length from r group by vec_id, run, bit")
def rle(spark, sf_dir):
    return P.rle(_probs(spark, sf_dir), ["vec_id"], 8, F.col("v") > 0)


# DuckDB rounds to a negative zero, Spark to zero.
@register("normalize", f"{_PIXELS} select vec_id, y, x, round(v / 255, 7) + 0.0::double as v from px")
def normalize(spark, sf_dir):
    return P.normalize(_probs(spark, sf_dir)).select("vec_id", "y", "x", F.round("v", 7).alias("v"))


@register("softmax_mask", f"{_PIXELS} select vec_id, count(*) as n from px a where 1 / (1 + exp(-(v))) >= 0.55 group by vec_id")
def softmax_mask(spark, sf_dir):
    pixels = _probs(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return P.softmax_mask(pixels, F.lit(0.0), F.col("v"), 0.55).groupBy("vec_id").agg(F.count("*").alias("n"))


@register("select_pyramid_level", """
with a as (select n_regionkey as image_id, n_nationkey as level, case when n_regionkey < 3 then 100000 - n_nationkey*1000 else (n_nationkey*7919) % 5000 end as size from nation),
m as (select *, size < lag(size) over (partition by image_id order by level) as f, row_number() over (partition by image_id order by level) - 1 as place, row_number() over (partition by image_id order by size desc, level) - 1 as k from a),
p as (select *, bool_and(coalesce(f, true)) over (partition by image_id) as pyramid from m)
select image_id, cast(place as int) as level from p where case when pyramid then place = 1 else k = 1 end
""")
def select_pyramid_level(spark, sf_dir):
    from pyspark.sql import Window

    size = F.expr("case when n_regionkey < 3 then 100000 - n_nationkey*1000 else (n_nationkey*7919) % 5000 end")
    level = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return P.select_level(view(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("image_id"), level.alias("level"), size.alias("size")), 1)


_BOXES = "with b as (select image_id, id, category_id, x0 % 256 as x0, y0 % 256 as y0, least(x0 % 256 + 16 + id % 48, 256) as x1, least(y0 % 256 + 20, 256) as y1 from det)"


def _local(spark, sf_dir):
    return view(spark, sf_dir, "det").selectExpr("image_id", "id", "category_id", "x0 % 256 as x0", "y0 % 256 as y0", "least(x0 % 256 + 16 + id % 48, 256) as x1", "least(y0 % 256 + 20, 256) as y1")


def _runs(spark, sf_dir):
    ring = G.ring_of(G.box())
    return _local(spark, sf_dir).withColumn("runs", P.fill_ring(ring, F.lit(256), F.lit(256))).withColumnsRenamed({"category_id": "class", "id": "roi_idx"})


@_det("rasterize", _BOXES + " select id as roi_idx, (x1-x0)*(y1-y0) as pixels from b")
def rasterize(spark, sf_dir):
    count = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["x1"] - r["x0"])
    return _runs(spark, sf_dir).select("roi_idx", count.alias("pixels"))


@_det("semantic_records", _BOXES + ", p as (select image_id, id, category_id, unnest(range(x0, x1)) as x, y0, y1 from b), q as (select image_id, x, unnest(range(y0, y1)) as y, id, category_id from p), m as (select image_id, x, y, arg_max(category_id, id) as c from q group by all) select image_id, c as class, count(*) as pixels from m group by all")
def semantic_records(spark, sf_dir):
    return P.semantic_runs(_runs(spark, sf_dir), ["image_id"]).groupBy("image_id", "class").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixels"))


@_det("tile_mask", _BOXES + ", p as (select image_id, unnest(range(x0, x1)) as x, y0, y1 from b), q as (select distinct image_id, x, unnest(range(y0, y1)) as y from p) select image_id, x // 64 as tx, y // 64 as ty, count(*) as pixels from q group by all having count(*) * 4 >= 64 * 64")
def tile_mask(spark, sf_dir):
    grid = F.explode(F.sequence(F.lit(0), F.lit(15)))
    tiles = view(spark, sf_dir, "image").select("image_id", grid.alias("k")).selectExpr("image_id", "k % 4 as tx", "cast(floor(k / 4) as int) as ty").selectExpr("*", "tx*64 as x0", "ty*64 as y0", "tx*64+64 as x1", "ty*64+64 as y1")
    return P.tile_mask(_runs(spark, sf_dir), tiles, ["image_id"], 0.25).select("image_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "pixels")


_RECORDS = """with r as (select id, class, x0 - x0 // 1024 * 1024 as bx0, y0 - y0 // 1024 * 1024 as by0, x1 - x0 // 1024 * 1024 as bx1, y1 - y0 // 1024 * 1024 as by1 from det),
c as (select class, dense_rank() over (order by class) - 1 as k from (select distinct class from det))"""


def _records(spark, sf_dir):
    t = lambda c: (F.floor(F.col(c) / 1024) * 1024)
    return view(spark, sf_dir, "det").select("id", "class", G.ring_of(G.box()).alias("ring"), t("x0").alias("tx0"), t("y0").alias("ty0"), (t("x0") + 1024).alias("tx1"), (t("y0") + 1024).alias("ty1"))


@_det("instance_records", f"{_RECORDS} select id, k + 1 as label, cast(bx0 as double) as bx0, cast(by1 as double) as by1, cast((bx1-bx0)*(by1-by0) as double) as box_area, 0 as iscrowd from r join c using (class)")
def instance_records(spark, sf_dir):
    out = D.instance_records(_records(spark, sf_dir), R.class_index(view(spark, sf_dir, "det"), "class"))
    return out.select("id", F.col("label").cast("long").alias("label"), "bx0", "by1", "box_area", "iscrowd")


@_det("detectron_records", f"{_RECORDS} select id, k as category_id, cast(1024 as bigint) as height, concat_ws(',', bx0, by0, bx1, by0, bx1, by1, bx0, by1) as segmentation from r join c using (class)")
def detectron_records(spark, sf_dir):
    out = D.detectron_records(_records(spark, sf_dir), R.class_index(view(spark, sf_dir, "det"), "class"))
    text = F.concat_ws(",", F.transform("segmentation", lambda v: v.cast("bigint").cast("string")))
    return out.select("id", F.col("category_id").cast("long").alias("category_id"), "height", text.alias("segmentation"))


@_gt("patch_records", "select id, cast(category_id - 1 as bigint) as class_id, 'det' as part from det union all select id, cast(category_id - 1 as bigint) as class_id, 'gt' as part from gt")
def patch_records(spark, sf_dir):
    det, gt = view(spark, sf_dir, "det"), view(spark, sf_dir, "gt")
    classes = R.class_index(det, "class")
    part = lambda df, name: D.patch_records(df, classes).select("id", F.col("class_id").cast("long").alias("class_id"), F.lit(name).alias("part"))
    return part(det, "det").unionByName(part(gt, "gt"))


@_gt("to_coco", "select row_number() over (order by image_id, id) as ann_id, image_id, category_id, x0 as x, y0 as y, x1-x0 as w, y1-y0 as h, (x1-x0)*(y1-y0) as area, 0 as iscrowd from gt")
def to_coco(spark, sf_dir):
    return D.to_coco(view(spark, sf_dir, "gt").withColumnRenamed("category_id", "class_id"), ["id"])[2]


@_det("coco_results", "select image_id, category_id, score, x0 as x, y0 as y, x1-x0 as w, y1-y0 as h from det")
def coco_results(spark, sf_dir):
    packed = view(spark, sf_dir, "det").groupBy("image_id", (F.col("id") % 64).alias("batch")).agg(F.collect_list(F.struct(F.array("x0", "y0", "x1", "y1").alias("b"), "score", "category_id")).alias("o"))
    return D.coco_results(packed.select("image_id", F.col("o.b").alias("boxes"), F.col("o.score").alias("scores"), F.col("o.category_id").alias("labels")))


@_det("load_results", "select image_id, row_number() over (partition by image_id order by score desc, x0, y0) as id, (x1-x0)*(y1-y0) as area, x0 + y1 as corner from det")
def load_results(spark, sf_dir):
    results = view(spark, sf_dir, "det").selectExpr("image_id", "score", "x0 as x", "y0 as y", "x1-x0 as w", "y1-y0 as h")
    out = D.load_results(results, [F.desc("score"), "x", "y"])
    return out.select("image_id", F.col("id").cast("long").alias("id"), "area", (F.col("segmentation")[2] + F.col("segmentation")[3]).alias("corner"))


def _annotations(spark, sf_dir):
    return view(spark, sf_dir, "gt").selectExpr("id", "image_id", "category_id", "x0 as x", "y0 as y", "(x1-x0) % 30 as w", "(y1-y0) % 30 as h", "cast(id % 11 = 0 as int) as iscrowd")


@_gt("category_filter_remap", "select id, case category_id when 4 then 0 when 2 then 1 else 2 end as category_id from gt where category_id in (4, 2, 5)")
def category_filter_remap(spark, sf_dir):
    return D.category_filter(_annotations(spark, sf_dir), [4, 2, 5]).select("id", F.col("category_id").cast("int").alias("category_id"))


@_gt("drop_unannotated", "select n_nationkey as id from nation where n_nationkey in (select image_id from gt where (x1-x0) % 30 > 1 and (y1-y0) % 30 > 1)")
def drop_unannotated(spark, sf_dir):
    return D.drop_unannotated(view(spark, sf_dir, "image").select(F.col("image_id").alias("id")), _annotations(spark, sf_dir))


@_gt("crowd_degenerate", "with b as (select id, least(x0, 8000) as x0, least(y0, 8000) as y0, least(x0 + (x1-x0) % 30, 8000) as x1, least(y0 + (y1-y0) % 30, 8000) as y1 from gt where id % 11 <> 0) select * from b where x1 > x0 and y1 > y0")
def crowd_degenerate(spark, sf_dir):
    return D.clean_boxes(_annotations(spark, sf_dir), F.lit(8000), F.lit(8000)).select("id", "x0", "y0", "x1", "y1")


@_det("xywh_to_xyxy", "select id, least(x0, 8000) as x0, least(y0, 8000) as y0, least(x1, 8000) as x1, least(y1, 8000) as y1 from det")
def xywh_to_xyxy(spark, sf_dir):
    b = G.xywh_to_xyxy(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(8000), F.lit(8000))
    return view(spark, sf_dir, "det").select("id", *[getattr(b, c).alias(c) for c in b._fields])


@_det("flip_horizontal", "select id, 9000 - x1 as x0, 9000 - x0 as x1 from det")
def flip_horizontal(spark, sf_dir):
    return D.flip_horizontal(view(spark, sf_dir, "det"), F.lit(9000)).select("id", "x0", "x1")


# All eight moves of all four corners: mirrored first, then turned by 90 degrees so many times.
@_det("augment", """
with c as (select id, unnest([{'k': 0, 'x': x0, 'y': y0}, {'k': 1, 'x': x1, 'y': y0}, {'k': 2, 'x': x1, 'y': y1}, {'k': 3, 'x': x0, 'y': y1}]) as p from (select id, x0 % 1024 as x0, y0 % 1024 as y0, x0 % 1024 + x1 - x0 as x1, y0 % 1024 + y1 - y0 as y1 from det) l),
l as (select id, cast(p.k as int) as k, cast(least(greatest(p.x, 1), 1023) as double) as x, cast(least(greatest(p.y, 1), 1023) as double) as y from c),
m as (select id, k, mirror, case when mirror then 1024 - x else x end as x, y from l, (values (false), (true)) f(mirror))
select id, k, cast(turns as int) as turns, mirror, case turns when 0 then x when 1 then y when 2 then 1024 - x else 1024 - y end as x, case turns when 0 then y when 1 then 1024 - x when 2 then 1024 - y else x end as y from m, range(4) t(turns)
""")
def augment(spark, sf_dir):
    at = lambda c: F.col(c + "0") % 1024
    corners = G.Box(at("x"), at("y"), at("x") + F.col("x1") - F.col("x0"), at("y") + F.col("y1") - F.col("y0"))
    # the moved rings are columns, so that both generators read them where they are and are compiled
    rings = view(spark, sf_dir, "det").select("id", G.ring_of(corners).alias("ring")).select("id", *[D.augment_ring(F.col("ring"), move).alias(f"ring_{k}") for k, move in enumerate(D.MOVES)])
    moved = F.array(*[F.struct(F.lit(turns).alias("turns"), F.lit(mirror).alias("mirror"), F.col(f"ring_{k}").alias("ring")) for k, (turns, mirror) in enumerate(D.MOVES)])
    each = rings.select("id", F.inline(moved)).select("id", "turns", "mirror", F.posexplode("ring").alias("k", "p"))
    return each.select("id", "k", "turns", "mirror", "p.x", "p.y")


_PAIRS = """
with pairs as (select a.image_id, a.category_id, a.id as pred_id, b.id as gt_id, a.score, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as s, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) as t
  from det a join gt b on a.image_id = b.image_id and a.category_id = b.category_id)
"""


def _pairs(spark, sf_dir):
    preds = view(spark, sf_dir, "det").select("id", *E.KEYS, "score", "x0", "y0", "x1", "y1")
    return preds, E.pred_gt_join(preds, view(spark, sf_dir, "gt").select("id", *E.KEYS, "x0", "y0", "x1", "y1"))


@_gt("pred_gt_join", _PAIRS + "select pred_id, gt_id, s as shared, t - s as joint from pairs where s > 0")
def pred_gt_join(spark, sf_dir):
    return _pairs(spark, sf_dir)[1].select("pred_id", "gt_id", "shared", "joint")


# Greedy matching, pair by pair in order of score, within each image and category.
_MATCHED = """
with recursive pairs as (select a.image_id, a.category_id, a.id as pred_id, b.id as gt_id, a.score, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as s, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) as t
  from det a join gt b on a.image_id = b.image_id and a.category_id = b.category_id),
good as (select *, row_number() over (partition by image_id, category_id order by score desc, pred_id, s / (t - s) desc, gt_id) as r from pairs where s > 0 and s / (t - s) >= 0.5),
walk(image_id, category_id, r, ps, gs) as (
  select distinct image_id, category_id, 0::bigint, []::bigint[], []::bigint[] from good
  union all
  select w.image_id, w.category_id, g.r, case when list_contains(ps, pred_id) or list_contains(gs, gt_id) then ps else list_append(ps, pred_id) end, case when list_contains(ps, pred_id) or list_contains(gs, gt_id) then gs else list_append(gs, gt_id) end
  from walk w join good g on g.image_id = w.image_id and g.category_id = w.category_id and g.r = w.r + 1),
matched as (select unnest(arg_max(ps, r)) as pred_id, unnest(arg_max(gs, r)) as gt_id from walk group by image_id, category_id),
pos as (select category_id, count(*) as p from gt group by 1),
runs as (select category_id, id as pred_id, score, cast(sum(case when m.pred_id is null then 0 else 1 end) over w as bigint) as tp, row_number() over w as n from det d left join matched m on m.pred_id = d.id window w as (partition by category_id order by score desc, id)),
curve as (select category_id, pred_id, score, tp, n - tp as fp, tp / n as precision, tp / p as recall from runs join pos using (category_id))
"""


@_gt("evaluate_images", _MATCHED + "select pred_id, gt_id from matched")
def evaluate_images(spark, sf_dir):
    return E.greedy_matches(_pairs(spark, sf_dir)[1]).select("pred_id", "gt_id")


@_gt("precision_recall", _MATCHED + "select * from curve")
def precision_recall(spark, sf_dir):
    preds, pairs = _pairs(spark, sf_dir)
    return E.precision_recall(preds, E.greedy_matches(pairs), view(spark, sf_dir, "gt"))


@_gt("average_precision", _MATCHED + """, points as (select category_id, k, coalesce((select max(precision) from curve c where c.category_id = pos.category_id and floor(c.recall * 100 + 1e-9) >= k), 0) as p from pos, range(101) r(k))
select category_id, round(avg(p), 6) as ap from points group by category_id
""")
def average_precision(spark, sf_dir):
    return E.average_precision(precision_recall(spark, sf_dir)).select("category_id", F.round("ap", 6).alias("ap"))


@register("parse_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def parse_json(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"].alias("k"))


@_det("to_geojson", "select id, class as name, round(score, 2) as value, 5 as points, 'annotation' as kind, cast(x1 as double) as far from det")
def to_geojson(spark, sf_dir):
    feature = to_feature(F.col("class"), F.col("score"), G.ring_of(G.box()))
    made = view(spark, sf_dir, "det").select("id", F.from_json(feature, "struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:struct<classification:struct<name:string>,measurements:array<struct<name:string,value:double>>,object_type:string>>").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return made.select("id", F.col("f.properties.classification.name").alias("name"), F.round(F.col("f.properties.measurements")[0]["value"], 2).alias("value"), F.size(ring).alias("points"), F.col("f.properties.object_type").alias("kind"), ring[1][0].alias("far"))


@_det("read_txt_rois", "select id as roi_idx, case when id % 3 = 0 then 'unnamed' else class end as name, 5 as points, x0 / 2.0 as x_min from det where id % 4 <> 0")
def read_txt_rois(spark, sf_dir):
    ring = F.concat(F.lit("["), F.concat_ws(",", "x0", "x1", "x1", "x0", "x0"), F.lit("]_["), F.concat_ws(",", "y0", "y0", "y1", "y1", "y0"), F.lit("]"))
    line = F.when(F.col("id") % 4 == 0, F.concat(F.lit("tile#x#"), ring)).when(F.col("id") % 3 == 0, F.concat(F.lit("null#"), ring)).otherwise(F.concat("class", F.lit("#x#"), ring))
    lines = view(spark, sf_dir, "det").select(F.col("id").alias("roi_idx"), line.alias("value"))
    return parse_text_rois(lines, 2.0).select("roi_idx", "name", F.size("ring").alias("points"), G.ring_bounds(F.col("ring")).x0.alias("x_min"))


@_det("model_cross", "select tag, class, count(*) as n from det join (values ('a', 100000.0), ('b', 250000.0), ('c', 400000.0)) m(tag, threshold) on score > threshold group by all")
def model_cross(spark, sf_dir):
    models = spark.createDataFrame([("a", 100000.0), ("b", 250000.0), ("c", 400000.0)], "tag string, threshold double")
    return P.model_cross(view(spark, sf_dir, "det"), models).groupBy("tag", "class").agg(F.count("*").alias("n"))


@register("coco_summary")
def coco_summary(spark, sf_dir):
    truth = view(spark, sf_dir, "gt").withColumn("iscrowd", (F.col("id") % 11 == 0).cast("int"))
    preds = view(spark, sf_dir, "det").withColumn("score", F.col("score").cast("double"))
    return E.coco_summary(preds, truth).withColumn("value", F.round("value", 9))


def _masks(spark, sf_dir, name):
    """Boxes of a view as masks whose left side is a saw; made on Arrow batches, as a lambda a run takes most of the queries' time."""
    boxes = view(spark, sf_dir, name)

    def run(batches):
        for batch in batches:
            own, x0, y0, x1, y1 = (batch.column(c).to_numpy() for c in ("id", "x0", "y0", "x1", "y1"))
            ends = np.cumsum(y1 - y0)
            row = np.repeat(np.arange(len(own)), y1 - y0)
            y = y0[row] + np.arange(len(row)) - (ends - (y1 - y0))[row]
            parts = [pa.array(v, pa.int32()) for v in (y, x0[row] + (y * 3 + own[row]) % 4, x1[row])]
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(parts, ["y", "x0", "x1"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, runs], names=[*batch.schema.names, "runs"])

    return boxes.where("id is not null and x0 is not null and y0 is not null").mapInArrow(run, T.StructType([*boxes.schema.fields, T.StructField("runs", K.RUNS)]))


_SAW = """
with p as (select *, unnest(range(y0, y1)) as y from det), g as (select *, unnest(range(y0, y1)) as y from gt),
a as (select id, image_id, category_id, y, x0 + (y * 3 + id) % 4 as x0, x1 from p), b as (select id, image_id, category_id, y, x0 + (y * 3 + id) % 4 as x0, x1 from g)
"""


@register("mask_overlaps", with_views(_SAW + """select image_id, category_id, a.id as pred_id, b.id as gt_id, cast(sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) as bigint) as shared
from a join b using (image_id, category_id, y) where a.x0 < b.x1 and b.x0 < a.x1 group by all""", "det", "gt"))
def mask_overlaps(spark, sf_dir):
    return K.mask_overlaps(_masks(spark, sf_dir, "det"), _masks(spark, sf_dir, "gt"))


@register("coco_mask_summary")
def coco_mask_summary(spark, sf_dir):
    truth = _masks(spark, sf_dir, "gt").withColumn("iscrowd", (F.col("id") % 11 == 0).cast("int"))
    preds = _masks(spark, sf_dir, "det").withColumn("score", F.col("score").cast("double"))
    return E.coco_mask_summary(preds, truth).withColumn("value", F.round("value", 9))


@register("coco_runs", with_views("select id, cast((y1 - y0) * (x1 - x0) - (select sum((y * 3 + id) % 4) from range(y0, y1) t(y)) as bigint) as pixels, true as same from det", "det"))
def coco_runs(spark, sf_dir):
    """Masks in their image's frame, written as COCO's text and read again."""
    own = _masks(spark, sf_dir, "det").withColumns({"height": F.col("y1") + 3, "width": F.col("x1") + 2}).select("id", "runs", "height", "width")
    back = K.from_coco_runs(K.with_coco_runs(own).withColumnRenamed("runs", "given"))
    return back.select("id", K.mask_size().alias("pixels"), (F.col("runs") == F.col("given")).alias("same"))


POINT_FALLOFF = (0.1, 0.2, 0.3)


def _keypoints(spark, sf_dir):
    """Three corners of boxes as keypoints; truths show some, or none, of them."""
    corners = lambda seen: F.array(*[c.cast("double") for x, y, v in zip(("x0", "x1", "x0"), ("y0", "y1", "y1"), seen) for c in (F.col(x), F.col(y), v)])
    preds = view(spark, sf_dir, "det").withColumn("score", F.col("score").cast("double")).withColumn("keypoints", corners([F.lit(2)] * 3))
    truth = view(spark, sf_dir, "gt").withColumn("keypoints", corners([F.col("id") % 3, F.col("id") % 2, F.lit(0)]))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return preds, truth.withColumn("size", size).withColumn("iscrowd", (F.col("id") % 13 == 0).cast("int"))


@register("keypoint_pairs", with_views("""
with best as (select *, row_number() over (partition by image_id, category_id order by score desc, id) as place from det),
pairs as (select p.id as pred_id, g.id as gt_id, (g.x1 - g.x0) * (g.y1 - g.y0) as size, g.id % 3 > 0 as seen_a, g.id % 2 > 0 as seen_b,
  g.x0 - (g.x1 - g.x0) as l, g.x1 + (g.x1 - g.x0) as r, g.y0 - (g.y1 - g.y0) as t, g.y1 + (g.y1 - g.y0) as b,
  (p.x0 - g.x0) ** 2 + (p.y0 - g.y0) ** 2 as a2, (p.x1 - g.x1) ** 2 + (p.y1 - g.y1) ** 2 as b2, p.x0, p.y0, p.x1, p.y1
  from best p join gt g using (image_id, category_id) where place <= 20),
far as (select *, greatest(0, l - x0) + greatest(0, x0 - r) as fx0, greatest(0, l - x1) + greatest(0, x1 - r) as fx1, greatest(0, t - y0) + greatest(0, y0 - b) as fy0, greatest(0, t - y1) + greatest(0, y1 - b) as fy1 from pairs)
select pred_id, gt_id, round(case when seen_a or seen_b
  then (case when seen_a then exp(-a2 / 0.04 / size / 2) else 0 end + case when seen_b then exp(-b2 / 0.16 / size / 2) else 0 end) / (seen_a::int + seen_b::int)
  else (exp(-(fx0 ** 2 + fy0 ** 2) / 0.04 / size / 2) + exp(-(fx1 ** 2 + fy1 ** 2) / 0.16 / size / 2) + exp(-(fx0 ** 2 + fy1 ** 2) / 0.36 / size / 2)) / 3 end, 6) as iou from far
""", "det", "gt"))
def keypoint_pairs(spark, sf_dir):
    pairs = E.keypoint_pairs(*_keypoints(spark, sf_dir), POINT_FALLOFF)
    return pairs.withColumn("iou", F.round("iou", 6))


@register("coco_keypoint_summary")
def coco_keypoint_summary(spark, sf_dir):
    return E.coco_keypoint_summary(*_keypoints(spark, sf_dir), POINT_FALLOFF).withColumn("value", F.round("value", 9))


# Each embedding is a chunk of 8 by 8 pixels of 8 bits, its tile moved by its id, with one box as region.
@register("training_arrays", """
with e as (select vec_id, 1 + vec_id % 3 as a, 2 as b, 5 + vec_id % 2 as c, 6 as d, vec_id % 8 as move, embedding from embeddings),
px as (select vec_id, k // 8 as y, k % 8 as x, cast(floor(abs(embedding[k + 1]) * 1000) as bigint) % 256 as v, a, b, c, d from e, range(64) r(k)),
sums as (select vec_id, cast(sum(v) as bigint) as total, cast(sum(v) filter (where x >= a and x < c and y >= b and y < d) as bigint) as inside from px group by vec_id),
flipped as (select vec_id, move, case when move >= 4 then 8 - c else a end as x0, case when move >= 4 then 8 - a else c end as x1, b as y0, d as y1 from e)
select vec_id as image_id, cast(move as int) as move, total, inside,
  cast(case move % 4 when 0 then x0 when 1 then y0 when 2 then 8 - x1 else 8 - y1 end as double) as x0, cast(case move % 4 when 0 then y0 when 1 then 8 - x1 when 2 then 8 - y1 else x0 end as double) as y0,
  cast(case move % 4 when 0 then x1 when 1 then y1 when 2 then 8 - x0 else 8 - y0 end as double) as x1, cast(case move % 4 when 0 then y1 when 1 then 8 - x0 when 2 then 8 - y0 else x1 end as double) as y1
from sums join flipped using (vec_id)""")
def training_arrays(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings").where("vec_id is not null")
    # a float times a whole number stays a float in SQL: some products round up to the next whole one
    byte = F.transform("embedding", lambda v: F.lpad(F.hex(F.floor(F.abs(v) * F.lit(1000).cast("float")) % 256), 2, "0"))
    zero, eight = F.lit(0).cast("long"), F.lit(8).cast("long")
    tiles = e.select(F.col("vec_id").alias("image_id"), zero.alias("x0"), zero.alias("y0"), eight.alias("x1"), eight.alias("y1"), (F.col("vec_id") % 8).cast("int").alias("move"))
    chunks = e.select(F.col("vec_id").alias("image_id"), F.lit(0).alias("c0"), zero.alias("y0"), zero.alias("x0"), F.lit(1).alias("channels"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit("uint8").alias("dtype"), F.unhex(F.array_join(byte, "")).alias("data"))
    sides = G.Box(*[F.expr(x) for x in ("1 + image_id % 3", "2", "5 + image_id % 2", "6")])
    rois = tiles.select("image_id", "x0", "y0", "x1", "y1", F.lit(0).alias("roi_idx"), F.lit(1).alias("label"), G.ring_of(sides).alias("ring"))
    made = TR.training_arrays(tiles, chunks, rois, 8)

    def sums(batches):
        for batch in batches:
            images = [np.frombuffer(i, "<f4").reshape(8, 8) for i in batch["image"]]
            inside = [sum(float(im[r["y"], r["x0"] : r["x1"]].sum()) for r in masks[0]) for im, masks in zip(images, batch["masks"])]
            yield batch[["image_id", "move", "boxes"]].assign(total=[round(float(im.sum())) for im in images], inside=[round(n) for n in inside])

    counted = made.mapInPandas(sums, "image_id long, move int, boxes array<array<double>>, total long, inside long")
    return counted.select("image_id", "move", "total", "inside", *[F.col("boxes")[0][k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@_det("stream_batches", """with ranked as (select id, image_id, row_number() over (partition by image_id order by id) - 1 as k, count(*) over (partition by image_id) as n from det),
placed as (select *, k // 7 as b, k % 7 as own, k // 7 < n // 7 as whole from ranked),
full_ as (select image_id, b, row_number() over (order by max(id)) - 1 as batch from placed where whole group by image_id, b),
tails as (select image_id, n, count(*) as left_, row_number() over (order by count(*) desc, min(id)) as r from placed where not whole group by image_id, n),
room as (select (select count(*) from det) // 7 - (select count(*) from full_) as free_batches, (select count(*) from full_) as done),
kept as (select image_id, n, left_, r - 1 + done as batch from tails, room where r <= free_batches),
again as (select image_id, n, left_, batch, unnest(range(7 - left_)) as j from kept)
select id, image_id, batch, cast(own as int) as place from placed join full_ using (image_id, b) where whole
union all select id, p.image_id, batch, cast(own as int) from placed p join kept using (image_id) where not whole
union all select p.id, p.image_id, batch, cast(left_ + j as int) from again a join placed p on p.image_id = a.image_id and p.k = j % a.n""")
def stream_batches(spark, sf_dir):
    return S.grouped_batches(view(spark, sf_dir, "det").select("id", "image_id"), "id", "image_id", 7)


@_det("annotation_index", """with each as (select image_id, count(*) as n, min(id) as first, max(id) as last from det group by image_id),
seen as (select category_id, list(distinct image_id) as images from det group by category_id)
select 'image' as kind, image_id as key, n, first, last from each union all select 'category', category_id, len(images), list_min(images), list_max(images) from seen""")
def annotation_index(spark, sf_dir):
    images, categories = D.annotation_index(view(spark, sf_dir, "det"))
    row = lambda df, kind, key, ids: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.size(ids).cast("long").alias("n"), F.element_at(ids, 1).cast("long").alias("first"), F.element_at(ids, -1).cast("long").alias("last"))
    return row(images, "image", "image_id", "ann_ids").union(row(categories, "category", "category_id", "image_ids"))


@_det("log_every_eta", """with steps as (select id, image_id, row_number() over w - 1 as i, count(*) over (partition by image_id) as n, avg((x1 - x0)::double) over (partition by image_id order by id rows unbounded preceding) as mean from det window w as (partition by image_id order by id))
select id, image_id, i, n - 1 - i as remaining, round(mean * (n - i), 4) as eta from steps where i % 9 = 0 or i = n - 1""")
def log_every_eta(spark, sf_dir):
    logged = S.log_every(view(spark, sf_dir, "det").withColumn("took", F.col("x1") - F.col("x0")), ["id"], 9, ["image_id"], "took")
    return logged.select("id", "image_id", F.col("i").cast("long").alias("i"), "remaining", F.round("eta", 4).alias("eta"))
