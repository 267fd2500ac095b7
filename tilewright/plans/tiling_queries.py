"""Queries of tiling, spatial joins and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..graph import connected_components
from ..operators import merge as M
from ..operators import spatial_join as S
from ..operators import tiling as T
from .registry import register
from .views import view, with_views


def _tiles(spark, sf_dir):
    """The 16 by 16 tiles of the roi view's field."""
    grid = spark.range(256).select(F.lit(0).alias("image_id"), (F.col("id") % 16).alias("tx"), F.floor(F.col("id") / 16).alias("ty"))
    return grid.select("image_id", "tx", "ty", (F.col("tx") * 1024).alias("x0"), (F.col("ty") * 1024).alias("y0"), (F.col("tx") * 1024 + 1024).alias("x1"), (F.col("ty") * 1024 + 1024).alias("y1"))


def _rois(spark, sf_dir):
    return view(spark, sf_dir, "roi").select(F.lit(0).alias("image_id"), F.col("k").alias("roi_idx"), F.col("class").alias("name"), "x0", "y0", "x1", "y1")


_JOINED = """
with grid as (select t % 16 as tx, t // 16 as ty from range(256) r(t)),
hit as (select tx, ty, class, greatest(least(x1, tx*1024+1024) - greatest(x0, tx*1024), 0) * greatest(least(y1, ty*1024+1024) - greatest(y0, ty*1024), 0) as a, (x1-x0)*(y1-y0) as own from grid, roi)
"""


@register("tile_roi_join", with_views(_JOINED + "select tx, ty, class, count(*) as n_rois, cast(sum(a) as bigint) as area from hit where a * 20 > own group by all", "roi"))
def tile_roi_join(spark, sf_dir):
    joined = T.tile_roi_join(_tiles(spark, sf_dir), _rois(spark, sf_dir), 1024)
    return joined.groupBy("tx", "ty", "class").agg(F.count("*").alias("n_rois"), F.sum("clip_area").alias("area"))


@register("tile_roi_left_join", with_views(_JOINED + ", good as (select tx, ty, count(*) as n from hit where a * 20 > own and class <> 'R' group by all) select grid.tx, grid.ty, coalesce(n, 0) as n_rois from grid left join good using (tx, ty)", "roi"))
def tile_roi_left_join(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    counted = T.tile_roi_join(tiles, _rois(spark, sf_dir), 1024, exclude=("R",)).groupBy("tx", "ty").agg(F.count("*").alias("n"))
    return tiles.select("tx", "ty").join(counted, ["tx", "ty"], "left").select("tx", "ty", F.coalesce("n", F.lit(0)).cast("long").alias("n_rois"))


@register("non_empty_tiles", with_views(_JOINED + "select tx, ty, count(*) as n_rois from hit where a * 20 > own and class = 'A' group by all having count(*) > 0", "roi"))
def non_empty_tiles(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    records = T.tile_records(T.tile_roi_join(tiles, _rois(spark, sf_dir), 1024, exclude=("N", "R")), tiles.columns)
    return records.where(F.size("rois") > 0).select("tx", "ty", F.size("rois").cast("long").alias("n_rois"))


_GRID = """
with parts as (select i.image_id, width, height, coalesce(r.x0, 0) as px0, coalesce(r.y0, 0) as py0, coalesce(r.x1, width) as px1, coalesce(r.y1, height) as py1 from image i left join region_box r on r.image_id = i.image_id and r.name = 'tissue'),
cells as (select *, unnest(range(px0 // 512, px1 // 512 + 1)) as i from parts), grid as (select *, unnest(range(py0 // 512, py1 // 512 + 1)) as j from cells),
base as (select *, i*512 as x0, j*512 as y0, i*512+512 as x1, j*512+512 as y1 from grid),
kept as (select * from base where greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0) >= 0.9*512*512 and greatest(least(x1, width) - x0, 0) * greatest(least(y1, height) - y0, 0) >= 0.9*512*512)
"""


@register("tile_grid", with_views(_GRID + "select image_id, '(0, 0)' as name, x0, y0, x1, y1 from kept", "image", "region_box"))
def tile_grid(spark, sf_dir):
    return T.tile_grid(view(spark, sf_dir, "image"), view(spark, sf_dir, "region_box"), "tissue", 512, 0.9)


@register("tile_slides", with_views(_GRID + """, moves(n, dx, dy) as (values ('(256, 0)', 256, 0), ('(0, 256)', 0, 256), ('(256, 256)', 256, 256)),
moved as (select image_id, n as name, x0+dx as x0, y0+dy as y0, x1+dx as x1, y1+dy as y1, width, height, px0, py0, px1, py1 from kept, moves)
select image_id, '(0, 0)' as name, x0, y0, x1, y1 from kept union all
select image_id, name, x0, y0, x1, y1 from moved where x1 <= width and y1 <= height and greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0) >= 0.9*512*512""", "image", "region_box"))
def tile_slides(spark, sf_dir):
    return T.tile_grid(view(spark, sf_dir, "image"), view(spark, sf_dir, "region_box"), "tissue", 512, 0.9, ((256, 0), (0, 256), (256, 256)))


_STEPS = """
with steps as (select *, cast(ceil((width - 256) / 256.0) as bigint) as nx, cast(ceil((height - 256) / 256.0) as bigint) as ny from image),
rows_ as (select *, unnest(range(ny)) as j from steps), cells as (select *, unnest(range(nx)) as i from rows_),
tiles as (select image_id, j*nx+i as tile_idx, i*256 as x0, j*256 as y0, least(i*256+512, width) as x1, least(j*256+512, height) as y1 from cells)
"""


@register("tile_overlap", with_views(_STEPS + "select t.image_id, name, tile_idx, t.x0, t.y0, t.x1, t.y1 from tiles t join region_box r on r.image_id = t.image_id and name = 'tissue' where greatest(least(t.x1, r.x1) - greatest(t.x0, r.x0), 0) * greatest(least(t.y1, r.y1) - greatest(t.y0, r.y0), 0) > 0.75 * (t.x1-t.x0) * (t.y1-t.y0)", "image", "region_box"))
def tile_overlap(spark, sf_dir):
    return T.tile_overlap(view(spark, sf_dir, "image"), view(spark, sf_dir, "region_box"), "tissue", 512, 0.5, 0.75)


@register("tiles_to_patches", with_views(_STEPS + "select image_id, 'tile' as class, tile_idx, x0, y0, x1, y1 from tiles", "image"))
def tiles_to_patches(spark, sf_dir):
    return T.tile_overlap(view(spark, sf_dir, "image"), tile_size=512).withColumnRenamed("name", "class")


@register("patch_sets", with_views(_STEPS + "select y1-y0 as h, x1-x0 as w, count(*) as n from tiles group by all", "image"))
def patch_sets(spark, sf_dir):
    return T.patch_sets(T.tile_overlap(view(spark, sf_dir, "image"), tile_size=512))


@register("full_tiles", with_views(_STEPS + "select image_id, tile_idx from tiles where x1-x0 = 512 and y1-y0 = 512", "image"))
def full_tiles(spark, sf_dir):
    return T.full_tiles(T.tile_overlap(view(spark, sf_dir, "image"), tile_size=512), 512).select("image_id", "tile_idx")


@register("empty_set_tiles", with_views(_STEPS + "select image_id, tile_idx, 'empty' as class, 0 as n_rois from tiles", "image"))
def empty_set_tiles(spark, sf_dir):
    records = T.empty_records(T.tile_overlap(view(spark, sf_dir, "image"), tile_size=512))
    return records.select("image_id", "tile_idx", F.col("classes")[0].alias("class"), F.size("rois").alias("n_rois"))


_PAIRS = """
with pairs as (select a.id as i, b.id as j, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as s, (a.x1-a.x0)*(a.y1-a.y0) as aa, (b.x1-b.x0)*(b.y1-b.y0) as ab
  from det a join det b on a.id < b.id and a.class = b.class and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1)
"""


def _pairs(spark, sf_dir):
    pairs = S.box_self_join(view(spark, sf_dir, "det").select("id", "class", "score", "x0", "y0", "x1", "y1"), 64, keys=["class"])
    a, b = G.box("l"), G.box("r")
    return pairs.withColumnsRenamed({"l_id": "i", "r_id": "j"}).withColumns({"s": G.box_intersection(a, b), "aa": a.area, "ab": b.area})


def _pair(name: str, sql: str):
    return register(name, with_views(_PAIRS + sql, "det"))


@_pair("bbox_index_join", "select i, j from pairs")
def bbox_index_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j")


@_pair("intersects", "select i, j, s > 0 as inside from pairs")
def intersects(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", (F.col("s") > 0).alias("inside"))


@_pair("poly_intersection_area", "select i, j, s as area from pairs where s > 0")
def poly_intersection_area(spark, sf_dir):
    return _pairs(spark, sf_dir).where("s > 0").select("i", "j", F.col("s").alias("area"))


@_pair("iou", "select i, j, round(s / (aa + ab - s), 9) as iou from pairs where s > 0")
def iou(spark, sf_dir):
    return _pairs(spark, sf_dir).where("s > 0").select("i", "j", F.round(G.iou(F.col("s"), F.col("aa"), F.col("ab")), 9).alias("iou"))


@_pair("overlaps", "select i, j, s > 0 and s < least(aa, ab) as crosses from pairs")
def overlaps(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", G.overlaps(F.col("s"), F.col("aa"), F.col("ab")).alias("crosses"))


@_pair("contains_polygon", "select i, j from pairs where s > 0 and s = least(aa, ab)")
def contains_polygon(spark, sf_dir):
    return _pairs(spark, sf_dir).where(G.contains_either(F.col("s"), F.col("aa"), F.col("ab"))).select("i", "j")


@_pair("overlap_ratio", "select i, j from pairs where s > 0 and (s * 5 >= aa or s * 5 >= ab)")
def overlap_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).where(G.overlap_at_least(F.col("s") * 5, F.col("aa"), F.col("ab"), 1)).select("i", "j")


@_pair("iou_self_join", "select i, j from pairs where s > 0 and s < least(aa, ab) and s * 10 > 3 * (aa + ab - s)")
def iou_self_join(spark, sf_dir):
    return _pairs(spark, sf_dir).where(G.overlaps(F.col("s"), F.col("aa"), F.col("ab")) & F.expr("s * 10 > 3 * (aa + ab - s)")).select("i", "j")


@register("centroid_range_join", with_views("select a.id as l_id, b.id as r_id, (a.x0+a.x1-b.x0-b.x1)*(a.x0+a.x1-b.x0-b.x1) + (a.y0+a.y1-b.y0-b.y1)*(a.y0+a.y1-b.y0-b.y1) as d4 from det a join det b on a.id < b.id and a.class = b.class where (a.x0+a.x1-b.x0-b.x1)*(a.x0+a.x1-b.x0-b.x1) + (a.y0+a.y1-b.y0-b.y1)*(a.y0+a.y1-b.y0-b.y1) <= 40000", "det"))
def centroid_range_join(spark, sf_dir):
    return S.centroid_pairs(view(spark, sf_dir, "det"), 100, keys=["class"])


_REACH = """
with recursive edges as (select a.id as i, b.id as j from det a join det b on a.id <> b.id and a.class = b.class and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1),
reach(id, c) as (select id, id from det union select j, c from reach join edges on i = reach.id where c < j)
"""


@register("components", with_views(_REACH + "select id, min(c) as component from reach group by id having id in (select i from edges)", "det"))
def components(spark, sf_dir):
    edges = S.meeting_chains(view(spark, sf_dir, "det"), 512, keys=["class"])
    return connected_components(edges, "i", "j").select(F.col("node").alias("id"), "component")


def _dets(spark, sf_dir):
    return view(spark, sf_dir, "det").withColumn("ring", G.ring_of(G.box())).select("id", "image_id", "class", "score", "ring")


KEYS = ["image_id", "class"]


def _merged(spark, sf_dir, variant, *thresholds):
    out = M.merge_detections(_dets(spark, sf_dir), KEYS, variant, *thresholds)
    return out.select(*KEYS, F.array_min("members").alias("first"), F.size("members").alias("n"), F.round("score", 6).alias("score"), F.round(G.ring_area(F.col("ring")), 4).alias("area"))


@register("merge_iou")
def merge_iou(spark, sf_dir):
    return _merged(spark, sf_dir, "iou", 0.3)


@register("merge_centroid")
def merge_centroid(spark, sf_dir):
    return _merged(spark, sf_dir, "centroid")


@register("merge_rtree")
def merge_rtree(spark, sf_dir):
    return _merged(spark, sf_dir, "rtree")


@register("merge_pipeline")
def merge_pipeline(spark, sf_dir):
    from ..sources.geojson import to_feature

    merged = M.merge_detections(_dets(spark, sf_dir), KEYS)
    kept = merged.where(M.ring_is_valid("ring")).where(G.ring_area(F.col("ring")) > 1200)
    return kept.select(F.array_min("members").alias("first"), to_feature(F.col("class"), F.col("score"), F.col("ring")).alias("feature"))


def _scores(spark, sf_dir, variant, *thresholds):
    merged = M.merge_detections(_dets(spark, sf_dir), KEYS, variant, *thresholds)
    return merged.select(F.array_min("members").alias("id"), F.size("members").alias("n"), F.round("score", 4).alias("score"))


# The scores of all detections, merged or not, of components of any size; SQL cannot follow the order of unions.
@register("merge_score_mean")
def merge_score_mean(spark, sf_dir):
    return _scores(spark, sf_dir, "iou", 0.3)


@register("merge_score_max")
def merge_score_max(spark, sf_dir):
    return _scores(spark, sf_dir, "centroid")


@register("merge_score_area_avg")
def merge_score_area_avg(spark, sf_dir):
    return _scores(spark, sf_dir, "rtree")
