"""Spatial data derived from the driver tables by whole-number arithmetic, the same text for Spark and for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEWS = {
    "roi": ("lineitem", [
        "l_orderkey * 8 + l_linenumber as k", "l_returnflag as class",
        "(l_partkey*37 + l_linenumber*1009) % 16384 as x0", "(l_suppkey*53 + l_orderkey*17) % 16384 as y0",
        "(l_partkey*37 + l_linenumber*1009) % 16384 + cast(l_quantity as bigint)*4 + 8 as x1", "(l_suppkey*53 + l_orderkey*17) % 16384 + cast(l_quantity as bigint)*3 + 8 as y1",
    ]),
    "det": ("orders", [
        "o_orderkey as id", "o_orderpriority as class", "cast(substr(o_orderpriority, 1, 1) as int) as category_id", "cast(o_custkey % 25 as int) as image_id", "o_totalprice as score",
        "(o_orderkey*7919) % 8192 as x0", "(o_custkey*10473 + o_orderkey*31) % 8192 as y0",
        "(o_orderkey*7919) % 8192 + 16 + o_orderkey % 48 as x1", "(o_custkey*10473 + o_orderkey*31) % 8192 + 16 + o_custkey % 48 as y1",
    ]),
    "gt": ("det", [
        "id", "class", "category_id", "image_id", "x0 + id % 7 as x0", "y0 + id % 5 as y0", "x1 + id % 7 as x1", "y1 + id % 5 as y1",
    ]),
    "image": ("nation", ["n_nationkey as image_id", "cast(3000 + n_nationkey*211 as bigint) as width", "cast(2500 + n_nationkey*173 as bigint) as height"]),
    "region_box": ("nation", [
        "n_nationkey as image_id", "case when n_nationkey % 3 = 0 then 'other' else 'tissue' end as name",
        "cast(n_nationkey*29 as bigint) as x0", "cast(n_nationkey*17 as bigint) as y0", "cast(2400 + n_nationkey*190 as bigint) as x1", "cast(2100 + n_nationkey*160 as bigint) as y1",
    ]),
}
_WHERE = {"gt": "id % 5 <> 0"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view derived from one."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, columns = _VIEWS[name]
    df = view(spark, sf_dir, base)
    return (df.where(_WHERE[name]) if name in _WHERE else df).selectExpr(*columns)


def with_views(sql: str, *names: str) -> str:
    """``sql`` after common table expressions for the named views."""
    parts = []
    for name in names:
        base, columns = _VIEWS[name]
        where = f" where {_WHERE[name]}" if name in _WHERE else ""
        parts.append(f"{name} as (select {', '.join(columns)} from {base}{where})")
    text = sql.strip()
    if text.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {text[len('with recursive '):]}"
    return f"with {', '.join(parts)}{', ' + text[5:] if text.lower().startswith('with ') else ' ' + text}"
