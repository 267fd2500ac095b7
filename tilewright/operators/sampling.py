"""Splits, batches, bins and rolling meters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..storage import materialize


def running_counts(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with a running sum of each of ``sums`` (whole numbers) within ``keys`` in ``order``, this row included, and its ``total_``.

    Rows are range-partitioned by keys and order, so a key may span many
    partitions and no task holds a whole key; sums run inside a partition's part
    of the key, and each part begins at the sum of the parts before it, of which
    there is a row for each partition and key in it. Rows equal in all of
    ``order`` are in one task.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(F.struct(*df.columns).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[o.alias(f"o{i}") for i, o in enumerate(order)], *[c.cast("long").alias(f"s_{name}") for name, c in sums.items()])
    ks, os = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    # the ranges are written: they are drawn by sampling, and two steps must see the same ones
    dealt = materialize(keyed.repartitionByRange(n, *ks, *os).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*ks, "part").agg(*[F.sum(f"s_{name}").alias(f"p_{name}") for name in sums])
    by_key = Window.partitionBy(*ks)
    parts = parts.select(*ks, "part", *[(F.sum(f"p_{s}").over(by_key.orderBy("part")) - F.col(f"p_{s}")).alias(f"b_{s}") for s in sums], *[F.sum(f"p_{s}").over(by_key).alias(f"t_{s}") for s in sums])
    own = Window.partitionBy("part", *ks).orderBy(*os).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("row", *ks, "part", *[F.sum(f"s_{s}").over(own).alias(f"r_{s}") for s in sums])
    null_safe = run["part"] == parts["part"]
    for k in ks:
        null_safe = null_safe & run[k].eqNullSafe(parts[k])
    return run.join(parts, null_safe).select("row.*", *[(F.col(f"r_{s}") + F.col(f"b_{s}")).alias(s) for s in sums], *[F.col(f"t_{s}").alias(f"total_{s}") for s in sums])


#: Rows a bucket of hashes holds, about.
ROWS_A_BUCKET = 1_000_000


def hash_order(df: DataFrame, id_col: str, seed: str = "", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Rows with ``rank``, their place (from 1) in the order of a seeded MD5 of the id, and ``total``.

    Rows are ranked within the hash's leading digits, as many as make buckets of
    about ``rows_a_bucket`` rows (two to four), and the buckets' counts give each
    its start, so no task sorts the whole table.
    """
    h = df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    rows = df.count()
    digits = next(d for d in (2, 3, 4) if rows <= rows_a_bucket * 16**d or d == 4)
    h = h.withColumn("__b", F.substring("__h", 1, digits))
    counts = h.groupBy("__b").agg(F.count("*").alias("n"))
    # at most 16 ** 4 rows, and so small enough for a broadcast and one ordered task
    every = Window.orderBy("__b")
    starts = counts.select("__b", (F.sum("n").over(every) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col)) + F.col("before")
    return h.join(F.broadcast(starts), "__b").withColumn("rank", rank).drop("__h", "__b", "before")


def train_val_split(df: DataFrame, id_col: str, train_share: float = 0.95, seed: str = "") -> DataFrame:
    """Rows with ``split``: ``train`` for floor(share * n) of them, else ``val``; the same on every run."""
    ranked = hash_order(df, id_col, seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("total") * F.lit(train_share)), "train").otherwise("val")).drop("rank", "total")


def with_negatives(train: DataFrame, negatives: DataFrame, id_col: str, proportion: float = 0.5) -> DataFrame:
    """The training rows and ceil(proportion * n) of the negatives, drawn by hash."""
    want = F.broadcast(train.agg(F.ceil(F.count("*") * proportion).alias("want")))
    drawn = hash_order(negatives, id_col, "negatives").crossJoin(want).where("rank <= want").drop("rank", "total", "want")
    return train.unionByName(drawn)


def batches(df: DataFrame, order: str, batch_size: int, keys: list[str] = (), pad: bool = False) -> DataFrame:
    """Rows with ``batch`` from 0, ``batch_size`` rows each within ``keys``; every row is in one.

    With ``pad``, a key's last batch is filled up with its first rows, round and
    round. No task holds a whole key.
    """
    ranked = running_counts(df, list(keys), [F.col(order)], {"__k": F.lit(1)})
    out = ranked.withColumn("batch", F.floor((F.col("__k") - 1) / batch_size))
    if pad:
        # place k comes again at k + total, k + 2 * total, .. up to the end of the last batch
        end = F.ceil(F.col("total___k") / batch_size) * batch_size
        again = out.where(F.col("__k") <= end - F.col("total___k")).withColumn("__at", F.explode(F.expr(f"sequence(__k + total___k, cast(ceil(total___k / {batch_size}) * {batch_size} as bigint), total___k)")))
        out = out.unionByName(again.withColumn("batch", F.floor((F.col("__at") - 1) / batch_size)).drop("__at"))
    return out.drop("__k", "total___k")


def grouped_batches(df: DataFrame, order: str, key: str, batch_size: int) -> DataFrame:
    """Rows with ``batch`` and ``place`` (from 0): batches of one ``key`` each, as they fill while rows come by ``order``.

    A batch comes out when its last row does. In the end, groups with rows left
    give a batch each, the one with most rows first (of equal ones, that whose
    first such row came first), filled up with the group's first rows, round and
    round, until there are floor(n / batch_size) batches of all n rows; rows left
    beyond that are in none. ``order`` must be without repeats; a null key is a
    group.

    Places within groups and of full batches are put together from ranges, so no
    task holds a group or the stream; one row a group is ranked for the tails.
    """
    size = F.lit(batch_size)
    ranked = running_counts(df, [key], [F.col(order)], {"__k": F.lit(1)})
    ranked = materialize(ranked.withColumn("__b", F.floor((F.col("__k") - 1) / size)).withColumn("__own", F.col("__k") - F.col("__b") * size - 1), "ranked")
    whole = F.col("__b") < F.floor(F.col("total___k") / size)
    # full batches by the place of their last row in the stream
    full = running_counts(ranked.where(whole & (F.col("__own") == size - 1)).select(F.col(key).alias("f_key"), F.col("__b").alias("f_b"), F.col(order).alias("f_order")), [], [F.col("f_order")], {"n": F.lit(1)})
    full = materialize(full.select("f_key", "f_b", (F.col("n") - 1).alias("batch")), "full")
    tails = ranked.where(~whole).groupBy(F.col(key).alias("f_key"), F.col("total___k").alias("f_total")).agg(F.count("*").alias("f_left"), F.min(order).alias("f_first"))
    tails = running_counts(tails, [], [-F.col("f_left"), F.col("f_first")], {"n": F.lit(1)})
    done, rows = full.count(), ranked.count()
    tails = materialize(tails.where(F.col("n") <= rows // batch_size - done).select("f_key", "f_total", "f_left", (F.col("n") - 1 + done).alias("batch")), "tails")
    out = [*df.columns, "batch", "place"]
    inside = ranked.join(full, ranked[key].eqNullSafe(full["f_key"]) & (F.col("__b") == F.col("f_b"))).withColumn("place", F.col("__own").cast("int")).select(*out)
    last = ranked.join(tails, ranked[key].eqNullSafe(tails["f_key"]))
    own = last.where(~whole).withColumn("place", F.col("__own").cast("int")).select(*out)
    # the group's first rows again: its k-th stands at k - 1, k - 1 + total, .. of the places that are free
    free = size - F.col("f_left")
    again = last.where(F.col("__k") <= free).withColumn("__at", F.explode(F.sequence(F.col("__k") - 1, free - 1, F.col("f_total")))).withColumn("place", (F.col("f_left") + F.col("__at")).cast("int")).select(*out)
    return inside.unionByName(own).unionByName(again)


def quantize(x: Column, bins: list[float]) -> Column:
    """How many bins are at or below x."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bins), F.lit(0))


def aspect_bins(k: int) -> list[float]:
    """Bounds 2 ** -1 .. 2 ** 1 in 2k + 1 steps; just 1 for k = 0."""
    return [2 ** (-1 + i / k) for i in range(2 * k + 1)] if k else [1.0]


def rolling_meter(df: DataFrame, order: list[str], value: str, window: int = 20, keys: list[str] = ()) -> DataFrame:
    """Rows with the lower median, mean, maximum and latest value of the last ``window`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0)
    seen = F.sort_array(F.collect_list(value).over(w))
    return df.withColumns({"median": F.try_element_at(seen, F.floor((F.size(seen) - 1) / 2).cast("int") + 1), "avg": F.avg(value).over(w), "max": F.max(value).over(w), "value": F.col(value)})


def global_meter(df: DataFrame, keys: list[str], value: Column, n: Column) -> DataFrame:
    """(keys.., total, count, global_avg): values weighted by n."""
    return df.groupBy(*keys).agg(F.sum(value * n).alias("total"), F.sum(n).alias("count")).withColumn("global_avg", F.try_divide("total", "count"))


def log_every(df: DataFrame, order: list[str], freq: int, keys: list[str], seconds: str | None = None) -> DataFrame:
    """Rows logged: every ``freq``-th of a key's from its first, and its last, with ``i`` and ``remaining``.

    With ``seconds``, the time each row took, also ``eta``: the mean time so far
    times the rows from this one on. A key's rows are one window.
    """
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count("*").over(w)
    out = df.withColumn("i", i).withColumn("remaining", n - 1 - F.col("i"))
    if seconds is not None:
        so_far = F.avg(F.col(seconds).cast("double")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("eta", so_far * (F.col("remaining") + 1))
    return out.where((F.col("i") % freq == 0) | (F.col("remaining") == 0))


def warmup_factor(step: Column, warmup_iters: int, warmup_factor_: float) -> Column:
    """1 from ``warmup_iters`` on; before, a line from the factor to 1."""
    alpha = step / F.lit(float(warmup_iters))
    return F.when(step >= warmup_iters, F.lit(1.0)).otherwise(warmup_factor_ * (1 - alpha) + alpha)


def aspect_ratio(b: Box) -> Column:
    """Width over height of a box; null where it has no height."""
    return F.try_divide(b.x1 - b.x0, b.y1 - b.y0)
