"""Shards of nearly equal bytes by sampled, size-weighted splitters over text keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

RANGES_PER_SHARD = 8
UNITS_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
#: Groups a range holds, about; beyond MOST_RANGES ranges, which the driver holds a row each of, ranges grow instead.
UNITS_PER_RANGE = 500_000
MOST_RANGES = 1 << 14


def _range_of(bounds: np.ndarray):
    """A column function: how many boundaries a key has at or below it."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return place


def _sample(units: DataFrame, rate: float, salt: int) -> np.ndarray:
    """Keys drawn with a chance in proportion to their bytes; about ``rate`` times all bytes of them."""
    draw = F.xxhash64("h", "chunk", F.lit(salt)) / F.lit(float(1 << 64)) + F.lit(0.5)
    return np.sort(np.array([r[0] for r in units.where(draw < F.col("bytes") * F.lit(rate)).select("h").collect()], dtype=np.int64))


def _splitters(units: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Boundaries at quantiles of a size-weighted sample; ranges that come out overfull are sampled again and cut.

    The driver holds a sample of about ``ranges * SAMPLES_PER_RANGE`` keys and
    one row for each range.
    """
    size = ranges * SAMPLES_PER_RANGE
    drawn = _sample(units, size / max(total, 1), 0)
    bounds = np.unique(drawn[np.linspace(0, len(drawn) - 1, ranges + 1).astype(int)[1:-1]]) if len(drawn) else drawn
    n_units = units.count()
    for salt in range(1, 6):
        inside = units.withColumn("r", _range_of(bounds)("h"))
        seen = inside.groupBy("r").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        full = {x["r"]: x for x in seen if x["lo"] != x["hi"] and (x["bytes"] > 2 * total / ranges or x["n"] > 2 * n_units / ranges + SAMPLES_PER_RANGE)}
        if not full:
            break
        # rows weigh as well as bytes here, so that a range of many tiny rows is cut too
        rate = F.col("bytes") * F.lit(size / max(total, 1)) + F.lit(size / max(n_units, 1))
        draw = F.xxhash64("h", "chunk", F.lit(salt)) / F.lit(float(1 << 64)) + F.lit(0.5)
        more = inside.where(F.col("r").isin(list(full)) & (draw < rate)).select("h", "r").toPandas()
        cuts = [bounds]
        for r, keys in more.groupby("r")["h"]:
            parts = int(np.ceil(max(full[r]["bytes"] * ranges / max(total, 1), full[r]["n"] * ranges / max(n_units, 1)))) + 1
            keys = np.sort(keys.to_numpy(np.int64))
            cuts.append(keys[np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1]])
        grown = np.unique(np.concatenate(cuts))
        if len(grown) == len(bounds):
            break
        bounds = grown
    return bounds


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return (doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    The law is ``bytes``: a row's size is its UTF-8 bytes plus 1, and shards hold
    nearly equal sums. Rows are ordered by a hash of the text, then the id, so
    equal texts are neighbours; boundaries come from size-weighted samples, and
    exact running sums inside ranges place each group; there are more ranges as
    there are more groups. Equal texts share a shard while they hold at most a
    sixteenth of one; groups that are large by bytes or by rows are cut into
    chunks of rows, so no group gathers in one task, be it of one id even. ``slot`` numbers the
    rows of a shard from 0 without gaps. Null texts count as empty; null and
    repeated ids are ordinary rows; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("h")
    )
    base = materialize(base, "sizes")
    n_rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / shards
    limit, most = max(1.0, share / UNITS_PER_SHARD), max(1.0, n_rows / shards / UNITS_PER_SHARD)
    # groups above either limit are at most twice shards * UNITS_PER_SHARD: a proven bound for the broadcast
    parts = F.ceil(F.greatest(F.col("b") / limit, F.col("n") / most))
    large = base.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) | (F.col("n") > most)).select("h", parts.alias("parts"))
    base = base.join(F.broadcast(large), "h", "left")
    # the row's number is drawn once, as the chunks are written; it splits rows of one id
    base = base.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), "parts"), F.lit(0)).cast("long")).drop("parts")
    base = materialize(base, "chunks")
    units = materialize(base.groupBy("h", "chunk").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "units")
    ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, units.count() // UNITS_PER_RANGE))
    bounds = _splitters(units, total, ranges)

    placed = units.withColumn("r", _range_of(bounds)("h"))
    per_range = placed.groupBy("r").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).orderBy("r").toPandas()
    per_range["bytes0"], per_range["rows0"] = per_range["bytes"].cumsum() - per_range["bytes"], per_range["rows"].cumsum() - per_range["rows"]
    schema = "r int, bytes0 long, rows0 long"
    starts = docs.sparkSession.createDataFrame([(int(a), int(b), int(c)) for a, b, c in per_range[["r", "bytes0", "rows0"]].to_numpy()], schema)
    by_key = Window.partitionBy("r").orderBy("h", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(F.broadcast(starts), "r")
    placed = placed.withColumn("at", F.col("bytes0") + F.coalesce(F.sum("bytes").over(by_key), F.lit(0)))
    placed = placed.withColumn("first_row", F.col("rows0") + F.coalesce(F.sum("rows").over(by_key), F.lit(0)))
    group = Window.partitionBy("r", "h")
    placed = placed.withColumn("g_at", F.min("at").over(group)).withColumn("g_bytes", F.sum("bytes").over(group))
    middle = F.when(F.col("g_bytes") <= share / 16, F.col("g_at") + F.col("g_bytes") / 2).otherwise(F.col("at") + F.col("bytes") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int"))
    placed = materialize(placed.select("h", "chunk", "shard", "first_row"), "placed")
    heads = placed.groupBy("shard").agg(F.min("first_row").alias("head"))
    placed = placed.join(F.broadcast(heads), "shard").select("h", "chunk", "shard", (F.col("first_row") - F.col("head")).alias("slot0"))
    within = F.row_number().over(Window.partitionBy("h", "chunk").orderBy("doc_id")) - 1
    return base.withColumn("k", within).join(placed, ["h", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("k")).cast("long").alias("slot"))
