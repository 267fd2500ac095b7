"""URL verdicts by host-suffix and path-prefix rules, found by an equi-join on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule_host string, rule_path string, action string"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, action); a path may be empty."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """Return ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, all its own columns first.

    Each distinct (host, path) is expanded into the host suffixes times the path
    prefixes of those lengths that rules have, however long the url is. The expressions meet the rules by
    equality of the first ``prefix_bytes`` bytes of a SHA-256 digest; a full
    digest then confirms a match. Of several rules that fit, the longest (host,
    then path) wins, and ``block`` before ``allow`` at a tie. Null urls and urls
    without ``://`` have an empty host and path and get ``default``. Columns of
    ``pages`` named like a result are replaced; repeated rows each get the
    verdict; an empty table gives an empty result. Hosts of rules are lower-cased
    (A-Z), and rules without a host fit nothing. Rules are broadcast by a checked
    size, and joined by a shuffle beyond it.
    """
    keys = rules.select(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "action").where("rule_host <> ''")
    keys = keys.select(
        F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_len"), F.length("rule_path").alias("path_len"), "action",
        F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256).alias("digest"),
    )
    keys = keys.withColumn("short", F.substring("digest", 1, 2 * prefix_bytes))
    lengths, host_lengths, n_rules, longest = keys.agg(F.collect_set("path_len"), F.collect_set("host_len"), F.count("*"), F.max(F.length("rule"))).first()
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    targets = parsed.select("host", "path").where("host <> ''").distinct()
    of = lambda found: F.explode(F.array(*[F.lit(n) for n in sorted(found)]) if found else F.expr("array(0)"))
    # a suffix is the whole host or begins after a dot
    each = targets.withColumn("k", of(host_lengths)).where("k = length(host) or (k < length(host) and substring(host, length(host) - k, 1) = '.')")
    each = each.withColumn("suffix", F.expr("right(host, k)")).withColumn("n", of(lengths)).where("n <= length(path)")
    digest = F.sha2(F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, n)")), 256)
    each = each.select("host", "path", digest.alias("full")).withColumn("short", F.substring("full", 1, 2 * prefix_bytes))
    keys = F.broadcast(keys) if small_enough(n_rules, 2 * (longest or 0) + 200) else keys
    order = F.struct(F.length("rule"), "host_len", (F.col("action") == "block").cast("int"), "rule", "action")
    found = each.join(keys, "short").where("full = digest").groupBy("host", "path").agg(F.max(order).alias("best"))
    found = materialize(found.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict")), "verdicts")
    # rows without a host match nothing; a salt keeps them from sharing one key of the join
    own = parsed.select(F.struct(*[F.col(f"`{c}`") for c in parsed.columns]).alias("own"), "host", "path", F.when(F.col("host") == "", 1 + F.monotonically_increasing_id() % 997).otherwise(0).alias("salt"))
    judged = own.join(found.withColumn("salt", F.lit(0).cast("long")), ["host", "path", "salt"], "left")
    return judged.select(*[F.col("own")[c].alias(c) for c in parsed.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
