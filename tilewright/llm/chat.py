"""Chat transcripts formatted and read back with Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed control strings of the template. All begin with "<|", which escaped texts never contain.
TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"


def escape(text: Column) -> Column:
    """Make ``<|`` unwritable: a run of ``&`` after ``<`` grows by one, and ``<|`` gets its first."""
    return F.replace(F.replace(text, F.lit("<&"), F.lit("<&&")), F.lit("<|"), F.lit("<&|"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.replace(F.replace(text, F.lit("<&|"), F.lit("<|")), F.lit("<&&"), F.lit("<&"))


def _run_starts(turns: Column) -> Column:
    """Places (from 1) of the turns whose role is not that of the turn before."""
    role = lambda i: F.get(turns, i)["role"]
    return F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (role(i - 1) != role(i - 2)))


def _merged(turns: Column, starts: Column) -> Column:
    """Adjacent turns of one role become one struct whose ``texts`` holds each of them; each turn is sliced out once."""

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(turns) + 1)
        return F.struct(F.get(turns, start - 1)["role"].alias("role"), F.transform(F.slice(turns, start, end - start), lambda t: t["text"]).alias("texts"))

    return F.transform(starts, run)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Return one row per conversation: (conv_id, formatted, n_merged).

    Turn structs are collected and sorted by turn (nulls first; ties by role,
    then text), adjacent turns of one role are merged, and each merged turn is
    written as ``<|turn|>role<|text|>text(<|more|>text)*<|end|>`` with roles and
    texts escaped. Null roles and texts are empty; a null id is a conversation of
    its own. A conversation's text is one value, so it must fit in one row;
    conversations are spread over tasks by their id. Other columns are ignored,
    and an empty table gives an empty result.
    """
    own = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    packed = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "role", "text"))).alias("turns"))
    packed = packed.select("conv_id", "turns", _run_starts(F.col("turns")).alias("starts"))
    packed = packed.select("conv_id", _merged(F.col("turns"), F.col("starts")).alias("merged"))
    body = F.transform(
        "merged",
        lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), F.array_join(F.transform(m["texts"], escape), MORE), F.lit(END)),
    )
    return packed.select("conv_id", F.array_join(body, "").alias("formatted"), F.size("merged").cast("long").alias("n_merged"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` into ``turns``: array<struct<role, text, loss>>, one for each original row.

    ``loss`` marks the assistant's texts; control strings and roles are outside
    the mask. Null input gives no turns.
    """
    parts = F.filter(F.split(F.coalesce("formatted", F.lit("")), r"\Q" + END + r"\E", -1), lambda p: p != "")

    def turns(p: Column) -> Column:
        # each part is split once: what is bound to a lambda's variable is not worked out again for every text
        head = F.array(F.split(F.substring(p, len(TURN) + 1, 2147483647), r"\Q" + TEXT + r"\E", -1))
        split = F.transform(head, lambda h: F.struct(unescape(h[0]).alias("role"), F.split(h[1], r"\Q" + MORE + r"\E", -1).alias("texts")))
        return F.flatten(F.transform(split, lambda m: F.transform(m["texts"], lambda t: F.struct(m["role"].alias("role"), unescape(t).alias("text"), (m["role"] == "assistant").alias("loss")))))

    return formatted.withColumn("turns", F.flatten(F.transform(parts, turns)))
