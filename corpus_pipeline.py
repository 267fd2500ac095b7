"""A training corpus from ``documents``: five stages, each of one operator, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontamination, language_id, line_dedup, near_dedup, sentence_pieces
from tilewright.storage import materialize, small_enough

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least similarity of near copies by their word shingles.
NEAR_PERCENT = 80
#: Where the public tokenizers are.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go; a missing ``lang`` is filled in."""
    samples = language_id.learn_samples(docs, F.lit(True))
    told = language_id.predict(docs, samples).where("lang_pred <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, but for their first; documents left without any text go too."""
    done = line_dedup.dedup_lines(docs)
    rest = done.where("n_dropped = 0 or length(trim(text)) > 0")
    return rest.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id; of rows of one id, one.

    Rows without an id stay.
    """
    judged = materialize(near_dedup.near_duplicates(docs, NEAR_PERCENT), "judged")
    gone = judged.where("not kept").select("doc_id").distinct()
    many = judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).where("n > 1 and kept").select("doc_id")
    gone, many = (F.broadcast(x) if small_enough(x.count(), 40) else x for x in (materialize(gone, "gone"), materialize(many, "many")))
    rest = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    if many.isEmpty():
        return rest
    first = rest.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return rest.join(many, "doc_id", "left_anti").select(*COLUMNS).union(first.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    marked = decontamination.mark_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("passages") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    coded = sentence_pieces.decode(sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"), MODEL), MODEL)
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentence_pieces", tokens),
]

#: Stages one and five learn or search in ways that SQL cannot say; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each stage's rows written and read again.

    Result: (doc_id, lang, source, n_tokens, ids, round_trip) of each document
    that stays. Null and empty texts have no letter and go with the first stage;
    null ids stay rows of their own, whose lines give way to equal ones of other
    documents; of rows of one id and near copies, one stays, the smallest by its
    columns; of equal lines, the first by id and place. Texts of any length are
    read whole. Other columns of ``documents`` are left out, and an empty table
    gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
