"""License notices found by diagonal voting: k-gram hashes joined to template positions, with DataFrame functions alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import small_enough

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Diagonals of one notice lie no further apart than the words put in or left out between two of its parts.
DRIFT = 3


class Template(NamedTuple):
    """Words of a license that are looked for, two at least; ``share`` of its pairs of words must be found.

    An exact template must stand word by word; others may have words changed,
    put in or left out.
    """

    label: str
    words: str
    share: float = 1.0
    exact: bool = False


#: Phrases that name a license, and their labels.
PHRASES = (
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
)
#: Opening words of public licenses, and names with a version.
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.75),
    Template("apache-2.0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.75),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.75),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.75),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.75),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.75),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", 0.75),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.75),
)


def template_rows(templates: tuple[Template, ...]) -> list[tuple]:
    """(template, label, exact, share, grams, place, first, second) of every pair of neighbouring words of the templates."""
    out = []
    for n, t in enumerate(templates):
        words = t.words.split()
        if len(words) < 2:
            raise ValueError(f"a template has two words at least: {t.words!r}")
        out += [(n, t.label, t.exact, t.share, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def _positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = template_rows(templates)
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, share double, grams int, place int, first string, second string").withColumn("gram", F.xxhash64("first", "second"))
    longest = max((len(r[1]) + len(r[6]) + len(r[7]) for r in rows), default=0)
    return F.broadcast(made) if small_enough(len(rows), 64 + longest) else made


def _grams(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, at, a, b, gram): every word with the next one; the last of a text has none, and a text without words one row of nulls."""
    words = F.array_remove(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), BETWEEN), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), words.alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))").alias("b"))
    each = rows.select("row", "doc_id", F.posexplode_outer(pairs).alias("at", "pair"))
    # other letters than A-Z may be folded here: the words themselves decide below, and templates are plain ASCII
    gram = F.when(F.col("pair.b").isNotNull(), F.xxhash64(F.lower("pair.a"), F.lower("pair.b")))
    return each.select("row", "doc_id", "at", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), gram.alias("gram"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of license templates in every text, one result row for each row.

    Result: (doc_id, n_words, spans, score). ``spans`` are the verified places,
    ordered: (start, end, label, exact, score), words numbered from 0, ``end``
    being the word after the last; ``score`` of a span is the share of the
    template's pairs of words in it, that of a row the largest share of any
    template, verified or not (0 if no pair is found).

    Every pair of neighbouring words is joined by its hash to the places of the
    templates, and the words must be equal; pairs are counted by diagonal (place
    in the text minus place in the template), diagonals up to ``DRIFT`` apart are
    merged unless the template is exact, and a span holds if it has ``share`` of
    the template's pairs at different places. Counting starts before the shuffle,
    whose rows are one for each row and one for each diagonal that was hit.

    Words are runs of digits, ASCII letters of either case and all characters
    beyond ASCII. Null and empty texts have no words and no spans. Repeated rows
    are answered each; null ids stay; overlapping places all count; other columns
    are not looked at; an empty table gives an empty result. The words of a text
    are in one task's memory.
    """
    spots = _positions(docs.sparkSession, templates)
    grams = _grams(docs, doc_id, text)
    plain = lambda c: F.translate(c, UPPER, LOWER)
    met = grams.join(spots, (grams["gram"] == spots["gram"]) & (plain("a") == F.col("first")) & (plain("b") == F.col("second")), "left")
    # a row's last word stays without a template: it tells how many words there are
    met = met.where("template is not null or b is null")
    key = ["row", "template", "diagonal"]
    votes = met.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*key).agg(
        F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("share").alias("share"), F.first("grams").alias("grams"),
        F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"), F.max(F.when(F.col("b").isNull(), F.coalesce(F.col("at") + 1, F.lit(0)))).alias("n_words"),
    )
    # dealt by row once: windows and groups below need no other shuffle
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by)) > F.when(F.col("exact"), 0).otherwise(DRIFT)
    merged = votes.repartition("row").withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("span", F.sum("apart").over(by))
    spans = merged.groupBy("row", "template", "span").agg(
        F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("share").alias("share"), F.max("n_words").alias("n_words"),
        F.min("low").alias("start"), (F.max("high") + 2).alias("end"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("grams")).alias("score"),
    )
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "exact", "score")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("score") >= F.col("share"), span))).alias("spans"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).select("doc_id", "n_words", "spans", "score")


def labels_of(spans: str = "spans", exact: bool = False) -> Column:
    """The distinct labels of the spans, or of exact ones alone, sorted and joined by commas."""
    wanted = F.filter(spans, lambda s: s["exact"]) if exact else F.col(spans)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(wanted, lambda s: s["label"]))), ",")
