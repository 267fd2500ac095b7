"""License scans against a search word by word; notices with changed words; no Python worker; odd tables."""

import random
import re

from tilewright.llm import license_scan as L

PLAIN = L.PHRASES[0].words


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_phrases_match_a_search_of_words(spark):
    r, rows = random.Random(3), []
    parts = ["GNU General Public License", "apache", "License", "cc", "BY", "MIT", "mit license", "cc-by", "General", "é", "ſs", "public", "K", "gnu\ngeneral", "CC\tBY", "of the"]
    for i in range(200):
        rows.append((i, r.choice([" ", ". ", "\n", "/"]).join(r.choice(parts) for _ in range(r.randrange(0, 40)))))
    rows += [(200, None), (201, ""), (202, "cc by " * 20_000), (203, "..."), (204, "MIT"), (None, "MIT license"), (204, "MIT")]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as row", "'b' as template", "'c' as label", "'d' as at"), L.PHRASES)
    assert got.columns == ["doc_id", "n_words", "spans", "score"]
    found = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["n_words"], [(s["start"], s["end"], s["label"]) for s in x["spans"]]) for x in got.collect()), key=repr)
    want = []
    for i, text in rows:
        words = _words(text)
        places = sorted((k, k + len(t.words.split()), t.label) for t in L.PHRASES for k in range(len(words)) if words[k : k + len(t.words.split())] == t.words.split())
        want.append((i is None, i or 0, len(words), places))
    assert found == sorted(want, key=repr)


def test_notices_with_changed_words(spark):
    mit = next(t for t in L.NOTICES if t.label == "mit").words.split()
    cut, put, other = [*mit[:8], *mit[10:]], [*mit[:9], "really", "quite", *mit[9:]], [w if k % 3 else "word" for k, w in enumerate(mit)]
    rows = [(1, " ".join(mit).upper()), (2, "Hello. " + " ".join(cut) + " end"), (3, ", ".join(put)), (4, " ".join(other)), (5, "Licensed under CC BY-NC 4.0."), (6, "GNU General Public License, version 2"), (7, " ".join(reversed(mit)))]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("labels", L.labels_of()).withColumn("base", L.labels_of(exact=True)).collect()}
    assert [got[k]["labels"] for k in range(1, 8)] == ["mit", "mit", "mit", "", "cc-by,cc-by-nc", "gpl,gpl-2.0", ""]
    assert got[1]["score"] == 1 and (got[2]["spans"][0]["start"], got[2]["spans"][0]["end"]) == (1, 1 + len(cut)) and 0.75 <= got[3]["score"] < 1 and got[4]["score"] < 0.75
    assert got[5]["base"] == "cc-by" and got[6]["base"] == "gpl" and got[7]["score"] < 0.2


def test_no_python_worker_and_no_other_shuffle_than_of_hits(spark):
    docs = spark.createDataFrame([(1, "MIT license")], "doc_id long, text string")
    plan = L.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 3 and "BroadcastHashJoin" in plan


def test_empty_tables_and_templates(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in L.scan_licenses(spark.createDataFrame([(1, "MIT license")], "doc_id long, text string"), ()).collect()] == [(1, 2, [], 0.0)]
