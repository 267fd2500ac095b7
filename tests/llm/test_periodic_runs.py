"""Runs of words against brute force; texts of one word, very long texts, odd tables; the query's rows by the contract."""

import hashlib
import os
import random
import time
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import periodic_runs as P
from tilewright.llm import queries
from tilewright.llm.text_arrays import utf8

SF = "/root/testdata/sf0.001"


def _runs(words):
    """Every period, every stretch; the smallest period of each stretch."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((start, length, q) for (start, length), q in best.items())


def _collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", "a b", "\n", "A"]), max_size=60).map(" ".join), min_size=1, max_size=5), st.sampled_from([8, 64, P.PAIRS]))
def test_runs_match_brute_force(texts, pairs):
    old, P.PAIRS = P.PAIRS, pairs
    try:
        n, runs, collapsed = P._of_block(*utf8(pa.array([*texts, None])))
    finally:
        P.PAIRS = old
    for text, m, found, rest in zip([*texts, ""], n.tolist(), runs.to_pylist(), collapsed.to_pylist()):
        words = text.split()
        assert m == len(words) and [(r["start"], r["length"], r["period"]) for r in found] == _runs(words)
        assert rest == _collapsed(words, _runs(words))


def test_words_decide_where_hashes_are_wrong(monkeypatch):
    """With a hash that is the same for all words, stretches come from the words alone."""
    monkeypatch.setattr(P, "mix", lambda x: x * 0 + 1)
    r = random.Random(4)
    words = [r.choice("ab") for _ in range(300)] + ["x", "y"] * 9 + [r.choice("ab") for _ in range(50)]
    _, runs, _ = P._of_block(*utf8(pa.array([" ".join(words)])))
    assert [(x["start"], x["length"], x["period"]) for x in runs.to_pylist()[0]] == _runs(words)


def test_very_long_texts(spark):
    texts = ["a " * 1_000_000, "a b " * 200_000 + "c " * 200_000, " ".join(str(i % 5000) for i in range(400_000)), "w" * 3_000_000]
    began = time.time()
    got = {r["doc_id"]: r for r in P.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 1_000_000, 1)] and got[0]["collapsed"] == "a"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 400_000, 2), (400_000, 200_000, 1)] and got[1]["collapsed"] == "a b c"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 400_000, 5000)] and got[3]["runs"] == [] and got[3]["n_words"] == 1
    assert time.time() - began < 90


def test_odd_tables(spark):
    rows = [(1, None, "x", 7), (1, None, "x", 7), (None, "a a a a a a", None, 8), (2, "", "y", 9)]
    got = P.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, own string, n_words long"))
    assert got.columns == ["doc_id", "own", "n_words", "runs", "collapsed"]
    assert sorted((r["doc_id"] or 0, r["own"] or "", r["n_words"], r["collapsed"]) for r in got.collect()) == [(0, "", 6, "a"), (1, "x", 0, ""), (1, "x", 0, ""), (2, "y", 0, "")]
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_the_query_by_the_contract(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, h = (d["text"] or "").split(), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = _runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        row = got[d["doc_id"]]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()


def test_the_query_on_texts_without_words(spark, tmp_path):
    ids = [next(i for i in range(1000) if (zlib.crc32(str(i).encode()) % 10 == 0) == edited) for edited in (True, False)]
    rows = [(i, text) for i in ids for text in (None, "", " \n\t")] + [(5000, "a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    none = hashlib.sha256(b"").hexdigest()
    assert got[:6] == sorted((i, 0, None, None, None, None, none, none) for i in ids for _ in range(3))
    assert got[6][:2] == (5000, 1) and len(got) == 7
