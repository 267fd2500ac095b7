import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm.language_id import FOLD, LANE, learn_samples, phrase_counts, predict, suffix_automaton

SAMPLES = (("aa", b"the cat sat on the mat and then the dog sat too " * 3), ("bb", "le chat était assis près de la fenêtre avec élan ".encode() * 3))


def _phrases(text: bytes, sample: bytes) -> int:
    """Greedy parse by looking for ever longer substrings."""
    text, sample, total = bytes(FOLD[list(text)]), bytes(FOLD[list(sample)]), 0
    for at in range(0, len(text), LANE):
        lane, i = text[at : at + LANE], 0
        while i < len(lane):
            k = i + 1
            while k < len(lane) and lane[i : k + 1] in sample:
                k += 1
            total, i = total + 1, k
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="the catsondé ñZ9.\n", max_size=700), max_size=6))
def test_phrases_match_brute_force(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = phrase_counts(np.frombuffer(b"".join(raw), np.uint8), off, SAMPLES)
    assert got.tolist() == [[_phrases(r, s) for r in raw] for _, s in SAMPLES] or not texts


def test_automaton_reads_exactly_the_substrings():
    step = suffix_automaton(b"abcabxab")

    def reads(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    text = b"abcabxab"
    subs = {text[i:j] for i in range(9) for j in range(i, 9)}
    assert all(reads(s) for s in subs) and not reads(b"ba") and not reads(b"abxabc")


def test_prediction_and_odd_rows(spark):
    rows = [(1, "the dog and the cat", "old", 9.0), (2, "le chat près de la fenêtre", None, None), (3, None, None, None), (4, "", None, None), (5, "123 !? 4", None, None), (6, "the cat " * 30000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in predict(docs, SAMPLES).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert got[3]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert predict(docs.where("doc_id < 0"), SAMPLES).count() == 0
    assert {r["lang_pred"] for r in predict(docs, ()).collect()} == {"und"}


def test_learning_skips_unlabelled_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, "en"), (3, "rien", None), (None, "x", "zz")], "doc_id long, text string, lang string")
    assert dict(learn_samples(docs, F.col("doc_id").isNotNull())) == {"en": b"\nsome text"}
    assert learn_samples(docs.where("doc_id = 3"), F.lit(True)) == ()


def test_runs_of_one_letter(spark):
    """Phrases and lanes never fall into step here; counts are still those of one parse, in time that grows with the text."""
    samples = (("aa", b"a-- b--- c" + b"-" * 7 + b"x"), ("bb", b"- . -" + b"-" * 13))
    for text in (b"-" * 40_000, b"--. " * 9000 + b"-" * 5000, b"-" * 3 * LANE):
        raw = np.frombuffer(text + b"a word" + text[:5000], np.uint8)
        off = np.array([0, len(text), len(raw)], np.int64)
        got = phrase_counts(raw, off, samples)
        for k, (_, sample) in enumerate(samples):
            for j in range(2):
                own = bytes(FOLD[raw[off[j] : off[j + 1]].tolist()])
                assert got[k][j] == _one_parse(own, bytes(FOLD[list(sample)]))
    began = time.time()
    rows = spark.createDataFrame([(1, "-" * 10_000_000 + " a b")], "doc_id long, text string")
    assert predict(rows, samples).count() == 1 and time.time() - began < 60


def _one_parse(text: bytes, sample: bytes) -> int:
    total = i = 0
    while i < len(text):
        k = i + 1
        while k < len(text) and text[i : k + 1] in sample:
            k += 1
        total, i = total + 1, k
    return total
