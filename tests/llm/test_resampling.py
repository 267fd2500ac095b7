"""Importance resampling against its definition; hot buckets, repeated ids, odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import resampling as R
from tilewright.llm.text_arrays import utf8


def _features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def _expected(docs, target, buckets, percent, least, seed):
    """(doc_id, n_features, weight, score) and the drawn, in order."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in _features(text)[1]) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, features = _features(text)
        gains = [math.floor(1000 * math.log(((t[of(f)] + 1) * (big_s + buckets)) / ((s[of(f)] + 1) * (big_t + buckets)))) for f in features]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[: len(able) * percent // 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB-é Z9_\n" + "x" * 3, max_size=90), min_size=1, max_size=5), st.sampled_from([3, 50, 1 << 16]))
def test_counts_match_brute_force(texts, chunk):
    old, R.CHUNK = R.CHUNK, chunk
    try:
        bucket, row, n, words = R.feature_counts(*utf8(pa.array(texts)), 97)
    finally:
        R.CHUNK = old
    got = {(b, r): k for b, r, k in zip(bucket.tolist(), row.tolist(), n.tolist())}
    assert got == Counter((zlib.crc32(f.encode()) % 97, i) for i, t in enumerate(texts) for f in _features(t)[1])
    assert words.tolist() == [len(_features(t)[0]) for t in texts]


def test_draws_match_the_definition(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    words = ["the", "Cat", "sat", "été", "x1", "of", "mat", "w" * 70]
    docs = [(i, " ".join(words[(i * k + k * k) % 8] if k % 3 else "the" for k in range(i % 40))) for i in range(120)]
    docs += [(5, docs[5][1]), (5, "the cat sat " * 9), (None, "of the mat " * 10), (None, None), (300, ""), (301, None), (302, "the " * 30_000)]
    target = ["the cat sat on the mat", None, "été x1 x1", ""]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    frames[0].write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/resampled")
    rows, drawn = _expected(docs, target, 50, 30, 12, "9")
    for extra in (False, True):
        own = spark.read.parquet(path)
        own = own.selectExpr("*", "'x' as own", "1 as rank", "2 as part", "3 as block") if extra else own
        got = R.resample(own, frames[1], 30, 12, "9", 50).collect()
        key = lambda r: tuple((v is not None, v) for v in r)
        assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(rows, key=key)
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_one_shuffle_of_postings_serves_both(spark):
    rows = spark.createDataFrame([(k, "a b c " * k) for k in range(30)], "doc_id long, text string")
    rows.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/postings")
    weighed = R.weigh(spark.read.parquet(path), rows.select("text"))
    assert len(weighed.collect()) == 30
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert R.resample(none, some).collect() == []
    (row,) = R.resample(some, none, percent=100).collect()
    assert row["rank"] == 1 and row["weight"] == _expected([(1, "a b c " * 9)], [], R.BUCKETS, 100, 20, "7")[0][0][3]
