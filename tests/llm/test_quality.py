import numpy as np
from pyspark.sql import functions as F

from tilewright.llm import quality, text_arrays
from tilewright.llm.quality import FEATURES, features, fit, learn, score


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_main_effects_and_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0) | (x[:, 2] > 1.2)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert (0, 1) in model.pair and _auc(y[3000:], model.score(x[3000:])) > 0.95
    tables = model.bias + sum(t[b] for t, b in zip(model.main, model.bins(x[:1])[0])) + sum(t[model.bins(x[:1])[0, f], model.bins(x[:1])[0, g]] for (f, g), t in model.pair.items())
    assert abs(1 / (1 + np.exp(-tables)) - model.score(x[:1])[0]) < 1e-12


def test_degenerate_labels():
    assert fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((1, 3)))[0] == 0.5
    assert fit(np.ones((10, 3)), np.ones(10)).score(np.ones((1, 3)))[0] > 0.9


def test_features_do_not_depend_on_neighbours():
    texts = ["", "One two. THREE!! four", "", "é ✓ words\nmore | bars", "x" * 5000]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    together = features(np.frombuffer(b"".join(raw), np.uint8), off)
    alone = np.concatenate([features(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw])
    assert together.shape == (5, len(FEATURES)) and np.allclose(together, alone) and not together[0].any()


def test_held_out_rows_are_told_apart(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "run", "of", "the", "and"]
    rows = []
    for i in range(600):
        ws = rng.choice(vocabulary, 40)
        rows.append((i, " ".join(ws).capitalize() + "." if i % 4 else "!! ".join(ws).upper(), 7.0))
    docs = spark.createDataFrame(rows + [(None, None, None), (9999, None, None), (9998, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)] + [(3, None), (None, 1), (5, 7), (123456, 1)], "doc_id long, quality int")
    model = learn(docs, labels, F.col("doc_id") % 5 != 0)
    out = score(docs, model).toPandas()
    assert len(out) == 603 and out["score"].between(0, 1).all()
    held = out[(out["doc_id"] % 5 == 0) & (out["doc_id"] < 600)]
    assert _auc((held["doc_id"] % 4 > 0).to_numpy().astype(int), held["score"].to_numpy()) > 0.99
    assert score(docs.where("doc_id < -5"), model).count() == 0


def test_pieces_change_no_feature_or_shingle(monkeypatch):
    texts = ["", "One two. THREE,\n four* five\x0bsix", "a" * 300 + " b" * 200, " ", "é" * 100 + "\t#x#" * 50, "tail"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    want, sets = quality.features(data, off), text_arrays.shingles(data, off)
    for size in (1, 7, 64):
        monkeypatch.setattr(text_arrays, "BLOCK_BYTES", size)
        text_arrays._powers.cache_clear()
        assert np.allclose(quality.features(data, off), want)
        assert all((a == b).all() for a, b in zip(text_arrays.shingles(data, off), sets))
    monkeypatch.undo()
    text_arrays._powers.cache_clear()


def test_a_very_long_text_takes_bounded_memory():
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from tilewright.llm import decontamination, near_dedup, quality, text_arrays
raw = np.frombuffer(b"some words of a very long text that goes on, and on. " * (64 * (1 << 20) // 53), np.uint8)
off = np.array([0, len(raw)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality.features(raw, off)
near_dedup.minhashes(*text_arrays.shingles(raw, off))
index = decontamination.Index(((1, b"a passage that is nowhere in the text at all"),), 0.06)
decontamination._search(*decontamination.normalise(raw, off), index)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 1536, grown
