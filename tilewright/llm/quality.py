"""Text quality by an additive model with pairwise interactions, learned by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_arrays import blocks, packed, pieces, unpacked, utf8, words

SAMPLE_ROWS = 20_000
MAX_BINS = 32
FEATURES = ("log_bytes", "lower", "upper", "digit", "space", "line_end", "stop", "symbol", "high_byte", "word_len", "word_len_sd", "distinct_words", "commonest_word", "words_a_line", "words_a_stop", "symbol_words")


def _classes() -> np.ndarray:
    kinds = np.zeros((7, 256), bool)
    for c in range(256):
        k = 0 if 97 <= c < 123 else 1 if 65 <= c < 91 else 2 if 48 <= c < 58 else 3 if c in (9, 32) else 4 if c in (10, 13) else 5 if c in b".,;:?" else 6
        kinds[k, c] = c < 128
    return kinds


KINDS = _classes()
#: The kind of each byte; bytes of no kind have the next number.
KIND = np.where(KINDS.any(axis=0), KINDS.argmax(axis=0), len(KINDS)).astype(np.uint8)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The feature matrix (rows, len(FEATURES)) of texts given as bytes; an empty text has zeros.

    Bytes are counted piece by piece, so beside the text only its words take memory.
    """
    rows = len(off) - 1
    size = np.diff(off)
    out = np.zeros((rows, len(FEATURES)))
    if not len(raw):
        return out
    row, start, end, hashed = words(raw, off)
    sums, symbol_words, wide = np.zeros((rows, len(KINDS)), np.int64), np.zeros(len(start), bool), len(KINDS) + 1
    for a, b in pieces(len(raw)):
        kind = KIND[raw[a:b]]
        lead = int(np.searchsorted(off, a, side="right")) - 1
        owner = np.searchsorted(off, np.arange(a, b), side="right") - 1 - lead if b > off[lead + 1] else 0
        counts = np.bincount(owner * wide + kind)
        counts = np.pad(counts, (0, -len(counts) % wide)).reshape(-1, wide)
        sums[lead : lead + len(counts)] += counts[:, :-1]
        symbols = np.flatnonzero(kind == 6) + a
        word = np.searchsorted(start, symbols, side="right") - 1
        symbol_words[word[(word >= 0) & (symbols < end[word])] if len(end) else word[:0]] = True
    full = np.flatnonzero(size)
    some = size[full][:, None]
    out[full, 0] = np.log1p(size[full])
    out[full, 1:8] = sums[full] / some
    out[full, 8] = 1 - sums[full].sum(axis=1) / some[:, 0]
    n = np.bincount(row, minlength=rows)
    any_word = np.maximum(n, 1)
    length = (end - start).astype(float)
    out[:, 9] = np.bincount(row, weights=length, minlength=rows) / any_word
    out[:, 10] = np.sqrt(np.maximum(np.bincount(row, weights=length * length, minlength=rows) / any_word - out[:, 9] ** 2, 0))
    first = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero(n):
        own = np.sort(hashed[first[i] : first[i + 1]])
        turns = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        out[i, 11] = (len(turns) - 1) / len(own) ** 0.8
        out[i, 12] = np.diff(turns).max() / len(own)
    out[:, 13], out[:, 14] = np.log1p(n / (sums[:, 4] + 1)), np.log1p(n / (sums[:, 5] + 1))
    out[:, 15] = np.bincount(row, weights=symbol_words, minlength=rows) / any_word
    return out


@dataclass
class Additive:
    """Lookup tables: ``edges[f]`` cut feature f into bins, ``main[f]`` and ``pair[f, g]`` hold log-odds by bin."""

    edges: list[np.ndarray]
    bias: float = 0.0
    main: list[np.ndarray] = field(default_factory=list)
    pair: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by adding table entries."""
        b = self.bins(x)
        odds = np.full(len(x), self.bias)
        for f, table in enumerate(self.main):
            odds += table[b[:, f]]
        for (f, g), table in self.pair.items():
            odds += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step values by bin from a tree of few leaves over one feature's gradient sums."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = _gain(gl, hl) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl) - _gain(g[a:b].sum(), h[a:b].sum())
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), a + k + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of one cut on each of two features: (gain, step values by cell)."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def quads(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, c[-1, -1] - top - left + a]

    qg, qh = quads(G), quads(H)
    gain = sum(_gain(a, b) for a, b in zip(qg, qh))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for k, (rs, cs) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rs, cs] = qg[k][i, j] / (qh[k][i, j] + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, pairs: int = 6) -> Additive:
    """Learn main tables by cycling over the features, then tables of the strongest pairs on what is left.

    With no rows the model scores one half; with one class, near that class.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, MAX_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Additive(edges)
    model.main = [np.zeros(len(e) + 1) for e in edges]
    if not len(y):
        return model
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model.bias = float(np.log(mean / (1 - mean)))
    b, odds = model.bins(x), np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.main):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)))
            table += step
            odds += step[b[:, f]]

    def grid(f: int, g: int, w: np.ndarray) -> np.ndarray:
        wide = len(model.main[g])
        return np.bincount(b[:, f] * wide + b[:, g], w, len(model.main[f]) * wide).reshape(-1, wide)

    g0, h0 = slopes()
    ranked = sorted(((_cross_tree(grid(f, g, g0), grid(f, g, h0))[0], f, g) for f, g in combinations(range(x.shape[1]), 2)), reverse=True)[:pairs]
    model.pair = {(f, g): np.zeros((len(model.main[f]), len(model.main[g]))) for gain, f, g in ranked if gain > 0}
    for _ in range(rounds // 2):
        for (f, g), table in model.pair.items():
            gr, he = slopes()
            step = rate * _cross_tree(grid(f, g, gr), grid(f, g, he))[1]
            table += step
            odds += step[b[:, f], b[:, g]]
    return model


def _mapped(rows: DataFrame, kind: T.DataType, made, name: str) -> DataFrame:
    """``rows`` without their ``text``, and the column ``name`` that ``made`` builds of the texts' features."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in kept], made(features(*utf8(block.column("text"))))], names=[*kept, name])

    return rows.mapInArrow(run, rows.select(*kept).schema.add(name, kind))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on about ``sample_rows`` labelled rows, drawn by a hash of their id among those in ``learn_from``.

    Only their feature vectors reach the driver. Labels other than 0 and 1, null
    labels and labels of unknown documents are not used; a document labelled
    twice counts with its largest label, a document that is there twice counts
    twice, and a null text as an empty one. Without any labelled row the model
    scores one half.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(learn_from)
    known = known.groupBy("doc_id").agg(F.max("y").cast("long").alias("y"))
    rate = sample_rows / max(1, known.count())
    known = known.where(F.xxhash64("doc_id", F.lit("quality sample")) / F.lit(float(1 << 64)) + 0.5 < rate)
    # at most about sample_rows small rows: a bound that holds at every size
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    seen = _mapped(rows, T.ArrayType(T.DoubleType()), lambda x: pa.array(list(x), pa.list_(pa.float64())), "x").orderBy("doc_id", "x").toPandas()
    if not len(seen):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(float))


def score(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, the chance of label 1) to ``docs``, replacing a column of that name.

    Null texts score as empty; repeated rows score alike; an empty table gives
    an empty result, and no name of another column clashes. A task holds about
    1 MB of text at a time or one longer text, with some bytes for each of its
    words.
    """
    rows, kept = packed(docs, ["score"], text=F.col(text).cast("string"))
    return unpacked(_mapped(rows, T.DoubleType(), lambda x: pa.array(model.score(x)), "score"), kept, "score")
