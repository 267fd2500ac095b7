"""Views of Arrow text columns as numpy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and each row's offsets into them; null is empty."""
    col = column.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def pieces(length: int) -> Iterator[tuple[int, int]]:
    """(from, to) of parts of at most ``BLOCK_BYTES`` each: what works on them needs no memory for a long row but for its results."""
    for at in range(0, length, BLOCK_BYTES):
        yield at, min(length, at + BLOCK_BYTES)


def packed(docs: DataFrame, replaced: list[str], **columns: Column) -> tuple[DataFrame, list[str]]:
    """(``own``, columns..): the caller's columns but ``replaced`` in one struct, so that no name of theirs can clash; and their names."""
    kept = [c for c in docs.columns if c not in replaced]
    own = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("struct<_:int>")
    return docs.select(own.alias("own"), *[c.alias(name) for name, c in columns.items()]), kept


def unpacked(rows: DataFrame, kept: list[str], *names: str) -> DataFrame:
    """The caller's columns, then the results ``names``."""
    return rows.select(*[F.col("own")[c].alias(c) for c in kept], *names)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for every place of a piece."""
    up, down = np.full(BLOCK_BYTES + 1, _BASE, np.uint64), np.full(BLOCK_BYTES + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: (row, start, end, hash of the word with A-Z lower-cased).

    The hash is a polynomial in the word's bytes, taken from running sums that
    are carried from piece to piece, so words may be longer than a piece.
    """
    up, down = _powers()
    starts, ends, low, high = [], [], [], []
    total, scale, back, open_ = np.uint64(0), np.uint64(1), np.uint64(1), False
    inverse = []
    edges = np.unique(off)
    for a, b in pieces(len(raw)):
        solid = ~SPACE[raw[a:b]]
        edge = np.zeros(b - a + 1, bool)
        edge[edges[np.searchsorted(edges, a) : np.searchsorted(edges, b, side="right")] - a] = True
        before = np.concatenate([[open_], solid[:-1]])
        first = np.flatnonzero(solid & (~before | edge[:-1]))
        # a word ends before a place that is no part of it, so each end belongs to the piece of that place
        last = np.flatnonzero(before & (~solid | edge[:-1]))
        sums = np.zeros(b - a + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((LOWER[raw[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
            sums *= scale
            sums += total
            starts.append(first + a)
            ends.append(last + a)
            low.append(sums[first])
            high.append(sums[last])
            inverse.append(down[first] * back)
            total, open_ = sums[-1], bool(solid[-1])
            scale, back = scale * up[b - a], back * down[b - a]
    if open_:
        ends.append(np.array([len(raw)]))
        high.append(np.array([total]))
    start, end, low, high, inverse = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((starts, np.int64), (ends, np.int64), (low, np.uint64), (high, np.uint64), (inverse, np.uint64)))
    hashed = mix((high - low) * inverse + (end - start).astype(np.uint64))
    return np.searchsorted(off, start, side="right") - 1, start, end, hashed


def shingles(raw: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word shingles as sorted 64-bit hashes: (hashes, offsets by row).

    A row with fewer words than ``size``, but one at least, has its whole
    sequence as its one shingle.
    """
    row, _, _, word = words(raw, off)
    rows, n = len(off) - 1, len(word)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    made = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        made *= np.uint64(_BASE)
        made += word[j : j + len(made)]
    whole = row[: len(made)] == row[size - 1 :] if len(made) else np.zeros(0, bool)
    hashes, owner = mix(made[whole]), row[: len(made)][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            value[has] = value[has] * np.uint64(_BASE) + word[first[short[has]] + j]
        hashes = np.concatenate([hashes, mix(value + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    if len(hashes):
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
        bounds = np.searchsorted(owner, np.arange(rows + 1))
    return hashes, bounds
