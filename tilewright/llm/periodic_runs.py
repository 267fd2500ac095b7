"""Stretches of words that repeat with a period: a harmonic grid of (period, place) pairs, extended by prefix hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_arrays import SPACE, blocks, mix, packed, pieces, unpacked, utf8

#: A run has at least so many words and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Pairs of period and place that are looked at together.
PAIRS = 1 << 18
_BASE = np.uint64(0xD6E8FEB86659FD93)
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def word_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, letters, ends): a number for each word, the same for words of the same bytes only; the words' bytes without white space and each word's end in them.

    Words are those between ASCII white space; ``off`` are the rows' offsets.
    The third value ends with the count of words before each row.
    """
    solid = np.zeros(len(raw) + 1, bool)
    for a, b in pieces(len(raw)):
        solid[a:b] = ~SPACE[raw[a:b]]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = solid[edge]
    letters = raw[solid[:-1]]
    starts = np.flatnonzero(first)
    # where each word begins once white space is gone
    begins = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])[starts]
    ends = np.concatenate([begins[1:], [len(letters)]]) if len(starts) else np.zeros(0, np.int64)
    bounds = np.concatenate([begins, [len(letters)]]).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, letters, np.concatenate([ends, np.searchsorted(starts, off)])


def _equal_length(sums: np.ndarray, powers: np.ndarray, i: np.ndarray, gap: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on (or before i, with ``back``) equal those ``gap`` later, at most ``most``: one binary search for all pairs at once."""
    low, high = np.zeros_like(most), most.copy()
    shift = powers[gap]
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        mid = (low[todo] + high[todo] + 1) >> 1
        a = i[todo] - mid if back else i[todo]
        b = a + mid
        g = gap[todo]
        with np.errstate(over="ignore"):
            same = (sums[b] - sums[a]) * shift[todo] == sums[b + g] - sums[a + g]
        low[todo[same]] = mid[same]
        high[todo[~same]] = mid[~same] - 1


def _exact(codes: np.ndarray, i: int, gap: int, top: int, bottom: int) -> tuple[int, int]:
    """The same extent word by word: (first place, place after the last) where words equal those ``gap`` later."""
    far, step = i, 1024
    while far < top:
        end = min(top, far + step)
        differ = np.flatnonzero(codes[far:end] != codes[far + gap : end + gap])
        if len(differ):
            far += int(differ[0])
            break
        far, step = end, step * 2
    near, step = i, 1024
    while near > bottom:
        begin = max(bottom, near - step)
        differ = np.flatnonzero(codes[begin:near] != codes[begin + gap : near + gap])
        if len(differ):
            near = begin + int(differ[-1]) + 1
            break
        near, step = begin, step * 2
    return near, far


def _grid(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, period, place) of every pair that must be looked at, in portions.

    The words of a run of period q equal those q later at max(6, 4q) - q places
    in a row or more, so one of them is a multiple of that number.
    """
    n = np.diff(bounds)
    longest = np.where(n >= LEAST_WORDS, n // LEAST_TIMES, 0)
    rows = np.flatnonzero(longest)
    if not len(rows):
        return
    cum = np.concatenate([[0], np.cumsum(longest[rows])])
    for a in range(0, int(cum[-1]), PAIRS):
        # numbers of (row, period), then of the places of each of them
        k = np.arange(a, min(a + PAIRS, int(cum[-1])))
        of = np.searchsorted(cum, k, side="right") - 1
        period = k - cum[of] + 1
        row = rows[of]
        step = np.maximum(LEAST_WORDS, LEAST_TIMES * period) - period
        places = -(-(n[row] - period) // step)
        ends = np.cumsum(places)
        for b in range(0, int(ends[-1]), PAIRS):
            at = np.arange(b, min(b + PAIRS, int(ends[-1])))
            j = np.searchsorted(ends, at, side="right")
            yield row[j], period[j], bounds[row[j]] + (at - (ends[j] - places[j])) * step[j]


def find_in_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(row, start, end, period) of every run, by row, start and period; ``bounds`` are the rows' offsets into ``codes``.

    Places are counted over all rows. Cost grows with n log n of a row's words.
    """
    with np.errstate(over="ignore"):
        powers = np.full(len(codes) + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers[:-1], out=sums[1:])
    found = [np.zeros((0, 4), np.int64)]
    # a run that holds a word, its end and its period: pairs inside it whose period is a multiple would find it again
    inside, until = np.ones(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for row, period, place in _grid(bounds):
        hit = (codes[place] == codes[place + period]) & ((place + period >= until[place]) | (period % inside[place] != 0))
        row, period, place = row[hit], period[hit], place[hit]
        top, bottom = bounds[row + 1] - period, bounds[row]
        far = place + _equal_length(sums, powers, place, period, top - place, False)
        near = place - _equal_length(sums, powers, place, period, place - bottom, True)
        long = far - near + period >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        one = np.unique(np.stack([row[long], period[long], near[long], far[long], place[long]], axis=1), axis=0)
        fresh = np.ones(len(one), bool)
        fresh[1:] = (one[1:, :4] != one[:-1, :4]).any(axis=1)
        first = np.flatnonzero(fresh)
        for i, end in zip(first.tolist(), [*first[1:].tolist(), len(one)]):
            r, q, a, b, at = one[i].tolist()
            if until[at] == b + q and q % inside[at] == 0:
                continue
            stretches = [(a, b)]
            # the words decide: where hashes were equal by chance, each place is extended word by word
            if not np.array_equal(codes[a:b], codes[a + q : b + q]):
                stretches = sorted({_exact(codes, at, q, int(bounds[r + 1]) - q, int(bounds[r])) for at in one[i:end, 4].tolist()})
            for a, b in stretches:
                if b - a + q >= max(LEAST_WORDS, LEAST_TIMES * q):
                    found.append(np.array([[r, a, b + q, q]], np.int64))
                    inside[a : b + q], until[a : b + q] = q, b + q
    # the same stretch is found again with multiples of its smallest period
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.concatenate([[True], (runs[1:, :3] != runs[:-1, :3]).any(axis=1)])] if len(runs) else runs


def _collapsed(codes: np.ndarray, letters: np.ndarray, ends: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each row's words but those in a run after its first period, joined by one space."""
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, runs[:, 1] + runs[:, 3], 1)
    np.add.at(gone, runs[:, 2], -1)
    keep = np.cumsum(gone[:-1]) == 0
    size = np.diff(np.concatenate([[0], ends]))
    kept = np.flatnonzero(keep)
    row_start = np.searchsorted(kept, bounds)
    # every kept word and a space after it, but for the last of its row
    width = size[kept] + 1
    last = row_start[1:][row_start[1:] > row_start[:-1]] - 1
    width[last] -= 1
    out = np.full(int(width.sum()), 32, np.uint8)
    to = np.concatenate([[0], np.cumsum(width)])
    mask = np.ones(len(out), bool)
    spaces = np.ones(len(kept), bool)
    spaces[last] = False
    mask[to[1:][spaces] - 1] = False
    out[mask] = letters[np.repeat(keep, size)]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(to[row_start].astype(np.int64)), pa.py_buffer(out))


def _of_block(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words, runs, collapsed text) of each row."""
    codes, letters, ends = word_codes(raw, off)
    ends, bounds = ends[: len(codes)], ends[len(codes) :]
    runs = find_in_words(codes, bounds)
    offsets = np.searchsorted(runs[:, 0], np.arange(len(off)))
    parts = [pa.array(runs[:, 1] - bounds[runs[:, 0]]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])]
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, [f.name for f in RUN.fields]))
    return np.diff(bounds), listed, _collapsed(codes, letters, ends, bounds, runs).cast(pa.string())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "body"):
        n, runs, text = _of_block(*utf8(block.column("body")))
        yield pa.RecordBatch.from_arrays([block.column("own"), pa.array(n), runs, text], ["own", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every run of words that repeats with a period, and the text without the repeats.

    Result: the caller's columns but ``text``, then n_words, ``runs``
    (array of (start, length, period), by start and period; start is a word's
    number from 0) and ``collapsed``: the words that are in no run or among the
    first ``period`` words of each run that holds them, joined by one space.
    Columns of these names give way to the results.

    Words stand between ASCII white space and are compared by their bytes. A run
    is a longest stretch of at least max(6, 4 * period) words, words ``period``
    apart being equal, of the smallest such period. Null and empty texts have no
    words, no runs and the empty string. Repeated rows are answered each; an
    empty table gives an empty result. A text is one task's work, at n log n of
    its words; pairs of period and place are looked at in portions, so beside the
    text and its words (40 bytes a word) memory does not grow.
    """
    rows, kept = packed(docs, [text, "n_words", "runs", "collapsed"], body=F.col(f"`{text}`").cast("string"))
    schema = T.StructType([rows.schema["own"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return unpacked(rows.mapInArrow(_find, schema), kept, "n_words", "runs", "collapsed")
