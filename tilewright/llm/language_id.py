"""Language by cross-parsing: the language whose suffix automaton parses a text into fewest phrases."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrays import blocks, packed, unpacked, utf8

SAMPLE_BYTES = 16_000
SAMPLE_ROWS = 80
#: Bytes that are parsed as one lane of many that run side by side.
LANE = 512
#: Times that lanes run side by side before what is left is done in order.
ROUNDS = 4
#: Languages whose tables fit the indices; more labels than this are refused, as labels are no free text.
MOST_LANGUAGES = 200


def _fold() -> np.ndarray:
    """Byte classes: A-Z as a-z, one class each for digits, white space and other ASCII; other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    for c in range(128):
        table[c] = ord("0") if 48 <= c < 58 else ord(" ") if c <= 32 else c | 32 if 65 <= c < 91 or 97 <= c < 123 else ord(".")
    return table


FOLD = _fold()


def learn_samples(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> tuple[tuple[str, bytes], ...]:
    """A bounded sample of labelled text for each language, on the driver.

    About ``SAMPLE_ROWS`` rows of a language are drawn by a hash of their id, and
    from each a passage at a drawn place; ``sample_bytes`` bytes a language are
    kept. Rows without text or label, or outside ``learn``, are not used.
    """
    rows = docs.where(learn).where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return ()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels in {lang}")
    key = F.xxhash64(F.col(doc_id), F.lit("language sample"))
    chance = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_ROWS / n))])[F.col(lang)]
    width = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-sample_bytes // min(n, SAMPLE_ROWS // 2)))])[F.col(lang)]
    start = F.pmod(F.xxhash64(F.col(doc_id), F.lit("place")), F.greatest(F.length(text) - width, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.where(key / F.lit(float(1 << 64)) + 0.5 < chance).select(F.col(lang).alias("lang"), key.alias("k"), F.substring(F.col(text), start, width).alias("t"))
    kept: dict[str, bytes] = {}
    for r in drawn.orderBy("lang", "k", "t").collect():
        kept[r["lang"]] = (kept.get(r["lang"], b"") + b"\n" + r["t"].encode())[:sample_bytes]
    return tuple(sorted(kept.items()))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of ``data`` from state 0."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@lru_cache(maxsize=2)
def _tables(samples: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All automata as one table: (byte classes, root index by language, next index * 2 + 1 where a phrase begins)."""
    texts = [FOLD[np.frombuffer(t, np.uint8)].tobytes() for _, t in samples]
    seen = sorted(set(b"".join(texts)))
    classes = np.full(256, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    wide, roots, parts, base = len(seen) + 1, [], [], 0
    for text in texts:
        step = suffix_automaton(text)
        roots.append(base)
        first = np.full(wide, base, np.int64)
        for c, to in step[0].items():
            first[classes[c]] = base + to * wide
        table = np.tile(first * 2 + 1, (len(step), 1))
        for s, out in enumerate(step[1:], 1):
            for c, to in out.items():
                table[s, classes[c]] = (base + to * wide) * 2
        parts.append(table.astype(np.int32 if base + table.size < 1 << 30 else np.int64).ravel())
        base += table.size
    return classes[FOLD], np.array(roots, np.int64), np.concatenate(parts)


def _in_order(first: np.ndarray, owner: np.ndarray, raw: np.ndarray, start: np.ndarray, width: np.ndarray, classes: np.ndarray, table: np.ndarray, entry: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> None:
    """Go through the lanes of each row from its first unsettled one on, in order; lanes of equal letters are run once for each way in."""
    runs: dict[tuple[bytes, int], tuple[int, int]] = {}
    value_of = table.item
    for lane in first[np.unique(owner[first], return_index=True)[1]].tolist():
        last = int(np.searchsorted(owner, owner[lane], side="right"))
        for j in range(lane, last):
            letters = None
            for k in range(len(entry)):
                at = int(ends[k, j - 1])
                if entry[k, j] == at:
                    continue
                if letters is None:
                    own = classes[raw[start[j] : start[j] + width[j]]].astype(np.uint16)
                    letters = own.tobytes()
                if (letters, at) not in runs:
                    to, phrases = at, 0
                    for c in own.tolist():
                        value = value_of(to + c)
                        phrases += value & 1
                        to = value >> 1
                    runs[letters, at] = to, phrases
                entry[k, j] = at
                ends[k, j], begun[k, j] = runs[letters, at]


def phrase_counts(raw: np.ndarray, off: np.ndarray, samples: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Phrases of each row's greedy parse by each language: array (languages, rows).

    A phrase begins with the text, and where the automaton has no transition; a
    byte that the sample lacks is a phrase. Texts are cut into lanes of ``LANE``
    bytes that run side by side, a byte at a time for all languages. Lanes first
    run from the root; each whose predecessor ends elsewhere runs again from
    there, until no end changes, so the counts are those of the parse of the
    whole text. Where phrases and lanes do not fall into step, as in a long run
    of one letter, lanes are set right one after the other after ``ROUNDS`` times.
    """
    classes, roots, table = _tables(samples)
    size = np.diff(off)
    lanes = -(-size // LANE)
    owner = np.repeat(np.arange(len(size)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = off[owner] + nth * LANE
    width = np.minimum(off[owner + 1] - start, LANE)
    out = np.zeros((len(roots), len(size)), np.int64)
    entry = np.repeat(roots[:, None], len(owner), axis=1)
    ends, begun = np.full(entry.shape, -1, np.int64), np.zeros(entry.shape, np.int32)
    todo, rounds = np.arange(len(owner)), 0
    while len(todo):
        todo = todo[np.argsort(-width[todo], kind="stable")]
        live = np.searchsorted(-width[todo], -np.arange(1, LANE + 1), side="right")
        at, phrases, place = entry[:, todo], np.zeros((len(roots), len(todo)), np.int32), start[todo]
        for t in range(int(width[todo[0]])):
            n = live[t]
            value = table.take(at[:, :n] + classes[raw[place[:n] + t]], mode="clip")
            phrases[:, :n] += value & 1
            at[:, :n] = value >> 1
        ends[:, todo], begun[:, todo] = at, phrases
        # lanes that follow one of these lanes in its text and began elsewhere
        after = todo[todo + 1 < len(owner)] + 1
        after = after[nth[after] > 0]
        after = after[(ends[:, after - 1] != entry[:, after]).any(axis=0)]
        rounds += 1
        if rounds == ROUNDS:
            _in_order(after, owner, raw, start, width, classes, table, entry, ends, begun)
            break
        entry[:, after] = ends[:, after - 1]
        todo = after
    for k in range(len(roots)):
        out[k] = np.bincount(owner, weights=begun[k], minlength=len(size)).astype(np.int64)
    return out


def predict(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``; columns of these names are replaced.

    A language's cost is its phrases times the logarithm of its sample's length,
    divided by the text's length; the least cost wins, ties by name. ``score`` is
    one less the ratio of the least cost to the next (1 with a single language).
    Null texts, texts without a letter, and any text when nothing was learned are
    ``und`` with score 0. Repeated rows are judged alike, an empty table gives an
    empty result, and no name of another column clashes. Whole texts are read, in
    blocks of about 1 MB or one longer text.
    """
    names = [name for name, _ in samples]
    bits = np.log2(np.array([max(2, len(t)) for _, t in samples]))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows, kept = packed(docs, ["lang_pred", "score"], text=F.col(text).cast("string"), letter=lettered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            letter = block.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            raw, off = utf8(block.column("text"))
            pred, score = np.full(block.num_rows, "und", object), np.zeros(block.num_rows)
            if names:
                cost = phrase_counts(raw, off, samples) * bits[:, None] / np.maximum(np.diff(off), 1)
                best = cost.argmin(axis=0)
                two = np.sort(cost, axis=0)
                pred[letter] = np.array(names, object)[best][letter]
                score[letter] = (1 - two[0] / np.maximum(two[1], 1e-12) if len(names) > 1 else np.ones(len(best)))[letter]
            yield pa.RecordBatch.from_arrays([block.column("own"), pa.array(pred, pa.string()), pa.array(score)], names=["own", "lang_pred", "score"])

    schema = rows.select("own").schema.add("lang_pred", "string").add("score", "double")
    return unpacked(rows.mapInArrow(run, schema), kept, "lang_pred", "score")
