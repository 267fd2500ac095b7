"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .text_arrays import BLOCK_BYTES, LOWER, SPACE, blocks, packed, pieces, unpacked, utf8

Q = 8
#: Edits allowed for each byte of a passage, rounded down.
EDIT_RATE = 0.06
#: Passages whose bound on shared q-grams would fall below this are matched with fewer edits.
LEAST_SHARED = 4
#: Benchmark bytes whose index each task holds; q-grams of a larger benchmark are joined by a shuffle.
INDEX_BYTES = 4 << 20
_FILTER_BITS = 22
#: Bits of the filter of a larger benchmark's q-grams: 8 MB at every size.
LARGE_BITS = 26
#: Different passages of under ``Q`` bytes in a large benchmark.
TINY = 10_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FIELDS = ("item_id", "start", "end", "edits")
FOUND = pa.list_(pa.struct([(c, pa.int64()) for c in FIELDS]))


def edit_budget(length: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed in a passage: ``rate`` of its length, less if the lemma's bound would be too weak."""
    return max(0, min(int(length * rate), (length + 1 - q - LEAST_SHARED) // q))


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters a-z lower-cased and runs of ASCII white space made one space: (bytes, offsets)."""
    made, at, spaced = [], np.zeros(len(off), np.int64), False
    total = 0
    for a, b in pieces(len(raw)):
        space = SPACE[raw[a:b]]
        inside = off[(off >= a) & (off < b)] - a
        again = space & np.concatenate([[spaced], space[:-1]])
        again[inside] = False
        keep = ~again
        ends = np.cumsum(keep)
        here = (off >= a) & (off < b)
        at[here] = total + (ends - keep)[off[here] - a]
        out = LOWER[raw[a:b]]
        out[space] = 32
        made.append(out[keep])
        total, spaced = total + int(ends[-1]), bool(space[-1])
    at[off >= len(raw)] = total
    return np.concatenate([*made, np.zeros(0, np.uint8)]), at


def _grams(data: np.ndarray) -> np.ndarray:
    """The ``Q`` = 8 bytes from each place, as one integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


class Index:
    """The q-grams of a batch of passages: sorted grams with (passage, place), and a bit filter in front."""

    def __init__(self, items: tuple[tuple[int, bytes], ...], rate: float) -> None:
        self.ids, texts = [], []
        for key, text in items:
            raw = np.frombuffer(text, np.uint8)
            data, _ = normalise(raw, np.array([0, len(raw)]))
            body = data.tobytes().strip(b" ")
            if body:
                self.ids.append(key)
                texts.append(body)
        self.texts = texts
        self.budget = np.array([edit_budget(len(t), rate) for t in texts], np.int64)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.need = np.maximum(self.length + 1 - Q - Q * self.budget, 1)
        grams = [_grams(np.frombuffer(t, np.uint8)) for t in texts]
        self.short = [k for k, g in enumerate(grams) if not len(g)]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.grams, self.owner, self.place = every[order], owner[order], place[order]
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.slot(self.grams)] = True
        whole = np.setdiff1d(np.arange(len(texts)), self.short)
        region = self.length + self.budget
        #: Bytes that a part of a text must share with the next, so that each band's window is whole in one of them.
        self.reach = int((self.length + 8 * (self.budget + 2)).max()) + Q if len(texts) else 0
        # windows of a few lengths, each with the least bound of the regions that fit in it and not in a shorter one
        step = np.ceil(np.log(np.maximum(region, 1)) / np.log(1.2)).astype(int)
        self.windows = [(int(region[k].max()), int(self.need[k].min())) for s in np.unique(step[whole]) for k in [whole[step[whole] == s]]]

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * _MULTIPLIER) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, bytes], ...], rate: float) -> Index:
    return Index(items, rate)


def align(pattern: bytes, text: bytes, diagonal: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """The best place of ``pattern`` in ``text`` on diagonals within ``width`` of ``diagonal``: (edits, start, end).

    Banded alignment, free at both ends of the text; None if it takes more than
    ``budget`` edits.
    """
    m, n, band = len(pattern), len(text), 2 * width + 1
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8)
    big = m + n + 1
    at = np.arange(band) + diagonal - width
    cost = np.where((at >= 0) & (at <= n), 0, big)
    start = at.copy()
    ramp = np.arange(band)
    for i in range(1, m + 1):
        at += 1
        inside = (at >= 1) & (at <= n)
        swap = cost + (t[np.clip(at - 1, 0, max(n - 1, 0))] != p[i - 1] if n else 1)
        swap[~inside] = big
        drop = np.append(cost[1:] + 1, big)
        drop[~((at >= 0) & (at <= n))] = big
        best = np.minimum(swap, drop)
        came = np.where(swap <= drop, start, np.append(start[1:], 0))
        # text bytes skipped inside the band: a running minimum of cost less place
        low = np.minimum.accumulate((best - ramp) * band - ramp)
        where = -low % band
        skip = low // band + (where > 0) + ramp
        better = (skip < best) & inside
        cost, start = np.where(better, skip, best), np.where(better, came[where], came)
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), int(at[k])) if cost[k] <= budget else None


def _dense(held: np.ndarray, windows: list[tuple[int, int]]) -> np.ndarray:
    """Places whose gram may be some passage's, in a window dense enough for the bound of a passage."""
    total = np.zeros(len(held) + 1, np.int32)
    np.cumsum(held, out=total[1:])
    starts = np.flatnonzero(held)
    near = np.zeros(len(held) + 1, np.int32)
    for width, least in windows:
        dense = starts[total[np.minimum(starts + width, len(held))] - total[starts] >= least]
        near += np.bincount(dense, minlength=len(near)).astype(np.int32)
        near -= np.bincount(np.minimum(dense + width, len(held)), minlength=len(near)).astype(np.int32)
    return starts[np.cumsum(near)[starts] > 0]


def _search(data: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, passage, start, end, edits) of the best place of each passage in each row.

    A row longer than a piece is searched in parts that share ``index.reach``
    bytes; a band counts in a part that holds its whole window.
    """
    step = BLOCK_BYTES + index.reach
    if len(off) > 2 or len(data) <= step + index.reach:
        return [(r, i, s, e, n) for (r, i), (n, s, e) in _search_part(data, off, index, 0, True).items()]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for at in range(0, len(data) - index.reach, step - index.reach):
        part = data[at : at + step]
        for key, best in _search_part(part, np.array([0, len(part)]), index, at, at + step >= len(data)).items():
            found[key] = min(found.get(key, best), best)
    return [(r, i, s, e, n) for (r, i), (n, s, e) in found.items()]


def _search_part(data: np.ndarray, off: np.ndarray, index: Index, base: int, last_part: bool) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, passage) to (edits, start, end); places are those of the whole row, of which this part begins at ``base``."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in index.short:
        body, whole, at = index.texts[k], data.tobytes(), 0
        while (at := whole.find(body, at)) >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            if at + len(body) <= off[row + 1]:
                found.setdefault((row, k), (0, int(base + at - off[row]), int(base + at - off[row] + len(body))))
            at += 1
    grams = _grams(data)
    hit = _dense(index.bits[Index.slot(grams)], index.windows) if len(index.grams) and len(grams) else np.zeros(0, np.int64)
    if len(hit):
        first = np.searchsorted(index.grams, grams[hit], side="left")
        hit = hit[index.grams[np.minimum(first, len(index.grams) - 1)] == grams[hit]]
        row = np.searchsorted(off, hit, side="right") - 1
        inside = hit + Q <= off[row + 1]
        hit, row = hit[inside], row[inside]
    if len(hit):
        lo = np.searchsorted(index.grams, grams[hit], side="left")
        many = np.searchsorted(index.grams, grams[hit], side="right") - lo
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(lo, many) + nth
        owner = index.owner[entry]
        diagonal = base + np.repeat(hit - off[row], many) - index.place[entry]
        rows = np.repeat(row, many)
        # bands of twice the budget plus one diagonals, each overlapping the next by half
        wide = index.budget[owner] + 1
        band = np.floor_divide(diagonal, wide)
        lead = int(band.min()) - 1
        span = int(band.max()) - lead + 2
        key = (rows * len(index.texts) + owner) * span + band - lead
        both = np.concatenate([key, key - 1])
        keys, shared = np.unique(both, return_counts=True)
        item = keys // span % len(index.texts)
        good = shared >= index.need[item]
        for k, i, r in zip((keys[good] % span + lead).tolist(), item[good].tolist(), (keys[good] // span // len(index.texts)).tolist()):
            body, budget = index.texts[i], int(index.budget[i])
            # the band's diagonals and, on each side, those that the budget can reach; they may begin before the text
            first, last = k * (budget + 1) - budget, (k + 2) * (budget + 1) + budget
            low, high = max(0, first), last + len(body)
            if (low < base) or (high > base + off[r + 1] - off[r] and not last_part):
                continue
            window = data[off[r] + low - base : max(off[r] + low - base, min(off[r + 1], off[r] + high - base))].tobytes()
            exact = window.find(body)
            at = (0, exact, exact + len(body)) if exact >= 0 else align(body, window, (first + last) // 2 - low, (last - first) // 2 + 1, budget)
            if at is not None:
                best = (at[0], low + at[1], low + at[2])
                found[r, i] = min(found.get((r, i), best), best)
    return found


def _passages(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[tuple[int, bytes]] | None]:
    """The distinct passages (item, passage), written, and their values if they are few enough to be held."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(item_id).isNotNull())
    rows = materialize(rows.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("passage")).distinct(), "passages")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("passage") + 32), F.lit(0))).first()[0]
    held = [(r["item"], r["passage"].encode()) for r in rows.orderBy("item", "passage").collect()] if size <= INDEX_BYTES else None
    return rows, held


def _searched(rows: DataFrame, items: list[tuple[int, bytes]], rate: float) -> DataFrame:
    """``rows`` without ``text``, and ``found``: array of (item_id, start, end, edits), from an index that each task holds."""
    kept = [c for c in rows.columns if c != "text"]
    index_of = rows.sparkSession.sparkContext.broadcast((tuple(items), rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*index_of.value)
        for block in blocks(batches):
            data, off = normalise(*utf8(block.column("text")))
            found: list[list] = [[] for _ in range(block.num_rows)]
            for r, i, s, e, n in sorted(_search(data, off, index)):
                found[r].append({"item_id": index.ids[i], "start": s, "end": e, "edits": n})
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in kept], pa.array(found, FOUND)], names=[*kept, "found"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("found", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in FIELDS]))))


def _gram_rows(rows: DataFrame, name: str, key: str, kept) -> DataFrame:
    """(key, gram, place) of the q-grams of each ``text`` that ``kept`` (grams -> places) keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keys = block.column(name)
            data, off = normalise(*utf8(block.column("text")))
            for r in range(block.num_rows):
                # parts share enough bytes that what is dense in the whole is dense in one of them
                for at in range(0, max(1, int(off[r + 1] - off[r])), BLOCK_BYTES):
                    grams = _grams(data[off[r] + at : min(off[r + 1], off[r] + at + 2 * BLOCK_BYTES)])
                    places = kept(grams)
                    if len(places):
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.int64(keys[r].as_py()), len(places))), pa.array(grams[places].view(np.int64)), pa.array(places + at)], names=[name, "gram", "place"])

    return rows.select(name, "text").mapInArrow(run, f"{name} {key}, gram long, place long").distinct()


def _large_slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * _MULTIPLIER) >> np.uint64(64 - bits)


def _by_shuffle(rows: DataFrame, passages: DataFrame, rate: float) -> DataFrame:
    """(hash, item_id, start, end, edits): the passages of each different text of ``rows`` (hash, text), the benchmark being large.

    One pass over the texts keeps the q-grams that a filter of fixed size and
    the density of the lemma's bound leave. They meet the benchmark's q-grams by
    a shuffle join, are counted by band, and pairs of text and passage that
    reach the bound in some band are joined with both texts and searched.
    """
    width = LARGE_BITS

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, off = normalise(*utf8(block.column("text")))
            bodies = [data[a:b].tobytes().strip(b" ") for a, b in zip(off[:-1], off[1:])]
            budget = [edit_budget(len(b), rate) for b in bodies]
            need = [max(len(b) + 1 - Q - Q * e, 1) for b, e in zip(bodies, budget)]
            yield pa.RecordBatch.from_arrays([block.column("item"), pa.array([b.decode("utf-8", "replace") for b in bodies]), *[pa.array(x, pa.int64()) for x in (map(len, bodies), budget, need)]], names=["item", "text", "length", "budget", "need"])

    known = materialize(passages.select("item", F.col("passage").alias("text")).mapInArrow(measured, "item long, text string, length long, budget long, need long").where("length > 0").withColumn("id", F.xxhash64("item", "text")), "measured")
    grams = materialize(_gram_rows(known, "id", "long", lambda g: np.arange(len(g))), "grams")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _large_slot(batch.column("gram").to_numpy().view(np.uint64), width)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], names=["w", "b"])

    words = grams.select("gram").mapInArrow(filtered, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (width - 6), np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    step = F.ceil(F.log(1.2, F.greatest(F.col("length") + F.col("budget"), F.lit(1))))
    windows = [tuple(r) for r in known.where(F.col("length") >= Q).groupBy(step.alias("s")).agg(F.max(F.col("length") + F.col("budget")).alias("w"), F.min("need").alias("n")).select("w", "n").collect()]
    shared = rows.sparkSession.sparkContext.broadcast((bits, windows))

    def held(grams: np.ndarray) -> np.ndarray:
        bits, windows = shared.value
        slots = _large_slot(grams, width)
        return _dense((bits[(slots >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slots & np.uint64(63))) & np.uint64(1) > 0, windows)

    hits = _gram_rows(rows, "hash", "long", held)
    met = hits.join(grams.select("gram", "id", F.col("place").alias("of")), "gram").join(known.select("id", "budget", "need"), "id")
    band = F.floor((F.col("place") - F.col("of")) / (F.col("budget") + 1))
    counted = met.select("hash", "id", "need", F.explode(F.array(band, band - 1)).alias("band")).groupBy("hash", "id", "band").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    pairs = counted.select("hash", "id").distinct()
    tiny = known.where(F.col("length") < Q).select("id", F.col("text").alias("body"), "item")
    # passages shorter than a q-gram are few different ones at most by their length; each text looks for all of them
    few = [(r["item"], r["body"].encode()) for r in tiny.distinct().limit(TINY + 1).collect()]
    if len(few) > TINY:
        raise ValueError(f"more than {TINY} different passages of under {Q} bytes")
    texts = materialize(pairs.join(rows, "hash").join(known.select("id", "item", F.col("text").alias("body")), "id").select("hash", "item", "body", "text"), "matches")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            made = []
            for r, key in enumerate(block.column("hash").to_pylist()):
                item = (block.column("item")[r].as_py(), block.column("body")[r].as_py().encode())
                data, off = normalise(*utf8(block.column("text").slice(r, 1)))
                made += [(key, item[0], s, e, n) for _, _, s, e, n in _search(data, off, Index((item,), rate))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made) if made else [[]] * 5)], names=["hash", "item_id", "start", "end", "edits"])

    out = texts.mapInArrow(search, "hash long, item_id long, start long, end long, edits long")
    if few:
        out = out.union(_searched(rows, few, rate).select("hash", F.inline("found")))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "text") -> DataFrame:
    """Return (doc_id, item_id, start, end, edits) for each benchmark passage that a document holds.

    A match is a part of the document within ``edit_budget`` edits of the whole
    passage, over UTF-8 bytes after A-Z are lower-cased and white space is
    collapsed. By the q-gram lemma such a part shares length + 1 - q - q * edits
    q-grams with the passage on neighbouring diagonals: shared q-grams are
    counted in overlapping bands of diagonals, bands that reach the bound are
    aligned, and the best place is given in bytes of the normalised text.
    Passages shorter than a q-gram must occur exactly. Null and blank passages
    match nothing, as do null and empty texts; of several passages of one item,
    each is looked for. Rows of one id are searched on their own; empty tables
    give an empty result; other columns are ignored. Whole texts are read once: a
    benchmark of up to ``INDEX_BYTES`` is indexed in each task, and the q-grams of
    a larger one are joined by a shuffle.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    passages, held = _passages(benchmark, item_id, passage)
    if held is not None:
        return _searched(rows, held, rate).select("doc_id", F.inline("found"))
    rows = rows.withColumn("hash", F.xxhash64("text")).where("text is not null")
    found = _by_shuffle(rows.select("hash", "text").dropDuplicates(["hash"]), passages, rate)
    return rows.select("doc_id", "hash").join(found, "hash").drop("hash")


def mark_documents(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text: str = "text", item_id: str = "item_id", passage: str = "text") -> DataFrame:
    """Add ``passages`` (array<long>), the sorted benchmark items that each row holds; a column of that name is replaced.

    Matches are those of :func:`find_passages`; null and empty texts hold none,
    repeated rows are marked alike, an empty table gives an empty result, and no
    name of another column clashes. With a benchmark of up to ``INDEX_BYTES`` no
    row moves between tasks.
    """
    rows, kept = packed(docs, ["passages"], text=F.col(text).cast("string"))
    passages, held = _passages(benchmark, item_id, passage)
    items = lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda f: f["item_id"])))
    if held is not None:
        return unpacked(_searched(rows, held, rate).withColumn("passages", items("found")), kept, "passages")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    found = _by_shuffle(rows.select("hash", "text").where("text is not null").dropDuplicates(["hash"]), passages, rate)
    found = found.groupBy("hash").agg(F.array_sort(F.collect_set("item_id")).alias("passages"))
    return unpacked(rows.drop("text").join(found, "hash", "left").withColumn("passages", F.coalesce("passages", F.expr("cast(array() as array<bigint>)"))), kept, "passages")
