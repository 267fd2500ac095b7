"""Importance resampling towards a target corpus: postings of hashed word n-grams, dealt by bucket, weighed where they lie."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import running_counts
from .text_arrays import LOWER, blocks, utf8

BUCKETS = 10_000
#: Words of a document that may be drawn, and the share of such documents that is drawn.
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
#: Ranges of buckets; a range's postings are dealt to many tasks by their block of documents.
RANGES = 32
#: Rows a block holds at most, so that a row's number in it fits 16 bits; words whose features are hashed together.
BLOCK_ROWS, CHUNK = 1 << 14, 1 << 16
#: Longer words are hashed one by one.
LONG_WORD = 48
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

POSTINGS = "corpus boolean, part int, block long, bucket array<short>, row array<short>, n array<int>, doc_id array<long>, words array<long>"


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _crc_on(state: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 states carried on over the bytes from start to end: one step for all texts that have a byte at that place."""
    table, out, size = _crc_table(), state.copy(), end - start
    long = np.flatnonzero(size > LONG_WORD)
    order = np.argsort(-size, kind="stable")
    order = order[len(long) :]
    size = size[order]
    for k in range(int(size[0]) if len(size) else 0):
        on = order[: int(np.searchsorted(-size, -k, side="left"))]
        out[on] = table[(out[on] ^ low[start[on] + k]) & np.uint32(255)] ^ (out[on] >> np.uint32(8))
    for i in long.tolist():
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(~out[i])) ^ 0xFFFFFFFF
    return out


def word_places(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every run of digits, ASCII letters and bytes beyond ASCII."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's end is a word's end
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    edge = np.unique(edge)
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(off, start, side="right") - 1, start, end


def feature_counts(raw: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, count) of the words and pairs of neighbouring words of each row, by bucket and row, and each row's words."""
    row, start, end = word_places(raw, off)
    low, rows, table = LOWER[raw], len(off) - 1, _crc_table()
    space = lambda c: table[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(row), CHUNK):
        b = min(a + CHUNK, len(row))
        one = _crc_on(np.full(b - a, 0xFFFFFFFF, np.uint32), low, start[a:b], end[a:b])
        c = min(b + 1, len(row))
        pair = np.flatnonzero(row[a : c - 1] == row[a + 1 : c])
        two = _crc_on(space(one[pair]), low, start[a + 1 : c][pair], end[a + 1 : c][pair])
        of = np.concatenate([row[a:b], row[a:b][pair]])
        key, n = np.unique((~np.concatenate([one, two])).astype(np.int64) % buckets * rows + of, return_counts=True)
        keys.append(key)
        counts.append(n)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
    return key // max(1, rows), key % max(1, rows), n, np.bincount(row, minlength=rows)


def _post(batches: Iterator[pa.RecordBatch], corpus: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each block of texts a row for each range of buckets with its postings, and for the corpus one (part -1) of its documents."""
    block, width = TaskContext.get().partitionId() << 32, -(-buckets // RANGES)
    kinds = pa.list_(pa.int16()), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())
    for whole in blocks(batches, "text"):
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            part = whole.slice(at, BLOCK_ROWS)
            bucket, row, n, words = feature_counts(*utf8(part.column("text")), buckets)
            ends = np.searchsorted(bucket, np.arange(RANGES + 1) * width)
            out = [[corpus, p, block, (bucket[a:b] - p * width).astype(np.int16), row[a:b].astype(np.int16) if corpus else None, n[a:b].astype(np.int32), None, None] for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            if corpus:
                out.append([True, -1, block, None, None, None, part.column("doc_id").to_pylist(), words])
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), *[pa.array(c, k) for c, k in zip(columns[3:], kinds)]], ["corpus", "part", "block", "bucket", "row", "n", "doc_id", "words"])
            block += 1


def _totals(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's counts of each bucket it holds: at most two rows a range."""
    sums: dict[tuple[bool, int], np.ndarray] = {}
    for batch in batches:
        for corpus, part, bucket, n in zip(batch.column("corpus").to_pylist(), batch.column("part").to_pylist(), batch.column("bucket"), batch.column("n")):
            if part >= 0:
                sums.setdefault((corpus, part), np.zeros(width, np.int64))[:] += np.bincount(bucket.values.to_numpy(), n.values.to_numpy(), width).astype(np.int64)
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.list_(pa.int64()))], ["corpus", "part", "sums"])


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of postings of the corpus: the sum of gains of each of its documents. Rows of documents pass."""
    for batch in batches:
        out = []
        for corpus, part, block, bucket, row, n, doc_id, words, gains in zip(*[batch.column(c) for c in ("corpus", "part", "block", "bucket", "row", "n", "doc_id", "words", "gains")]):
            if not corpus.as_py():
                continue
            if part.as_py() < 0:
                out.append((block.as_py(), None, None, doc_id.values, words.values))
                continue
            gain = gains.values.to_numpy()[bucket.values.to_numpy()] * n.values.to_numpy()
            rows = row.values.to_numpy()
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
            out.append((block.as_py(), rows[order][first], np.add.reduceat(gain[order], first), None, None))
        columns = list(zip(*out)) or [()] * 5
        kinds = pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "row", "gain", "doc_id", "words"])


def _reduce(table: pa.Table) -> pa.Table:
    """The documents of a block with the sums of their gains."""
    own = np.flatnonzero(table.column("doc_id").is_valid().to_numpy())[0]
    doc_id, words = table.column("doc_id")[own].values, table.column("words")[own].values.to_numpy()
    gain = np.zeros(len(words), np.int64)
    for row, g in zip(table.column("row"), table.column("gain")):
        if row.is_valid:
            gain[row.values.to_numpy()] += g.values.to_numpy()
    return pa.table({"doc_id": doc_id.cast(pa.int64()), "n_words": pa.array(words), "gain": pa.array(gain)})


def gains_of(totals: DataFrame, buckets: int) -> DataFrame:
    """(part, gains) of (corpus, part, sums): a bucket's gain where its counts of both corpora meet. As many values as buckets in all."""
    each = totals.select("corpus", "part", F.posexplode("sums").alias("at", "n")).groupBy("part", "at").agg(*[F.sum(F.when(F.col("corpus") == own, F.col("n")).otherwise(0)).alias(name) for own, name in ((True, "s"), (False, "t"))])
    # the sums of the corpora: one row of as many values as buckets, dealt out again by range
    one = each.agg(F.collect_list(F.struct("part", "at", "s", "t")).alias("all"), F.sum("s").alias("big_s"), F.sum("t").alias("big_t"))
    back = one.select(F.explode("all").alias("b"), "big_s", "big_t").select("b.*", "big_s", "big_t")
    ratio = ((F.col("t") + 1) * (F.col("big_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("big_t") + buckets)).cast("double")
    gain = F.floor(1000 * F.log(ratio)).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("at", gain.alias("gain"))))
    return back.groupBy("part").agg(F.transform(ordered, lambda x: x["gain"]).alias("gains"))


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): how much likelier a document's words and pairs of words are in the target.

    Each document's features are counted by bucket where it is read; postings
    (bucket, document, count) are dealt by range of buckets and block of
    documents, so a bucket of a frequent word spreads over many tasks; the counts
    of each range of both corpora give its gains, which meet the range's postings
    and leave sums by document, and these are summed by block. A block is 1 MB of
    texts or one longer text. Blocks are numbered by partition, so ``docs`` must
    come in the same order when it is read again, as a scan does. Gains are as many
    values as buckets, whatever the input, and so are broadcast.
    """
    read = lambda df, i, t: df.select((F.col(f"`{i}`").cast("long") if i else F.lit(None).cast("long")).alias("doc_id"), F.col(f"`{t}`").cast("string").alias("text"))
    posted = [read(df, i, t).mapInArrow(partial(_post, corpus=corpus, buckets=buckets), POSTINGS) for df, i, t, corpus in ((docs, doc_id, text, True), (target, None, target_text, False))]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(16, 16 * tasks // RANGES)
    width = -(-buckets // RANGES)
    # the same shuffle serves the totals and the contributions
    dealt = posted[0].union(posted[1]).repartition(tasks, "part", F.pmod(F.xxhash64("block"), F.lit(salts)))
    gains = gains_of(dealt.mapInArrow(partial(_totals, width=width), "corpus boolean, part int, sums array<long>"), buckets)
    # no filter and no projection here: Spark would push them below the shuffle, which then could not serve both
    weighed = dealt.join(F.broadcast(gains), "part", "left")
    sums = weighed.mapInArrow(_contribute, "block long, row array<short>, gain array<long>, doc_id array<long>, words array<long>")
    out = sums.groupBy("block").applyInArrow(_reduce, "doc_id long, n_words long, gain long")
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long")
    rows = out.select("doc_id", "n_words", n.alias("n_features"), "gain")
    return rows.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")).drop("gain")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A thousandth of whole steps of Gumbel noise, drawn from the seed and the id; null ids draw that of the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` words or more, without putting back, by weights towards the target.

    Result, one row for each row: (doc_id, n_words, n_features, weight, score,
    rank). ``weight`` is the floored mean of the gains of the features, ``score``
    that plus noise of the seed and the id, and ``rank`` (1, 2, ..) the place among
    the drawn, by score and then id; null for those not drawn.

    Null and empty texts have no features and weight 0, and can not be drawn
    unless ``least_words`` is 0. Rows of one id have one noise and stay rows of
    their own; null ids rank behind others of their score. Equal rows have places
    side by side. Other columns are not looked at. An empty target weighs as one
    without any counts; an empty table gives an empty result. Ranks are put
    together from ranges of rows, so no task sorts them all.
    """
    rows = weigh(docs, target, buckets, doc_id, text, target_text).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    able = (F.col("n_words") >= least_words).cast("long")
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_words"), F.col("weight"), F.monotonically_increasing_id()]
    ranked = running_counts(rows.withColumn("able", able), ["able"], order, {"place": F.lit(1)})
    drawn = (F.col("able") == 1) & (F.col("place") <= F.expr(f"{percent} * total_place div 100"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place")).cast("long").alias("rank"))
