"""SentencePiece encoding by a max-plus parallel scan, and decoding.

A text's best segmentation maximises the sum of its pieces' scores. Giant
documents are cut into chunks. A chunk's transfer matrix holds, for every offset
at which a piece may end beyond its start and beyond its end, the best score
between the two; matrices combine associatively under (max, +). The scan of a
document's matrices, by a tree of products over tasks, gives the best scores at
every cut. From these each chunk tells at which offset a best path enters it for
every offset at which it may leave; these tables are composed by the same tree,
and each chunk is then backtraced on its own. Ties are broken as in a search of
the whole text, so chunks change no id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .text_arrays import blocks, packed, unpacked

UNIGRAM = 1
#: Scores are whole multiples of 1 / SCALE, so that sums are exact in any order.
SCALE = 1 << 16
NONE = -(1 << 60)
CHUNK = 1 << 15
CACHED_SPANS = 150_000
#: Chunks whose matrices one task multiplies; each level of the tree has so many times fewer.
FAN = 64
# Fixed penalty of SentencePiece for a character that no piece covers.
UNKNOWN_PENALTY = 10


@dataclass
class Pieces:
    """The usable pieces of a model: (id, score) by string, with a space for the model's space mark."""

    by_text: dict[str, tuple[int, int]]
    byte_ids: list[int]
    as_bytes: list[bytes]
    dummy_prefix: bool
    longest: int
    unknown: int
    span: re.Pattern
    #: Every prefix of a piece, with the piece's score where it is one itself, else None.
    prefixes: dict[str, int | None] = field(default_factory=dict)
    #: The same as a trie: character to [further characters, score]; a single character always has a score.
    trie: dict[str, list] = field(default_factory=dict)
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)
    older: dict[str, tuple[int, ...]] = field(default_factory=dict)


def _model(model: bytes):
    from sentencepiece import sentencepiece_model_pb2 as proto

    return proto.ModelProto.FromString(model), proto.ModelProto.SentencePiece


@lru_cache(maxsize=2)
def piece_bytes(model: bytes) -> tuple[list[bytes], bool]:
    """The bytes of every id, and whether texts begin with a space of the model's own: all that decoding needs."""
    m, kind = _model(model)
    usable, table = (kind.NORMAL, kind.USER_DEFINED), []
    for p in m.pieces:
        table.append(bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace("▁", " ").encode() if p.type in usable else b"")
    return table, m.normalizer_spec.add_dummy_prefix


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    """Read a model's bytes.

    Unigram models keep their scores. A model of another type has ranks, not
    log-probabilities, as scores; its pieces then get those of Zipf's law,
    minus the logarithm of their rank, as a unigram model would give them.
    """
    m, kind = _model(model)
    spec = m.normalizer_spec
    if spec.name not in ("identity", "") or spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback:
        raise ValueError("only models with the identity normaliser, kept white space and byte fallback are read")
    by_text, byte_ids, as_bytes, rank = {}, [0] * 256, [], 0
    for i, p in enumerate(m.pieces):
        text = p.piece.replace("▁", " ")
        if p.type == kind.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            as_bytes.append(bytes([int(p.piece[3:5], 16)]))
            continue
        usable = p.type in (kind.NORMAL, kind.USER_DEFINED)
        as_bytes.append(text.encode() if usable else b"")
        if usable:
            rank += 1
            value = p.score if m.trainer_spec.model_type == UNIGRAM else -math.log(rank + 1)
            by_text[text] = (i, min(-1, round(value * SCALE)))
    inner = any(" " in t.lstrip(" ") for t in by_text)
    lines = any("\n" in t for t in by_text)
    # between a character and a space, and around line ends, no piece crosses: spans are best on their own
    span = "(?s).+" if inner else r" *[^ ]+| +" if lines else r" *[^ \n]+| +|\n"
    worst = min(s for _, s in by_text.values())
    out = Pieces(by_text, byte_ids, as_bytes, spec.add_dummy_prefix, max(map(len, by_text)), worst - UNKNOWN_PENALTY * SCALE, re.compile(span))
    out.prefixes = {t[:k]: None for t in by_text for k in range(1, len(t) + 1)}
    out.prefixes |= {t: score for t, (_, score) in by_text.items()}
    for text, (_, score) in by_text.items():
        level = out.trie
        for k, c in enumerate(text):
            node = level.setdefault(c, [{}, out.unknown if k == 0 else None])
            level = node[0]
        node[1] = score
    return out


def arcs(text: str, at: int, pieces: Pieces) -> Iterator[tuple[int, int]]:
    """(end, score) of the pieces from ``at``; a character that no piece is has its bytes. Scores are below 0."""
    one = False
    for end in range(at + 1, min(len(text), at + pieces.longest) + 1):
        score = pieces.prefixes.get(text[at:end], 0)
        if score == 0:
            break
        if score is not None:
            one = one or end == at + 1
            yield end, score
    if not one:
        yield at + 1, pieces.unknown


def best_path(text: str, pieces: Pieces) -> tuple[int, tuple[int, ...]]:
    """The best score of ``text`` and its ids; of equal paths, the one with the longer piece at its end."""
    n, wide, trie, unknown = len(text), pieces.longest, pieces.trie, pieces.unknown
    score, back = [NONE] * (n + 1), [0] * (n + 1)
    score[0] = 0
    for i in range(n):
        base, end, level = score[i], i, trie
        for c in text[i : i + wide]:
            node = level.get(c)
            if node is None:
                break
            end += 1
            level, s = node
            if s is not None and base + s > score[end]:
                score[end], back[end] = base + s, i
        if end == i and base + unknown > score[i + 1]:
            score[i + 1], back[i + 1] = base + unknown, i
    out, j = [], n
    while j:
        i = back[j]
        piece = pieces.by_text.get(text[i:j])
        out.append((piece[0],) if piece else tuple(pieces.byte_ids[b] for b in text[i:j].encode("utf-8", "surrogatepass")))
        j = i
    return score[n], tuple(x for ids in reversed(out) for x in ids)


def encode_text(text: str, pieces: Pieces) -> list[int]:
    """Ids of a text without the dummy prefix, span by span.

    Spans met before are looked up in two generations of bounded caches, so
    frequent ones stay.
    """
    out: list[int] = []
    get, older = pieces.cache.get, pieces.older.get
    for span in pieces.span.findall(text):
        ids = get(span)
        if ids is None:
            ids = older(span) or best_path(span, pieces)[1]
            if len(span) <= 64:
                pieces.cache[span] = ids
        out += ids
    if len(pieces.cache) >= CACHED_SPANS:
        pieces.older, pieces.cache = pieces.cache, {}
    return out


def transfer_matrix(text: str, size: int, pieces: Pieces, last: bool = False) -> np.ndarray:
    """Best scores from each offset at the start of a chunk of ``size`` characters to each beyond its end.

    ``text`` is the chunk and what follows it, up to the longest piece. In the
    last chunk a path must end at the text's end.
    """
    wide = pieces.longest
    out = np.full((wide, wide), NONE, np.int64)
    score = np.full((size + wide + 1, wide), NONE, np.int64)
    for e in range(min(wide, size + 1)):
        score[e, e] = 0
    stop = size if last else size + wide
    for i in range(size):
        if (score[i] > NONE).any():
            for end, s in arcs(text, i, pieces):
                if end < size + wide and end <= stop:
                    live = score[i] > NONE
                    score[end, live] = np.maximum(score[end, live], score[i, live] + s)
    for x in range(1 if last else wide):
        out[:, x] = score[size + x]
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices, which is associative."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out < NONE // 2, NONE, out)


def chunk_matrix(text: str, size: int, pieces: Pieces, last: bool) -> np.ndarray:
    """The transfer matrix of a chunk; between its first and last sure bounds only one score is needed."""
    sure = [m.start() for m in pieces.span.finditer(text) if pieces.longest < m.start() < size - pieces.longest]
    if len(sure) < 2:
        return transfer_matrix(text, size, pieces, last)
    a, b = sure[0], sure[-1]
    middle = sum(best_path(s, pieces)[0] for s in pieces.span.findall(text[a:b]))
    head, tail = transfer_matrix(text[:a], a, pieces, True), transfer_matrix(text[b:], size - b, pieces, last)
    out = head[:, :1] + middle + tail[:1, :]
    return np.where(out < NONE // 2, NONE, out)


def enters(text: str, size: int, before: np.ndarray, pieces: Pieces, last: bool = False) -> np.ndarray:
    """The offset at which a best path enters a chunk, by the offset at which it leaves it; -1 where none does.

    ``before`` holds the best score at each offset beyond the chunk's start, by a
    piece from before it. Of equal paths, that with the longer last piece counts,
    as in :func:`best_path`: what comes from before the chunk is longest.
    """
    wide = pieces.longest
    sure = next((m.start() for m in pieces.span.finditer(text) if wide < m.start() < size - wide), None)
    if sure is not None:
        # every path passes here, wherever it leaves
        return np.full(wide, enters(text[:sure], sure, before, pieces, True)[0], np.int32)
    score, back = np.full(size + wide + 1, NONE, np.int64), np.full(size + wide + 1, -1, np.int64)
    score[: min(wide, size + 1)] = before[: min(wide, size + 1)]
    stop = size if last else size + wide
    for i in range(size):
        if score[i] > NONE:
            for end, s in arcs(text, i, pieces):
                if end < size + wide and end <= stop and score[i] + s > score[end]:
                    score[end], back[end] = score[i] + s, i
    out = np.full(wide, -1, np.int32)
    for x in range(1 if last else wide):
        at = size + x
        if score[at] > NONE:
            while back[at] >= 0:
                at = back[at]
            out[x] = at
    return out


def _matrix(value: bytes) -> np.ndarray:
    flat = np.frombuffer(value, np.int64)
    return flat.reshape(-1, math.isqrt(len(flat)))


def product(values: list[bytes]) -> bytes:
    """The (max, +) product of matrices in order."""
    out = _matrix(values[0])
    for v in values[1:]:
        out = combine(out, _matrix(v))
    return out.tobytes()


def scores_before(values: list[bytes], state: bytes) -> list[bytes]:
    """The best scores before each of some matrices in order, from those before the first."""
    out, ahead = [], np.frombuffer(state, np.int64)
    for v in values:
        out.append(ahead.tobytes())
        ahead = combine(ahead[None, :], _matrix(v))[0]
    return out


def _followed(table: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(by >= 0, table[np.maximum(by, 0)], -1).astype(np.int32)


def composed(values: list[bytes]) -> bytes:
    """The table from the offset at which the last chunk is left to that at which the first is entered."""
    out = np.frombuffer(values[-1], np.int32)
    for v in values[-2::-1]:
        out = _followed(np.frombuffer(v, np.int32), out)
    return out.tobytes()


def leaves_of(values: list[bytes], state: bytes) -> list[bytes]:
    """The offset at which each chunk is left, from that of the last."""
    out, leave = [], np.frombuffer(state, np.int32)
    for v in reversed(values):
        out.append(leave.tobytes())
        leave = _followed(np.frombuffer(v, np.int32), leave)
    return out[::-1]


def _sweep(values: DataFrame, most: int, merge, push, start: bytes, fan: int) -> DataFrame:
    """(key, part, state): an associative scan of (key, part, value) over tasks.

    ``merge`` joins ``fan`` values in order, level by level, until each key has
    one; states are then pushed down the same tree, from ``start`` at the top.
    """
    up = [values]
    while most > 1:
        most = -(-most // fan)
        merged = lambda key, rows: pd.DataFrame({"key": [key[0]], "part": [key[1]], "value": [merge(rows.sort_values("part")["value"].tolist())]})
        grouped = up[-1].groupBy("key", F.floor(F.col("part") / fan).cast("int").alias("above"))
        up.append(materialize(grouped.applyInPandas(merged, "key long, part int, value binary"), "level"))

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return rows[["key", "part"]].assign(state=push(rows["value"].tolist(), rows["state"].iloc[0]))

    states = up[-1].select("key", "part", F.lit(start).alias("state"))
    for level in up[-2::-1]:
        above = states.withColumnRenamed("part", "above")
        states = level.withColumn("above", F.floor(F.col("part") / fan).cast("int")).join(above, ["key", "above"])
        states = materialize(states.groupBy("key", "above").applyInPandas(down, "key long, part int, state binary"), "states")
    return states


def _encoder(model: bytes, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for block in blocks(batches):
            made, sizes, valid = [], [], []
            for text in block.column("text").to_pylist():
                ids = encode_text(text, pieces) if text else []
                made += ids
                sizes.append(len(ids))
                valid.append(text is not None)
            off = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=np.append(~np.array(valid), False)), pa.array(np.array(made, np.int32)))
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in kept], lists], names=[*kept, "ids"])

    return run


def _cut(rows: DataFrame, chunk: int, reach: int) -> DataFrame:
    """(key, part, last, text): each text in chunks, each with what follows it up to the longest piece, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                text = text.as_py()
                for part, at in enumerate(range(0, len(text), chunk)):
                    row = ([key], [part], [at + chunk >= len(text)], [text[at : at + chunk + reach]])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.bool_(), pa.string()))], names=["key", "part", "last", "text"])

    return rows.mapInArrow(run, "key long, part int, last boolean, text string")


def encode(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Add ``ids`` (array<int>) to ``docs``; a column of that name is replaced.

    The model file is read once, on the driver. Texts of more than two chunks are
    cut into chunks of ``chunk`` characters, scanned and backtraced as this
    module says, with the same ids; other texts are one chunk. Null texts have
    null ids, empty texts none; repeated rows have the same ids; an empty table
    gives an empty result, and no name of another column clashes. Characters that
    no piece covers, and the model's own space mark in a text, become bytes, so
    decoding gives every text back exactly.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    pieces = load(model)
    reach = pieces.longest
    if chunk <= reach:
        raise ValueError(f"chunks must be longer than the longest piece, of {reach} characters")
    body = F.col(text).cast("string")
    body = F.when(F.length(body) > 0, F.concat(F.lit(" " if pieces.dummy_prefix else ""), body)).otherwise(body)
    rows, kept = packed(docs, ["ids"], text=body)
    giant = F.coalesce(F.length("text") > 2 * chunk, F.lit(False))
    whole = rows.where(~giant)
    whole = whole.mapInArrow(_encoder(model, ["own"]), whole.select("own").schema.add("ids", T.ArrayType(T.IntegerType())))
    # keys of rows are drawn once and written, as rows need no key of their own
    large = materialize(rows.where(giant).withColumn("key", F.monotonically_increasing_id()), "giants")
    if large.isEmpty():
        return unpacked(whole, kept, "ids")
    cut = materialize(_cut(large.select("key", "text"), chunk, reach).repartition("key", "part"), "chunks")
    most = cut.agg(F.max("part")).first()[0] + 1

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for block in blocks(batches):
            last = block.column("last").to_pylist()
            made = [chunk_matrix(t, len(t) if z else chunk, own, z).tobytes() for t, z in zip(block.column("text").to_pylist(), last)]
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("part"), pa.array(made, pa.binary())], names=["key", "part", "value"])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for block in blocks(batches):
            columns = (block.column(c).to_pylist() for c in ("text", "last", "state"))
            made = [enters(t, len(t) if z else chunk, np.frombuffer(v, np.int64), own, z).tobytes() for t, z, v in zip(*columns)]
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("part"), pa.array(made, pa.binary())], names=["key", "part", "value"])

    fields = "key long, part int, value binary"
    first = np.full(reach, NONE, np.int64)
    first[0] = 0
    before = _sweep(materialize(cut.mapInArrow(matrices, fields), "matrices"), most, product, scores_before, first.tobytes(), fan)
    ways = materialize(cut.join(before, ["key", "part"]).mapInArrow(tables, fields), "tables")
    leaves = _sweep(ways, most, composed, leaves_of, np.int32(0).tobytes(), fan)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for block in blocks(batches):
            columns = (block.column(c).to_pylist() for c in ("text", "last", "value", "state"))
            made = []
            for t, z, table, leave in zip(*columns):
                x = int(np.frombuffer(leave, np.int32)[0])
                made.append(encode_text(t[int(np.frombuffer(table, np.int32)[x]) : (len(t) if z else chunk) + x], own))
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("part"), pa.array(made, pa.list_(pa.int32()))], names=["key", "part", "ids"])

    coded = cut.join(ways, ["key", "part"]).join(leaves, ["key", "part"]).mapInArrow(encoded, "key long, part int, ids array<int>")
    coded = coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])).alias("ids"))
    return unpacked(whole.union(large.drop("text").join(coded, "key").select("own", "ids")), kept, "ids")


def decode(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (string), the text of ``ids``; a column of that name is replaced.

    Null ids stay null, no ids are an empty text, and unknown and null ids and
    control pieces are empty. Repeated rows decode alike; an empty table gives an
    empty result, and no name of another column clashes.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    rows, kept = packed(coded, ["decoded"], ids=F.col(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prefix = piece_bytes(model)
        top = len(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for i in range(part.num_rows):
                    own = part.column("ids")[i]
                    if not own.is_valid:
                        out.append(None)
                        continue
                    raw = b"".join([table[k] if 0 <= k < top else b"" for k in own.values.fill_null(-1).to_numpy(zero_copy_only=False).tolist()])
                    out.append(raw[1 if prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("own"), pa.array(out, pa.string())], names=["own", "decoded"])

    return unpacked(rows.mapInArrow(run, rows.select("own").schema.add("decoded", "string")), kept, "decoded")
