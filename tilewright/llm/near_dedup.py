"""Near-duplicate documents: MinHash over word shingles, tensored banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from ..storage import materialize, small_enough
from .text_arrays import blocks, mix, shingles, utf8

SHINGLE = 5
#: Two collections of ``SIDE`` half-keys; every pair of one from each is a table's key.
SIDE, WIDTH = 8, 2
TABLE_HASHES = 2 * SIDE * WIDTH
#: Further minhashes sharpen the estimate that comes before verification.
HASHES = 64
#: Documents a block of a cluster holds, where leaders leave it in several components.
BLOCK = 1024
#: Shingles a side of a block holds, about, and columns of the matrices that meet there.
BLOCK_WORDS, COLUMNS = 2_000_000, 4096
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit minhashes of each row's shingle hashes: (rows, HASHES); rows without shingles have zeros."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        for k, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat((hashes ^ seed) * np.uint64(0xD6E8FEB86659FD93), starts)
            out[full, k] = mix(least).astype(np.uint16)
    return out


def _signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, set_a, set_b, sig): the set's size, 128 bits that equal sets share, its minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, bounds = shingles(*utf8(block.column("text")), SHINGLE)
            size = np.diff(bounds)
            total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix(hashes), mix(hashes ^ np.uint64(0x5851F42D4C957F2D))], axis=1), axis=0, dtype=np.uint64)])
            sets = (total[bounds[1:]] - total[bounds[:-1]]).astype(np.uint64)
            sig = minhashes(hashes, bounds)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(size, pa.int64()), pa.array(sets[:, 0].view(np.int64)) if len(sets) else pa.array([], pa.int64()), pa.array(np.ascontiguousarray(sets[:, 1]).view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "n", "set_a", "set_b", "sig"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, sig binary")


def _table_keys(reps: DataFrame) -> DataFrame:
    """(key, id) for all SIDE * SIDE tables: half-keys of the two collections, paired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)[:, :TABLE_HASHES].astype(np.uint64)
                half = (sig[:, 0::2] << np.uint64(16) | sig[:, 1::2]).reshape(len(sig), 2, SIDE)
                pairs = half[:, 0, :, None] << np.uint64(32) | half[:, 1, None, :]
                keys = mix(pairs.reshape(len(sig), -1) ^ mix(np.arange(SIDE * SIDE, dtype=np.uint64)))
                ids = np.repeat(part.column("id").to_numpy(), SIDE * SIDE)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def _agreement(a: str, b: str):
    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, HASHES) for s in (x, y))
        return pd.Series((left == right).sum(axis=1).astype(np.int32))

    return agree(a, b)


def _sets(docs: DataFrame, members: DataFrame, count: int, doc_id: str, text: str) -> DataFrame:
    """(id, n, shingles) of the documents in ``members``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, bounds = shingles(*utf8(block.column("text")), SHINGLE)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(np.diff(bounds), pa.int64()), lists], names=["id", "n", "shingles"])

    side = F.broadcast(members) if small_enough(count, 40) else members
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(side, "id", "left_semi")
    return rows.mapInArrow(run, "id long, n long, shingles array<long>").dropDuplicates(["id"])


def _confirmed(sets: DataFrame, pairs: DataFrame, min_percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; sets meet in the JVM, two at a time.

    Sets are merged, never broadcast: the size of their file, by which Spark would
    choose, says little about that of sets which share most of their shingles.
    """
    left, right = (sets.toDF(x, f"n{x}", f"s{x}").hint("merge") for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = both.where(100 * F.least("na", "nb") >= min_percent * F.greatest("na", "nb")).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return shared.where((100 + min_percent) * F.col("shared") >= min_percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b, ..) that ``links`` do not join."""
    near = materialize(connected_components(links), "components")
    near = F.broadcast(near) if small_enough(near.count(), 40) else near
    for end in ("a", "b"):
        pairs = pairs.join(near.toDF(end, f"c{end}"), end, "left")
    return pairs.where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one: products of 0/1 matrices, some shingles at a time."""
    flat, owner = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    # a shingle of one set alone is shared by none
    some = times[code] > 1
    code, owner = np.unique(code[some], return_inverse=True)[1], owner[some]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (c, c + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], code[a:b] - c] = 1
        out += part[left] @ part[right].T
    return out.astype(np.int64)


def _links_in(min_percent: int):
    """Links (a, b) that join what a block's two sides hold: every pair of different components is judged on full sets, a forest of those that hold goes out."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, joined = rows["id"].to_numpy(), rows["joined"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
        shared = _shared(sets, left, right)
        good = ((100 + min_percent) * shared >= min_percent * (size[left][:, None] + size[right])) & (joined[left][:, None] != joined[right])
        found, fresh = [], [np.ones(len(left), bool), np.ones(len(right), bool)]
        for start in np.flatnonzero(good.any(axis=1)).tolist():
            todo = [(0, start)] if fresh[0][start] else []
            fresh[0][start] = False
            while todo:
                side, k = todo.pop()
                to = np.flatnonzero((good[:, k] if side else good[k]) & fresh[1 - side])
                fresh[1 - side][to] = False
                own = ids[(right if side else left)[k]]
                found += [(own, other) for other in ids[(left if side else right)[to]].tolist()]
                todo += [(1 - side, j) for j in to.tolist()]
        made = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": made.min(axis=1, initial=1 << 62), "b": made.max(axis=1, initial=-1 << 62)}).astype("int64")

    return run


def _beyond_leaders(sets: DataFrame, coarse: DataFrame, links: DataFrame, min_percent: int) -> DataFrame:
    """Links (a, b) of one cluster that ``links`` do not imply: each member outside a cluster's largest component meets all of others.

    They meet in blocks of two sides, by their full sets, and only links leave a
    block, fewer than its members. A side holds at most about ``BLOCK`` members
    and ``BLOCK_WORDS`` shingles.
    """
    clusters = connected_components(coarse).toDF("id", "cluster")
    joined = connected_components(links).toDF("id", "joined")
    members = materialize(clusters.join(joined, "id", "left").withColumn("joined", F.coalesce("joined", "id")).join(sets.select("id", "n"), "id"), "clusters")
    parts = members.groupBy("cluster", "joined").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    top = F.max(F.struct("k", "w", "joined"))
    mixed = parts.groupBy("cluster").agg(F.sum("k").alias("m"), F.sum("w").alias("words"), top.alias("top"), F.count("*").alias("parts")).where("parts > 1")
    blocks_of = lambda k, w: F.ceil(F.greatest(k / BLOCK, w / BLOCK_WORDS, F.lit(1))).cast("int")
    rows = members.drop("n").join(mixed, "cluster").select(
        "cluster", "id", "joined", (F.col("joined") != F.col("top.joined")).alias("other"), blocks_of(F.col("m"), F.col("words")).alias("all_blocks"), blocks_of(F.col("m") - F.col("top.k"), F.col("words") - F.col("top.w")).alias("other_blocks")
    )
    rows = materialize(rows.join(sets.select("id", "shingles").hint("merge"), "id"), "members")
    block = lambda seed, of: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    own = ["id", "joined", "shingles"]
    left = rows.where("other").select("cluster", block("other", "other_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(0).alias("side"), *own)
    right = rows.select("cluster", every("other_blocks").alias("i"), block("all", "all_blocks").alias("j"), F.lit(1).alias("side"), *own)
    return left.union(right).groupBy("cluster", "i", "j").applyInPandas(_links_in(min_percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, min_percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if 100 * intersection >= ``min_percent`` * union of their
    sets of 5-word shingles (A-Z lower-cased, words between ASCII white space).
    A component is named by its smallest id, whose row is the one kept. Equal
    sets are one class and are searched once. Table keys pair half-keys from two
    small collections: 32 minhashes make 64 tables of four. In each bucket every
    member is proposed to a leader drawn anew for each table; proposals that the
    64 minhashes do not rule out (four and a half standard errors) make clusters.
    Each member's best proposal is confirmed on full sets first, then those that
    this does not join. Where a cluster is of several components even then, each
    member outside its largest one is compared with all of others on full sets,
    block by block, and a block hands on fewer links than it has members; no pair
    of a cluster is left out.
    Links are joined by distributed connected components.

    Texts without words, and null texts, have an empty set and link with nothing.
    Rows of one id are one document: they share a component. A null id has a null
    component and is kept. Other columns are ignored.
    """
    share = min_percent / 100
    floor = int(np.floor(HASHES * (share - 4.5 * np.sqrt(share * (1 - share) / HASHES))))
    sigs = materialize(_signatures(docs, doc_id, text), "signatures")
    classes = sigs.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.min("sig").alias("sig"))
    classes = materialize(classes, "classes")
    keys = materialize(_table_keys(classes), "keys")
    # a leader for each key, drawn by a hash that differs from table to table; minima combine map-side
    draw = F.struct(F.xxhash64("id", "key").alias("d"), F.col("id").alias("id"))
    leaders = keys.groupBy("key").agg(F.min(draw).alias("lead"), F.count("*").alias("members")).where("members > 1").select("key", F.col("lead.id").alias("leader"))
    leaders = materialize(leaders, "leaders")
    leaders = F.broadcast(leaders) if small_enough(leaders.count(), 40) else leaders
    proposed = materialize(keys.join(leaders, "key").where("id <> leader").select("leader", "id").distinct(), "proposed")
    ids = classes.select("id", "sig")
    judged = proposed.join(ids.withColumnRenamed("sig", "x"), "id").join(ids.select(F.col("id").alias("leader"), F.col("sig").alias("y")), "leader")
    coarse = judged.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"), _agreement("x", "y").alias("agree")).where(F.col("agree") >= floor)
    coarse = materialize(coarse.distinct(), "coarse")
    wanted = materialize(coarse.select(F.col("a").alias("id")).union(coarse.select("b")).distinct(), "wanted")
    sets = materialize(_sets(docs, wanted, wanted.count(), doc_id, text), "sets")
    best = coarse.select(F.explode(F.array("a", "b")).alias("id"), F.struct("agree", "a", "b").alias("p")).groupBy("id").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
    links = materialize(_confirmed(sets, best, min_percent), "links")
    rest = materialize(_apart(coarse.select("a", "b"), links), "apart")
    links = links.union(materialize(_confirmed(sets, rest, min_percent), "links"))
    links = links.union(materialize(_beyond_leaders(sets, coarse, links, min_percent), "links"))
    joined = connected_components(links)
    named = classes.select("set_a", "set_b", "id").join(joined, classes["id"] == joined["node"], "left")
    named = named.select(F.col("set_a").alias("sa"), F.col("set_b").alias("sb"), F.coalesce("component", "id").alias("c"))
    out = sigs.drop("sig").join(named, (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb")) & (F.col("n") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
