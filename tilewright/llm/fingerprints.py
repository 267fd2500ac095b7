"""Document fingerprints: Merkle trees over sections, paragraphs and content-defined leaves."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .text_arrays import blocks

#: Leaves that a fingerprint shows, those of the least digests; likeness is an estimate from so many.
SKETCH = 128
BUCKETS_A_TASK = 4
# A leaf ends after a word that ends in one of these, or with its paragraph, so one changed word changes its own leaf and the next at most.
LEAF = re.compile(r"(?s).+?(?:[adgjmpsvyADGJMPSVY147.!?]\s+|$)")
LOW = -(1 << 63)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree(NamedTuple):
    """Digests from the root down; ``sections`` holds the paragraph count of each section, ``leaves`` the leaves of all paragraphs."""

    root: bytes
    section_digests: list[bytes]
    sections: list[int]
    paragraphs: list[bytes]
    leaves: list[bytes]


def merkle_tree(text: str | None) -> Tree:
    """The tree of a text; null is empty.

    Paragraphs are lines, cut into leaves of a few words. A section ends before
    a blank line, and after a paragraph whose digest says so (one in eight), so
    sections depend on their content alone and an edit moves no other section's
    bounds. A digest is that of the digests below it; those of leaves are of the
    text.
    """
    paragraphs, leaves = [], []
    for line in (text or "").split("\n"):
        own = [xxhash.xxh3_128_digest(leaf.encode("utf-8", "surrogatepass")) for leaf in LEAF.findall(line)]
        leaves += own
        paragraphs.append(_digest(b"".join(own)))
    blank, sections, run = _digest(b""), [], 0
    for d in paragraphs:
        if d == blank and run:
            sections.append(run)
            run = 0
        run += 1
        if d[0] < 32:
            sections.append(run)
            run = 0
    if run:
        sections.append(run)
    ends = np.cumsum(sections).tolist()
    tops = [_digest(b"".join(paragraphs[e - n : e])) for e, n in zip(ends, sections)]
    return Tree(_digest(b"".join(tops)), tops, sections, paragraphs, leaves)


def fingerprint(text: str | None) -> str:
    """The root and the ``SKETCH`` least different leaves of the tree, by their first four bytes, in hex: equal texts have equal fingerprints."""
    tree = merkle_tree(text)
    least = sorted({leaf[:4] for leaf in tree.leaves})[:SKETCH]
    return tree.root.hex() + ":" + b"".join(least).hex()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1: 1 at equal roots, else the Jaccard similarity of the trees' leaves as the fingerprints show it."""
    (root_a, x), (root_b, y) = a.split(":"), b.split(":")
    if root_a == root_b:
        return 1.0
    if x == y:
        # same leaves in another order: as like as can be, but not equal
        return 1.0 - 1e-6 if x else 0.0
    left, right = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
    union = sorted(left | right)
    if max(len(left), len(right)) >= SKETCH:
        union = union[:SKETCH]
    return sum(p in left and p in right for p in union) / len(union)


def fingerprint_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every node of every tree: (doc_id, level, position, parent, digest); level 0 is the root, 1 sections, 2 paragraphs.

    Positions count the nodes of a level from 0, and ``parent`` is the position
    of the node above. Null texts are empty, rows of one id have the nodes of
    each, and an empty table has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for key, body in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                t = merkle_tree(body)
                above = np.repeat(np.arange(len(t.sections)), t.sections).tolist()
                rows.append((key, 0, 0, None, t.root.hex()))
                rows += [(key, 1, i, 0, d.hex()) for i, d in enumerate(t.section_digests)]
                rows += [(key, 2, i, above[i], d.hex()) for i, d in enumerate(t.paragraphs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "level", "position", "parent", "digest"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, level int, position long, parent long, digest string")


def _matched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes (doc_id, position, digest) of two versions, the k-th of a digest with the k-th: (doc_id, old, new), one of them null without a match."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("position"))
    old = before.select("doc_id", "digest", nth.alias("nth"), F.col("position").alias("old"))
    new = after.select("doc_id", "digest", nth.alias("nth"), F.col("position").alias("new"))
    return old.join(new, ["doc_id", "digest", "nth"], "full").select("doc_id", "old", "new")


def _moved(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs (old, new) of one document outside a longest sequence that keeps its order."""
    rows = rows.sort_values("old")
    new = rows["new"].to_numpy()
    tails, ends, back = [], [], np.full(len(new), -1)
    for i, v in enumerate(new.tolist()):
        k = bisect_left(tails, v)
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
        back[i] = ends[k - 1] if k else -1
    keep, i = np.zeros(len(new), bool), ends[-1] if ends else -1
    while i >= 0:
        keep[i], i = True, back[i]
    return rows[~keep][["doc_id", "old", "new"]]


def locate_edits(before: DataFrame, after: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where two versions of documents differ: (doc_id, change, old, new), positions of paragraphs.

    Node tables of both are joined from the root down. Documents of one root have
    no rows. In others, sections of equal digest are paired, the k-th with the
    k-th, and only the paragraphs of unpaired sections are compared, in the same
    way: ``removed`` paragraphs have no pair after, ``added`` ones none before,
    and ``moved`` are the pairs outside a longest run of pairs in order. A changed
    paragraph is removed and added. Documents of one version alone, and null ids,
    are left out; ids must be different within a version. Null texts are empty.
    """
    trees = [materialize(fingerprint_nodes(d, doc_id, text).where("doc_id is not null"), "nodes") for d in (before, after)]
    roots = [t.where("level = 0").select("doc_id", F.col("digest").alias(f"root{k}")) for k, t in enumerate(trees)]
    changed = materialize(roots[0].join(roots[1], "doc_id").where("root0 <> root1").select("doc_id"), "changed")
    old, new = (t.join(changed, "doc_id") for t in trees)
    sections = materialize(_matched(old.where("level = 1"), new.where("level = 1")), "sections")
    leaf = lambda side: side.where("level = 2").select("doc_id", "position", "parent", "digest")
    lone = lambda side, mine, other: leaf(side).join(sections.where(f"{other} is null").select("doc_id", F.col(mine).alias("parent")), ["doc_id", "parent"])
    below = materialize(_matched(lone(old, "old", "new"), lone(new, "new", "old")), "paragraphs")
    # pairs of whole sections stand for their paragraphs, which are as many on both sides
    span = lambda side, name: leaf(side).groupBy("doc_id", "parent").agg(F.min("position").alias(f"{name}0"), F.count("*").alias("n")).withColumnRenamed("parent", name)
    whole = sections.where("old is not null and new is not null").join(span(old, "old"), ["doc_id", "old"]).join(span(new, "new").drop("n"), ["doc_id", "new"])
    whole = whole.select("doc_id", "old0", "new0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("doc_id", (F.col("old0") + F.col("k")).alias("old"), (F.col("new0") + F.col("k")).alias("new"))
    pairs = whole.union(below.where("old is not null and new is not null"))
    moved = pairs.groupBy("doc_id").applyInPandas(_moved, "doc_id long, old long, new long").select("doc_id", F.lit("moved").alias("change"), "old", "new")
    lost = below.where("old is null or new is null").select("doc_id", F.when(F.col("new").isNull(), "removed").otherwise("added").alias("change"), "old", "new")
    return lost.union(moved)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (floor) replaced by as many first code points of ``following``, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt into buckets of neighbours and sorted, each bucket ended by a copy of the row that follows it.

    Rows are ordered by id, then a hash of the text; equal rows in any way.
    Buckets are quantiles of the ids, a fixed number for each task. An id with
    more rows than a bucket holds has buckets of its own, cut by the text's
    hash, and many equal rows are cut too. Only bounds and the first row's keys
    of each bucket reach the driver. Columns: (b1, b2, b3, tail, doc_id, text).
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW)).alias("key"), body.alias("text"))
    spark, names = docs.sparkSession, ["key", "h", "z"]
    count = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = BUCKETS_A_TASK * tasks
    limit = max(1, count // n)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 4 * n)).first()[0] if n > 1 and count else []
    # fewer than n ids, and fewer than n rows of one text, have more than count / n rows
    often = {r["key"]: r["count"] for r in rows.groupBy("key").count().where(F.col("count") > 2 * limit).collect()}
    rows = rows.withColumns({"h": F.xxhash64("text"), "z": F.xxhash64(F.monotonically_increasing_id())})
    equal = {}
    if often:
        held = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in often], "key long")), "key")
        equal = {(r["key"], r["h"]): r["count"] for r in held.groupBy("key", "h").count().where(F.col("count") > 2 * limit).collect()}
    bounds = np.unique(np.array([*(cuts or []), *often, *[k + 1 for k in often]], np.int64))

    def parts(keys: list, counts: dict) -> np.ndarray:
        return np.array([-(-counts.get(k, 0) // limit) for k in keys], np.uint64)

    def within(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Which of so many equal ranges of all 64-bit numbers holds ``x``."""
        return (((x.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.maximum(parts, np.uint64(1)) >> np.uint64(32)).astype(np.int32)

    @F.pandas_udf("b1 int, b2 int, b3 int")
    def place(key: pd.Series, h: pd.Series, z: pd.Series) -> pd.DataFrame:
        k, x, y = (c.to_numpy(np.int64) for c in (key, h, z))
        zero = np.zeros(len(k), np.int32)
        return pd.DataFrame({
            "b1": np.searchsorted(bounds, k, side="right").astype(np.int32),
            "b2": within(x, parts(k.tolist(), often)) if often else zero,
            "b3": within(y, parts(list(zip(k.tolist(), x.tolist())), equal)) if equal else zero,
        })

    # the columns are drawn again with the rows, as they depend on the input's splits alone
    dealt = rows.withColumn("b", place(*names)).select("b.*", *names, "doc_id", "text")
    heads = sorted(tuple(r["head"]) for r in dealt.groupBy("b1", "b2", "b3").agg(F.min(F.struct("b1", "b2", "b3", *names)).alias("head")).collect())
    ends = [(*heads[i - 1][:3], *head[3:]) for i, head in enumerate(heads)]
    # one row for each bucket: the bound is the number of buckets
    ends = F.broadcast(spark.createDataFrame(ends, "b1 int, b2 int, b3 int, key long, h long, z long"))
    tails = rows.join(ends, names).groupBy("b1", "b2", "b3").agg(F.min(F.struct(*names, "doc_id", "text")).alias("r"))
    columns = ["b1", "b2", "b3", "tail", *names, "doc_id", "text"]
    tails = tails.select("b1", "b2", "b3", F.lit(1).alias("tail"), "r.*").select(columns)
    both = dealt.withColumn("tail", F.lit(0)).select(columns).union(tails)
    return both.repartition(tasks, "b1", "b2", "b3").sortWithinPartitions("b1", "b2", "b3", "tail", *names)


def edit_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and its likeness to that and to the next document.

    The next document is the one with the next larger id; the first follows the
    last. Null ids come first, and rows of one id are ordered by text. Null texts
    count as empty; a single document follows itself; an empty table gives an
    empty result. Texts are shuffled once, by buckets of ids.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(key: int | None, body: str, own: str, following: str, then: str) -> tuple:
        changed = edited(body, following)
        print_ = fingerprint(changed)
        return key, len(body), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, then)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for block in blocks(batches):
            out = []
            for key, body, tail in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), block.column("tail").to_pylist()):
                own = fingerprint(body)
                if last is not None:
                    out.append(row(*last, body, own))
                last = None if tail else (key, body, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, doc_id, text).select("doc_id", "text", "tail").mapInArrow(run, schema)
