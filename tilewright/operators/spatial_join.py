"""Joins of boxes by cells of a grid, so that Spark plans an equi-join and not a nested loop."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, box_meets


def cells(low: Column, high: Column, size: int, closed: bool = True) -> Column:
    """Indices of the grid cells that an interval covers; without ``closed``, an end on a cell's edge does not reach the next."""
    first = F.floor(low / size)
    last = F.floor(high / size) if closed else F.greatest(F.ceil(high / size) - 1, first)
    return F.sequence(first, last)


def with_cells(df: DataFrame, size: int, closed: bool = True, prefix: str = "", names: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """One row for each cell that a box covers, with the cell's column and row as ``names``; rows with a null bound have none."""
    b = box(prefix)
    first, last = [], []
    for low, high in ((b.x0, b.x1), (b.y0, b.y1)):
        f = F.floor(low / size)
        first.append(f)
        last.append(F.floor(high / size) if closed else F.greatest(F.ceil(high / size) - 1, f))
    cx, cy = names
    wide = last[0] - first[0] + 1
    # one generator for both axes
    each = df.withColumn("__n", F.explode(F.sequence(F.lit(0).cast("long"), wide * (last[1] - first[1] + 1) - 1)))
    return each.withColumns({cx: first[0] + F.col("__n") % wide, cy: first[1] + F.floor(F.col("__n") / wide)}).drop("__n")


def box_join(left: DataFrame, right: DataFrame, size: int, keys: list[str] = (), where: Column | None = None, small: bool = False) -> DataFrame:
    """Pairs of boxes that meet (closed): columns of ``left`` as l_*, of ``right`` as r_*.

    Both sides are dealt to the cells they cover and joined on ``keys`` and the
    cell; a pair counts in the cell of its common corner alone, so nothing needs
    a distinct. Rows with a null bound join nothing. A cell that very many boxes
    cover is split by the adaptive skew join. ``small`` sends ``left`` to all.
    """
    l, r = (with_cells(df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns]), size, prefix=p) for df, p in ((left, "l"), (right, "r")))  # noqa: E741
    a, b = box("l"), box("r")
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    right_cells = r.withColumnsRenamed({"cx": "rcx", "cy": "rcy"})
    meet = (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & box_meets(a, b)
    meet = meet & (F.col("cx") == F.floor(F.greatest(a.x0, b.x0) / size)) & (F.col("cy") == F.floor(F.greatest(a.y0, b.y0) / size))
    for c in [*on, *([where] if where is not None else [])]:
        meet = meet & c
    return (F.broadcast(l) if small else l).join(right_cells, meet).drop("cx", "cy", "rcx", "rcy")


def box_self_join(df: DataFrame, size: int, id_col: str = "id", keys: list[str] = (), where: Column | None = None) -> DataFrame:
    """Pairs of different boxes of one table that meet, each once, the smaller id as l."""
    once = F.col(f"l_{id_col}") < F.col(f"r_{id_col}")
    return box_join(df, df, size, keys, once if where is None else once & where)


#: Pairs of boxes of a block that are looked at at once.
PAIRS_AT_ONCE = 1 << 21


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, each node's least known companion, after the links (a, b) too."""
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _chains(box: np.ndarray, strip: int) -> np.ndarray:
    """For each box (x0, y0, x1, y1), closed, the number of the first of its chain of meeting ones; found in strips of rows, by x."""
    low = np.floor_divide(box[:, 1], strip).astype(np.int64)
    many = np.floor_divide(box[:, 3], strip).astype(np.int64) - low + 1
    own = np.repeat(np.arange(len(box)), many)
    line = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    order = np.lexsort((box[own, 0], line))
    own, line = own[order], line[order]
    root = np.arange(len(box))
    for at in np.split(own, np.flatnonzero(np.diff(line)) + 1):
        # those that begin before a box ends
        b, until = box[at], np.searchsorted(box[at, 0], box[at, 2], side="right")
        near = until - np.arange(len(at)) - 1
        work, k = np.cumsum(near), 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(work, (work[k - 1] if k else 0) + PAIRS_AT_ONCE, side="right")))
            n = near[k:to]
            i = np.repeat(np.arange(k, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            meet = (b[i, 1] <= b[j, 3]) & (b[j, 1] <= b[i, 3])
            root = _roots(root, at[i[meet]], at[j[meet]])
            k = to
    return root


def meeting_chains(df: DataFrame, size: int, id_col: str = "id", keys: list[str] = (), strip: int = 64) -> DataFrame:
    """(i, j): links by which boxes that meet (closed) hang together, as pairs of :func:`box_self_join` do, but fewer than boxes in a cell.

    Boxes are dealt to the cells they cover; in each cell every box is linked to
    the first of its chain. Rows with a null bound or key have none.
    """
    dealt = with_cells(df.select(F.col(id_col).cast("long").alias("id"), *keys, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), size)
    dealt = dealt.where(functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ("id", *keys)]))

    def run(cell: pa.Table) -> pa.Table:
        own = cell.column("id").to_numpy()
        root = _chains(np.stack([cell.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1), strip)
        linked = root != np.arange(len(root))
        return pa.table({"i": own[root[linked]], "j": own[linked]})

    return dealt.groupBy(*keys, "cx", "cy").applyInArrow(run, "i long, j long")


def centroid_pairs(df: DataFrame, reach: int, id_col: str = "id", keys: list[str] = ()) -> DataFrame:
    """(l_id, r_id, d4): pairs whose box centres are at most ``reach`` apart; ``d4`` is four times the squared distance.

    Twice the centre keeps whole coordinates whole. The right side is dealt to
    its own cell and four of the eight around it.
    """
    sides = df.select(F.col(id_col).alias("id"), *keys, (F.col("x0") + F.col("x1")).alias("px"), (F.col("y0") + F.col("y1")).alias("py"))
    cell = lambda c: F.floor(F.col(c) / (2 * reach))
    left = sides.select(F.col("id").alias("l_id"), *[F.col(k).alias(f"l_{k}") for k in keys], F.col("px").alias("lx"), F.col("py").alias("ly"), cell("px").alias("cx"), cell("py").alias("cy"))
    right = sides.select(F.col("id").alias("r_id"), *[F.col(k).alias(f"r_{k}") for k in keys], F.col("px").alias("rx"), F.col("py").alias("ry"), cell("px").alias("bx"), cell("py").alias("by"))
    # the cell itself and every second of those around it, so that two cells meet once
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    right = right.withColumn("step", F.explode(steps)).select(*[c for c in right.columns if c not in ("bx", "by")], (F.col("bx") + F.col("step.x")).alias("rcx"), (F.col("by") + F.col("step.y")).alias("rcy"), ((F.col("step.x") == 0) & (F.col("step.y") == 0)).alias("same"))
    d4 = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    on = (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & F.expr("l_id < r_id or (not same and l_id > r_id)")
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    near = left.join(right, on).withColumn("d4", d4).where(F.col("d4") <= 4 * reach * reach)
    return near.select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id"), "d4")
