"""Columns of rings that only numpy can work out: buffers, simplified rings, and the union of buffered parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import polygon

RING = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"]))


def _points(ring: polygon.Ring) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ring.tolist()]


def ring_buffer(ring: Column | str, distance: float, steps: int = 16) -> Column:
    """The outer ring of all points within ``distance`` of a ring, or of what is left of it if negative; null if nothing is left or there was none."""

    @F.pandas_udf(RING)
    def grown(rings: pd.Series) -> pd.Series:
        made = [polygon.buffer([polygon.as_ring(r)], distance, steps) if r is not None and len(r) else [] for r in rings]
        return pd.Series([_points(polygon.exterior(m)) if m else None for m in made], dtype=object)

    return grown(ring)


def ring_simplify(ring: Column | str, tolerance: float) -> Column:
    """A ring without points that are nearer than ``tolerance`` to the line without them; null stays null."""

    @F.pandas_udf(RING)
    def simpler(rings: pd.Series) -> pd.Series:
        return pd.Series([_points(polygon.simplify(polygon.as_ring(r), tolerance)) if r is not None else None for r in rings], dtype=object)

    return simpler(ring)


def joined_parts(parts: Column | str, distance: float = 1.0) -> Column:
    """The outer ring of the union of the first two of several rings, each grown by ``distance``; null for null or fewer than two."""

    @F.pandas_udf(RING)
    def joined(rows: pd.Series) -> pd.Series:
        out = []
        for rings in rows:
            grown = [polygon.buffer([polygon.as_ring(r)], distance) for r in rings[:2] if r is not None and len(r)] if rings is not None and len(rings) > 1 else []
            whole = polygon.union(grown) if len(grown) == 2 and all(grown) else []
            out.append(_points(polygon.exterior(whole)) if whole else None)
        return pd.Series(out, dtype=object)

    return joined(parts)
