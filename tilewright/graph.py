"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


#: Links a file of a round holds at least, while there are fewer than so many files.
EDGES_A_FILE, MOST_FILES = 200_000, 64


def _once(links: DataFrame) -> DataFrame:
    return links.groupBy("u", "v").agg(F.bool_or("moved").alias("moved"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour; ``moved`` marks links that this changes."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _once(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them; ``moved`` as before."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.bool_or("moved").alias("moved"))
    apart = edges.select("u", "v").join(least.where("m <> top").select("u", "m"), "u").where("v <> m")
    return _once(apart.select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")).union(least.select("u", F.col("m").alias("v"), "moved")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component) for every node of an edge; the component is its smallest node.

    Edges and labels stay distributed; each round is written to the shared
    folder, so a lost executor costs one round, and the rounds end when none of
    their steps moves a link. Minima are combined map-side, so they gather in no
    task; the joins that follow are keyed by node, and a hub with very many edges
    is left there to the adaptive skew join. Null ends and loops are ignored; an
    empty edge table gives an empty result.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = materialize(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(hi, lo).distinct(), "edges")
    # rounds never add links: small graphs are written as few files
    files, moved = 1 + edges.count() // EDGES_A_FILE, True
    while moved:
        before, edges = edges, _small_star(_large_star(edges))
        edges = materialize(edges.coalesce(files) if files < MOST_FILES else edges, "edges")
        discard(before)
        moved = not edges.where("moved").isEmpty()
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
