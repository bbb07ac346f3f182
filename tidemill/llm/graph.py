"""Connected components by alternating large-star and small-star steps, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; the component is its least node.

    Self edges and nulls are left out, repeated edges count once, no edges give no rows. Each round is written
    to the shared folder. The rounds grow with the logarithm of the number of nodes; needing more than most_rounds
    raises an error rather than returning an unfinished labelling.
    """
    now, seen = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least neighbours are written first: of a join of two tables Spark can split a node with very many edges.
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # Here a node's edges lead to least neighbours only, so none has very many.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        after, before = _written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()), seen
        discard(least, large, now)
        now, seen = after
        if seen == before:
            break
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, written, and their number and two sums of hashes, which tell whether a round changed anything."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("y")), "edges")
    return out, dict(seen.get)
