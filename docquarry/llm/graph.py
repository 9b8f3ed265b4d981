"""Connected components over an edge table by alternating large and small stars, each round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import Scratch


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, and the least node that it reaches (itself for the least).

    ``edges`` has long columns u and v. A hub's rows are never gathered: only minima are grouped, and joins of written
    tables on them can be split where a hub is large."""
    edges = scratch.save("edges-0", _ordered(edges))
    state, k = _state(edges), 0
    while True:
        k += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(f"least-{k}", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(f"large-{k}", _ordered(large))
        least = scratch.save(f"small-{k}", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = scratch.save(f"edges-{k}", _ordered(small))
        scratch.drop(f"edges-{k - 1}", f"least-{k}", f"large-{k}", f"small-{k}")
        edges, before, state = new, state, _state(new)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
