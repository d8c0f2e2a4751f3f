"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import written

MOST_ROUNDS = 64
#: Parts that the edges of a node are dealt to when its minimum goes back to them.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame, node: str, far: str) -> DataFrame:
    """edges with the minimum m of their node; a node's edges are spread over SALTS parts."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(far), F.lit(SALTS))).join(salted, [node, "salt"]).drop("salt")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for every node of an edge (two long columns) the smallest node that it reaches.

    Only minima are gathered at a node and sent back by a join, so a node with very many
    neighbours needs no list. Each round is a written table, which cuts the lineage.
    Null ends and loops are left out; no edges give no rows.
    """
    edges = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        # large star: each neighbour above a node gets the smallest node near it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with_least(both.where("v > u"), least, "u", "v").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: a node and its smaller neighbours get the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = _with_least(large, least, "v", "u")
        small = linked.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").unionByName(least.select(F.col("m").alias("u"), "v"))
        edges = written(small.distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
