"""Connected components by distributed union-find: alternating large and small stars.

Every round is two aggregations and joins; its edges are written to the shared
folder, so lineage stays short and a lost executor costs one round at most. The edges
of the round before go then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), written: the smallest node of its component, for every node that an edge names.

    Order, direction and repetition of edges do not matter; loops and edges with a
    null end are ignored.
    """
    pairs = edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    pairs = written(pairs.filter("x and y and low <> high").select("low", "high").distinct(), "edges")
    known = None
    while True:
        # Large star: all larger neighbours of a node move to the smallest node around it.
        both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(pairs.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low <> high").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high"))
        before, pairs = pairs, written(small.filter("low <> high").distinct(), "edges")
        discard(before)
        # Stars that no longer change: every node hangs on one root, which hangs on nothing.
        state = pairs.agg(F.count("*"), F.countDistinct("high"), F.sum(F.xxhash64("low", "high").cast("decimal(38, 0)"))).first()
        if state == known:
            break
        known = state
    roots = pairs.select("low").distinct().select(F.col("low").alias("node"), F.col("low").alias("root"))
    found = written(pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots), "roots")
    discard(pairs)
    return found
