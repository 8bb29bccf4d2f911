"""Connected components by alternating stars, on DataFrames.

Each round replaces the edges of every node by edges to its least neighbour:
first for its larger neighbours, then for its smaller ones.  Edges shrink to
stars in a number of rounds that grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import done_with, written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): every id with a link to another, and the least id it can reach.

    links: two columns a, b of a type that has an order.  Links of an id with
    itself or with null are ignored.  With rounds, no more than so many are
    run: ids with one component are connected then, but not all that are have one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before, done = print_of(edges), 0
    while before[0] and done != rounds:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old, edges = edges, written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        done_with(old)
        done += 1
        if done == rounds:
            break
        after = print_of(edges)
        if after == before:
            break
        before = after
    if rounds:
        return edges.union(edges.select("v", "v")).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.select(F.col("u").alias("id"), F.col("m").alias("component")).union(least.select("m", "m").distinct())
