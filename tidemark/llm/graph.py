"""Connected components over edge tables of any size: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    onward = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return onward.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the least node it is connected to.

    No group of neighbours is gathered: each round is a minimum per node and a join, and its edges
    are written to the shared folder, so a lost executor restarts one round at most.
    """
    now = shared.written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        stars = shared.written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        shared.drop(now)
        now, before, mark = stars, mark, _mark(stars)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
