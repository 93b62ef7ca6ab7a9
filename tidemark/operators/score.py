"""Heuristic answer quality, retries and the memory of useful terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dictionaries as D
from tidemark.functions import text as T
from tidemark.operators import order


def quality_floor(results: DataFrame) -> DataFrame:
    """query_id, quality, positive: best token overlap with bonuses, lifted by the sources found.

    ``results``: query_id, query, source, text of the retrieved documents; one row with null source and
    text where nothing was retrieved."""
    terms = T.tokens(F.col("query"))
    body = F.lower(F.coalesce("text", F.lit("")))
    hits = T.overlap_tokens(terms, T.tokens(F.col("text")))
    feed = F.coalesce(F.col("source").isin(D.FEEDS), F.lit(False))
    hits = hits + F.when(feed & (hits >= 1), 3).otherwise(0)
    hits = hits + F.when(F.contains(body, F.substring(F.lower("query"), 1, 20)), 5).otherwise(0)
    rows = results.select("query_id", "source", hits.alias("hits"), F.size(terms).alias("n"), feed.alias("feed"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    by_query = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("source").isNotNull(), F.col("hits"))).alias("best"), F.max("n").alias("n"), flag(F.col("feed")).alias("feed"),
        flag(F.col("source") == "vendor_releases").alias("releases"), flag(F.col("source") == "vendor_reddit").alias("posts"), flag(F.col("source").isin(D.TIER1)).alias("tier1"),
    )
    base = F.coalesce(F.least(F.col("best") / F.greatest("n", F.lit(1)), F.lit(1.0)), F.lit(0.0))
    base = F.when(F.col("feed"), F.greatest(base, F.lit(0.3))).otherwise(base)
    quality = F.when(F.col("releases") & F.col("posts"), F.greatest(base, F.lit(0.65))).when(F.col("releases") | F.col("posts"), F.greatest(base, F.lit(0.5)))
    quality = quality.when(F.col("tier1"), F.greatest(base, F.lit(0.3))).otherwise(base)
    return by_query.select("query_id", quality.alias("quality"), (quality >= 0.15).alias("positive"))


def coverage(total: Column, parts: list[tuple[float, Column]], weight: float, full: float) -> Column:
    """Weighted share of a full result list and of the keywords found in each source, at most 1."""
    out = weight * F.least(total / full, F.lit(1.0))
    for w, share in parts:
        out = out + w * F.least(share, F.lit(1.0))
    return F.least(out, F.lit(1.0))


def volume(total: Column, full: float = 15.0) -> Column:
    return F.least(total / full, F.lit(1.0))


def exactness(has_exact: Column, has_releases: Column, has_posts: Column) -> Column:
    return F.when(has_exact, 1.0).when(has_releases & has_posts, 0.6).when(has_releases | has_posts, 0.35).otherwise(0.1)


def memory_deltas(rows: DataFrame, seq: str, original: Column, rewritten: Column, quality: Column, neutral: float = 0.3) -> DataFrame:
    """seq, term, delta: what each step adds to the terms that rewriting brought in."""
    extra = F.filter(F.array_except(T.tokens(rewritten), T.tokens(original)), lambda t: (F.length(t) > 3) & t.rlike("^[a-z]+$"))
    return rows.select(seq, F.explode(extra).alias("term"), (quality - neutral).alias("delta"))


def class_deltas(rows: DataFrame, seq: str, original: Column, rewritten: Column, quality: Column, *, least: float = 0.15, loss: float = 0.1) -> DataFrame:
    """seq, term, delta: extra terms gain the quality of a success and lose ``loss`` at a failure.

    A failed question is asked again and judged with the same rewrite, so its terms lose twice."""
    extra = F.array_except(T.tokens(rewritten), T.tokens(original))
    good = quality >= least
    times = F.when(good, F.array(quality)).otherwise(F.array(F.lit(-loss), F.lit(-loss)))
    return rows.select(seq, F.explode(extra).alias("term"), times.alias("deltas")).select(seq, "term", F.explode("deltas").alias("delta"))


def suggested(query: Column, best: Column, most: int = 3) -> Column:
    """The first ``most`` of the best terms that the question does not contain, joined by spaces."""
    return F.array_join(F.filter(F.slice(best, 1, most), lambda t: ~F.contains(F.lower(query), t)), " ")


def memory_scores(deltas: DataFrame, seq: str) -> DataFrame:
    """The log with the running score of each term."""
    window = Window.partitionBy("term").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("score", F.sum("delta").over(window))


def memory_curve(steps: DataFrame, deltas: DataFrame, seq: str) -> DataFrame:
    """seq, memory_size: distinct terms known after each step."""
    new = deltas.groupBy("term").agg(F.min(seq).alias(seq)).groupBy(seq).agg(F.count(F.lit(1)).alias("new"))
    rows = steps.select(seq).join(new, seq, "left").select(seq, F.coalesce("new", F.lit(0)).cast("long").alias("new"))
    return order.running_sum(rows, seq, F.col("new"), "memory_size").select(seq, "memory_size")


def trending(upvote_ratio: Column, comments: Column, score: Column, topical: Column, recent: Column, no_vendor: Column) -> Column:
    out = upvote_ratio * 10 + comments * 0.5 + score * 0.1 + F.when(topical, 5).otherwise(0) + F.when(comments > 5, 3).otherwise(0)
    return out + F.when(recent, 2).otherwise(0) - F.when(no_vendor & (score < 5), 5).otherwise(0)
