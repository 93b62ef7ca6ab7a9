"""Graded retrieval metrics, confidence intervals and comparisons of systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(ranking: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first occurrence of each document, ranked anew."""
    first = ranking.groupBy(*by, "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "doc_id")))


def ir_metrics(ranking: DataFrame, grades: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = ("query_id",)) -> DataFrame:
    """mrr, and recall, precision and ndcg at each k, for every query; null where nothing was retrieved.

    Precision divides by k; recall and the ideal order look at all judged documents. ``grades``: query_id,
    doc_id, grade."""
    seen = deduplicated(ranking, by).join(grades, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))
    hit = F.col("grade") >= 1
    parts = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        near = F.col("rank") <= k
        parts += [F.count_if(hit & near).alias(f"h{k}"), F.sum(F.when(near, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"d{k}")]
    got = seen.groupBy(*by).agg(*parts)
    ideal = grades.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.count_if(hit).alias("relevant"), *(F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias(f"i{k}") for k in ks))
    joined = queries.select(*by).join(got.withColumn("some", F.lit(True)), list(by), "left").join(best, "query_id", "left")
    some = lambda c: F.when(F.col("some"), c)
    out = [*by, some(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        relevant = F.coalesce("relevant", F.lit(0))
        out += [
            some(F.when(relevant > 0, F.least(F.col(f"h{k}") / relevant, F.lit(1.0))).otherwise(0.0)).alias(f"recall_{k}"),
            some(F.col(f"h{k}") / float(k)).alias(f"precision_{k}"),
            some(F.when(F.col(f"i{k}") > 0, F.col(f"d{k}") / F.col(f"i{k}")).otherwise(0.0)).alias(f"ndcg_{k}"),
        ]
    return joined.select(*out)


def mean_ci(value: Column) -> list[Column]:
    """Mean, half width of the 95 % interval (0 for under two values) and count; nulls are skipped."""
    n = F.count(value)
    return [F.avg(value).alias("mean"), F.when(n < 2, 0.0).otherwise(1.96 * F.stddev_samp(value) / F.sqrt(n)).alias("ci95"), n.alias("n")]


def long_form(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A row (keys, metric, value) for each metric column."""
    return rows.unpivot(list(keys), list(metrics), "metric", "value")


def paired(rows: DataFrame, baseline: str, treated: str, by: Sequence[str] = (), better: float = 0.01) -> DataFrame:
    """Means, improvement in percent of at least 0.001, and how many improved, for all rows or by group."""
    b, t = F.avg(baseline), F.avg(treated)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), b.alias("mean_baseline"), t.alias("mean_treated"),
        ((t - b) / F.greatest(b, F.lit(0.001)) * 100).alias("improvement_pct"),
        F.count_if(F.col(treated) > F.col(baseline) + better).alias("n_better"),
        F.count_if(F.col(treated) - F.col(baseline) > 1e-9).alias("helped"),
        F.count_if(F.col(baseline) - F.col(treated) > 1e-9).alias("hurt"),
        F.count_if(F.abs(F.col(baseline) - F.col(treated)) <= 1e-9).alias("tied"),
    )


def tertile_gain(rows: DataFrame, seq: str, value: str, total: int) -> DataFrame:
    """Means of the first and the last max(n // 3, 1) rows by ``seq`` (1 to ``total``), and the gain in percent."""
    part = max(total // 3, 1)
    early, late = (F.avg(F.when(c, F.col(value))) for c in (F.col(seq) <= part, F.col(seq) > total - part))
    return rows.agg(F.lit(part).alias("part"), early.alias("early"), late.alias("late"), ((late - early) / F.greatest(early, F.lit(0.001)) * 100).alias("gain_pct"))
