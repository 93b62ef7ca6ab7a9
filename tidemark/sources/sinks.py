"""Where results go: JSON lines, CSV pivots, reports, and an upsert of judgements."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dataset_hash(queries: list[str]) -> str:
    """Twelve hex digits that name a list of questions, whatever engine reads it."""
    return hashlib.sha1(json.dumps(queries).encode()).hexdigest()[:12]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_aggregate(long: DataFrame, path: str, metrics: list[str]) -> None:
    """system x metric means as one CSV file, blank where missing."""
    wide = long.groupBy("system").pivot("metric", metrics).agg(F.avg("value")).orderBy("system")
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(cells: DataFrame) -> DataFrame:
    """system, line: a table row of ``mean ± ci`` cells. ``cells``: system, metric, mean, ci95, n."""
    cell = F.when(F.col("n") > 0, F.format_string("%.3f ± %.3f", "mean", "ci95")).otherwise("")
    rows = cells.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("metric", cell.alias("cell")))).alias("cells"))  # a few metrics
    return rows.select("system", F.concat(F.lit("| "), "system", F.lit(" | "), F.array_join(F.transform("cells", lambda c: c["cell"]), " | "), F.lit(" |")).alias("line"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``old``, replaced by those of ``new`` with the same keys."""
    rows = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))).where("_r = 1")
    return first.drop("_r", "_age")


def upsert(spark: SparkSession, old: str | None, new: DataFrame, keys: list[str], to: str) -> None:
    """:func:`upserted` from one folder (or none) to another."""
    before = new.limit(0) if old is None else spark.read.parquet(old)
    upserted(before, new, keys).write.mode("overwrite").parquet(to)


def csv_lines(wide: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, line: a CSV line of ``%.3f`` cells, blank where missing."""
    cells = [F.when(F.col(m).isNotNull(), F.format_string("%.3f", F.col(m))).otherwise("") for m in metrics]
    return wide.select(key, F.concat_ws(",", F.col(key), *cells).alias("line"))


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """key, line: each row as one JSON object."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("line"))
