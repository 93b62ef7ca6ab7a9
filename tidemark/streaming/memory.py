"""The memory of useful terms over a stream of answered questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import score as S


def term_scores(answered: DataFrame, late: str | None = None, time: str = "ts") -> DataFrame:
    """term, score, uses as a streaming (or batch) aggregation of ``answered``: query_id, query, rewritten, quality.

    With ``late`` (an interval) rows later than that behind the newest are left out, by hour windows."""
    keep = ["query_id"] if late is None else ["query_id", time]
    deltas = S.memory_deltas(answered.withColumn("_k", F.struct(*keep)), "_k", F.col("query"), F.col("rewritten"), F.col("quality"))
    if late is not None:
        deltas = deltas.select("term", "delta", F.col(f"_k.{time}").alias(time)).withWatermark(time, late)
        return deltas.groupBy(F.window(time, "1 hour"), "term").agg(F.sum("delta").alias("score"), F.count(F.lit(1)).alias("uses"))
    return deltas.groupBy("term").agg(F.sum("delta").alias("score"), F.count(F.lit(1)).alias("uses"))


def start(answered: DataFrame, checkpoint: str, table: str, **trigger) -> StreamingQuery:
    """Append what each batch adds to the terms' scores to the folder ``table``.

    A batch that is run again replaces its own part, so nothing counts twice; :func:`current` adds the parts up."""

    def keep(batch: DataFrame, number: int) -> None:
        term_scores(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return answered.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """term, score, uses over all batches so far."""
    parts = spark.read.schema("term string, score double, uses long").parquet(table)
    return parts.groupBy("term").agg(F.sum("score").alias("score"), F.sum("uses").alias("uses"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names; a temporary one only where the master is this machine."""
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{shared.rstrip('/')}/memory-{uuid.uuid4().hex}"


def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that events bring in: the stream of the events folder, read to its end."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = path.rsplit("/", 1)[0]
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else folder + "/events*")
    rows = events.select(F.col("event_id").alias("query_id"), F.col("event_type").alias("query"), F.concat_ws(" ", "event_type", F.element_at(F.array(*map(F.lit, ["alpha", "bravo", "carol"])), (F.col("user_id") % 3 + 1).cast("int"))).alias("rewritten"), (F.col("value") / 100).alias("quality"))
    place = _folder(spark)
    start(rows, f"{place}/checkpoint", f"{place}/parts").awaitTermination()
    return current(spark, f"{place}/parts")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory())
