"""Tables and files in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a temporary
folder is made and set. Written tables cut the lineage: a lost executor costs no recomputation of
what was written, unlike a localCheckpoint.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI; sets a temporary one only where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the driver and the executors need a folder that they share")
        conf = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, computed once. Not lazy."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["shared_path"] = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a table that :func:`written` made, once nothing reads it any more."""
    path = table.__dict__.get("shared_path")
    if path:
        delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written[:] = [x for x in _written if x[1] != path]


def small_batches(spark: SparkSession) -> None:
    """Send 2,000 whole documents a batch to Python where the session leaves Spark's 10,000 rows, which bounds memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "2000")


def sampled(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The ``most`` rows with the least hashes of some columns; rows that are equal in those stay together.

    Only hashes are ordered, so no wide row is gathered."""
    key = F.xxhash64(*columns)
    last = rows.select(key.alias("key")).orderBy("key").limit(most).agg(F.max("key")).first()[0]
    return rows.where(key <= F.lit(last)) if last is not None else rows.limit(0)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    It does so once the JVM has collected the driver's objects, which takes two rounds: the plan, then what it held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            delete(spark, path)
        except Exception:  # the session has ended: the folder is the cluster's to clear
            return


# Files that Python workers write and memory-map themselves.


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file atomically. A retried task writes the same bytes under the same name."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def get_file(uri: str) -> bytes:
    """A whole file of the shared folder; nothing if there is no such file."""
    path = _local(uri)
    if path is not None:
        if not os.path.exists(path):
            return b""
        with open(path, "rb") as src:
            return src.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return b""
    with store.open_input_stream(inner) as src:
        return src.read()


def map_file(uri: str, dtype):
    """A file of the shared folder as a memory-mapped numpy array; empty if there is no such file.

    A store without local paths is copied to a temporary file first, which is unlinked as soon as it
    is mapped, so nothing stays on the executor's disk.
    """
    import numpy as np

    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return np.zeros(0, dtype)
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(inner) as src:
        while block := src.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype=dtype, mode="r") if os.path.getsize(copy.name) else np.zeros(0, dtype)
