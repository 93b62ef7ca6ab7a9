"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Each turn gets the rolling hash of the turns
up to it; a conversation whose whole hash is such a prefix hash of a longer one is dropped by an
anti-join, and of equal conversations the one with the least id stays. What is left is rendered.

The turns are range-partitioned by (conversation, turn), so one conversation may lie in many tasks. A task
hashes its own turns; what its first conversation has before is a length and two numbers for each task,
composed on the driver, and shifts the task's hashes.

Defined cases: turns without a conversation id form one conversation; null roles and texts count as
empty; turns with the same number are ordered by role, then text; repeated rows are turns of their own;
an empty table gives an empty result. Columns besides the four are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels, shared

#: Turns in a part of a rendered conversation.
PART_TURNS = 64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_SEEDS = (17, 42)
_WRAP = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _local_hashes(turns: DataFrame, kind: str) -> DataFrame:
    """Rows in order with their task, and position and hashes of the turns up to them within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, length, sums = TaskContext.get().partitionId(), object(), 0, [0, 0]
        for batch in batches:
            names = batch.column(0).to_pylist()
            turns = [f"{r}\0{t}".encode() for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n = len(names)
            new = np.array([names[k] != (names[k - 1] if k else last) for k in range(n)], bool)
            first = np.flatnonzero(np.concatenate(([True], new[1:]))) if n else np.zeros(0, np.int64)
            position, columns = np.zeros(n, np.int64), []
            for a, b in zip(first, np.append(first[1:], n)):
                position[a:b] = np.arange(1, b - a + 1) + (length if a == 0 and not new[0] else 0)
            for lane in (0, 1):
                own = np.array([xxhash.xxh64_intdigest(t, _SEEDS[lane]) for t in turns], np.uint64)
                out = np.zeros(n, np.uint64)
                for a, b in zip(first, np.append(first[1:], n)):
                    before, start = (sums[lane], length) if a == 0 and not new[0] else (0, 0)
                    shift = np.uint64(pow(_BASES[lane], start, 1 << 64))
                    out[a:b] = np.cumsum(own[a:b] * _powers(_BASES[lane], b - a)) * shift + np.uint64(before)
                columns.append(out)
            if n:
                last, length, sums = names[-1], int(position[-1]), [int(c[-1]) for c in columns]
            arrays = [*(batch.column(k) for k in range(3)), pa.array(np.full(n, task)), pa.array(position), *(pa.array(c.view(np.int64)) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "role", "text", "task", "position", "hash_a", "hash_b"])

    return turns.mapInArrow(kernels.freed(run), f"conv_id {kind}, role string, text string, task long, position long, hash_a long, hash_b long")


def prefixes(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position, role, text, hash_a, hash_b: each turn with the hashes of the turns up to it."""
    spark = turns.sparkSession
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "_turn").sortWithinPartitions("conv_id", "_turn", "role", "text")
    local = shared.written(_local_hashes(ordered.select("conv_id", "role", "text"), kind), "turns")
    by_conversation = local.groupBy("task", "conv_id").agg(F.max("position").alias("n"), F.max_by("hash_a", "position").alias("a"), F.max_by("hash_b", "position").alias("b"))
    # of a task only the first and the last conversation can go on in another: two rows for each task
    ends = by_conversation.groupBy("task").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("k"), "conv_id", "n", "a", "b")).alias("first"), F.max(F.struct(F.col("conv_id").isNotNull().alias("k"), "conv_id", "n", "a", "b")).alias("last"), F.count(F.lit(1)).alias("many"))
    carry, held = {}, None
    for r in ends.orderBy("task").collect():
        before = held if held is not None and held[0] == r.first.conv_id else (r.first.conv_id, 0, 0, 0)
        if before[1]:
            carry[r.task] = before
        start = before if r.many == 1 else (r.last.conv_id, 0, 0, 0)
        sums = ((s + pow(base, start[1], 1 << 64) * x) & _WRAP for s, base, x in zip(start[2:], _BASES, (r.last.a, r.last.b)))
        held = (r.last.conv_id, start[1] + r.last.n, *sums)
    return _shifted(local, kind, carry)


def _shifted(local: DataFrame, kind: str, carry: dict[int, tuple]) -> DataFrame:
    """Adds to each task's first conversation what it has in the tasks before. ``carry``: an entry a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, position = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            lanes = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64).copy() for k in (5, 6)]
            position = position.copy()
            for t in np.unique(task):
                if int(t) in carry:
                    name, n, *sums = carry[int(t)]
                    own = np.array([x == name for x in batch.column(0).to_pylist()], bool) & (task == t)
                    position[own] += n
                    for lane, before, base in zip(lanes, sums, _BASES):
                        lane[own] = lane[own] * np.uint64(pow(base, n, 1 << 64)) + np.uint64(before)
            arrays = [batch.column(0), pa.array(position), batch.column(1), batch.column(2), *(pa.array(x.view(np.int64)) for x in lanes)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "position", "role", "text", "hash_a", "hash_b"])

    return local.mapInArrow(kernels.freed(run), f"conv_id {kind}, position long, role string, text string, hash_a long, hash_b long")


def _with_parts(turns: DataFrame, conversations: DataFrame, part_turns: int) -> DataFrame:
    """The turns of some conversations (conv_id, n_turns), with n_turns and part; joined part by part, so that a
    conversation of any length is spread over the tasks."""
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / part_turns).cast("long"))
    wanted = conversations.select(F.col("conv_id").alias("_conv"), "n_turns", F.explode(every).alias("_part"))
    parted = turns.withColumn("part", F.floor((F.col("position") - 1) / part_turns).cast("long"))
    return parted.join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no prefix of a longer one, one of equal ones.

    ``turns``: what :func:`prefixes` returns, written."""
    lengths = turns.groupBy("conv_id").agg(F.max("position").alias("n_turns"), F.max_by("hash_a", "position").alias("a"), F.max_by("hash_b", "position").alias("b"))
    lengths = shared.written(lengths, "conversations")
    one = lengths.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = _with_parts(turns, lengths.select("conv_id", "n_turns"), PART_TURNS).where(F.col("position") < F.col("n_turns"))
    inner = inner.select("position", "hash_a", "hash_b").distinct()
    same = (F.col("n_turns") == F.col("position")) & (F.col("a") == F.col("hash_a")) & (F.col("b") == F.col("hash_b"))
    return one.join(inner, same, "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, kept: DataFrame, *, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns, rendered: the kept conversations in parts of ``part_turns`` turns."""
    own = _with_parts(turns, kept, part_turns)
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    parts = own.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


def collapse(turns: DataFrame, **columns) -> DataFrame:
    """The maximal conversations of ``turns``, rendered."""
    hashed = shared.written(prefixes(turns, **columns), "prefixes")
    return render(hashed, maximal(hashed))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """conv_id, part, n_turns, rendered of the maximal conversations."""
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position
  FROM conversations),
prefixes AS (
  SELECT *, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY position) AS so_far,
         max(position) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns),
whole AS (SELECT so_far, n_turns, min(conv_id) AS conv_id FROM prefixes WHERE position = n_turns GROUP BY so_far, n_turns),
kept AS (
  SELECT conv_id, n_turns FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.so_far = w.so_far AND p.position < p.n_turns))
SELECT t.conv_id, (t.position - 1) // 64 AS part, k.n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM turns t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY t.conv_id, (t.position - 1) // 64, k.n_turns
"""
