"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (its lines; within a line also after words whose hash says so, about every
eighth, so that a change moves no other cut, and after sixteen words without a cut). Each paragraph's digest, made distinct by how often it came
before in the text, is added to ``HASHES`` cells of a sketch: a count, the XOR of digests and the XOR of
their checks. Two versions' sketches subtract cell by cell; peeling cells with one digest left recovers
the digests that are in one version only. If peeling stops early, both sketches are made again four times
as large, until it ends.

Likeness is the share of paragraphs in common: 2 x common / (all of both), 1 for two empty texts.

Defined cases: null texts count as empty; repeated ids are ordered by text, in descending order like the
ids; rows without an id come last; ids are whole numbers; a single document is followed by itself. Columns besides the id and
the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels

#: Cells of the sketch that is kept; a power of two.
CELLS = 32
HASHES = 3
GROWTH = 4
_CUT = 8
_LONGEST = 16
_SALTS = np.array([0x8CB92BA72F3D8DD7, 0x4CF5AD432745937F, 0xBF597FC7BEEF1B0D], np.uint64)
_CHECK = np.uint64(0x2545F4914F6CDD1D)


class Paragraphs:
    """Digests of the paragraphs of some texts: ``digest`` by text, ``first`` as in kernels.Block."""

    def __init__(self, texts: list[bytes]):
        parts = [self._of(kernels.Block(texts[a:b], lower=False)) for a, b in kernels.blocks(texts)]
        self.digest = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.count = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    @staticmethod
    def _of(block: kernels.Block) -> tuple[np.ndarray, np.ndarray]:
        n = len(block.first) - 1
        breaks = np.flatnonzero(block.raw == 10)
        cut = np.zeros(len(block.raw) + 1, bool)
        cut[breaks + 1] = True
        words = block.word_hash()
        own = words % np.uint64(_CUT) == 0
        place = np.arange(len(words))
        line = np.searchsorted(breaks, block.starts)
        begin = own.copy()
        begin[:-1] |= line[1:] != line[:-1]  # the next word begins a paragraph
        since = place - np.maximum.accumulate(np.concatenate(([0], np.where(begin, place + 1, 0)[:-1]))) if len(words) else place
        own |= since % _LONGEST == _LONGEST - 1
        cut[block.ends[own]] = True
        cut[0], cut[-1] = False, False
        ends = np.append(np.flatnonzero(cut), len(block.raw)) if len(block.raw) else np.zeros(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        text = np.searchsorted(block.text_start, starts, "right") - 1
        # the newline that joins two texts belongs to neither; an empty text has no paragraph
        last = ends == block.text_start[text + 1]
        stop = ends - last
        full = stop > starts
        digest, text = block.span_hash(starts[full], stop[full]), text[full]
        order = np.lexsort((digest, text))
        same = np.concatenate(([False], (digest[order][1:] == digest[order][:-1]) & (text[order][1:] == text[order][:-1]))) if len(order) else np.zeros(0, bool)
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
        again = np.empty(len(order), np.uint64)
        again[order] = run.astype(np.uint64)
        return kernels.mix(digest + again * np.uint64(0x9E3779B97F4A7C15)), np.bincount(text, minlength=n)


def _cells(digest: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest for each hash; each hash has a part of the cells to itself."""
    part = cells // HASHES
    return [(kernels.mix(digest ^ s) % np.uint64(part)).astype(np.int64) + k * part for k, s in enumerate(_SALTS)]


def _check(digest: np.ndarray) -> np.ndarray:
    return kernels.mix(digest * _CHECK + np.uint64(7))


class Sketches:
    """One sketch for each of ``n`` texts: arrays of n x cells."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.digests, self.checks = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def add(self, text: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(digest)
        for cell in _cells(digest, self.cells):
            at = text * self.cells + cell
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digests, at, digest)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count = self.count - other.count
        out.digests, out.checks = self.digests ^ other.digests, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, digest and sign of all recovered digests, and which texts were recovered whole."""
        texts, digests, signs = [], [], []
        at = np.flatnonzero(np.abs(self.count) == 1)
        while True:
            at = at[(np.abs(self.count[at]) == 1) & (_check(self.digests[at]) == self.checks[at])]
            if not len(at):
                break
            text, digest, sign = at // self.cells, self.digests[at], self.count[at]
            _, first = np.unique(kernels.mix(digest) ^ text.astype(np.uint64), return_index=True)  # one digest may stand in several cells
            text, digest, sign = text[first], digest[first], sign[first]
            texts.append(text), digests.append(digest), signs.append(sign)
            self.add(text, digest, -sign)
            at = np.unique(np.concatenate([text * self.cells + c for c in _cells(digest, self.cells)]))
        whole = ((self.count == 0) & (self.digests == 0) & (self.checks == 0)).reshape(self.n, self.cells).all(axis=1)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *texts]), np.concatenate([none.astype(np.uint64), *digests]), np.concatenate([none, *signs]), whole

    def to_bytes(self, k: int, paragraphs: int) -> bytes:
        own = slice(k * self.cells, (k + 1) * self.cells)
        checks = (self.checks[own] >> np.uint64(32)).astype("<u4")
        return b"".join(x.tobytes() for x in (np.array([paragraphs], "<u4"), self.count[own].astype("<i4"), self.digests[own].astype("<u8"), checks))


def sketch(paragraphs: Paragraphs, cells: int = CELLS) -> Sketches:
    out = Sketches(len(paragraphs.count), cells)
    out.add(paragraphs.text, paragraphs.digest)
    return out


def fingerprints(paragraphs: Paragraphs, sketches: Sketches) -> list[str]:
    """Each sketch as text."""
    return [base64.b64encode(sketches.to_bytes(k, int(n))).decode() for k, n in enumerate(paragraphs.count)]


def _chosen(paragraphs: Paragraphs, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = np.cumsum(keep) - 1
    own = keep[paragraphs.text]
    return number[paragraphs.text[own]], paragraphs.digest[own]


def differences(one: Paragraphs, other: Paragraphs, first: tuple[Sketches, Sketches] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, digest and sign (1: only in ``one``) of the paragraphs in which two versions of each text differ."""
    n, cells = len(one.count), CELLS
    open_texts = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = first[0].minus(first[1]) if first else sketch(one).minus(sketch(other))
    while len(open_texts):
        text, digest, sign, whole = left.peel()
        sure = whole[text]
        out.append((open_texts[text[sure]], digest[sure], sign[sure]))
        open_texts = open_texts[~whole]
        cells *= GROWTH
        keep = np.zeros(n, bool)
        keep[open_texts] = True
        left = Sketches(len(open_texts), cells)
        for side, sign in ((one, 1), (other, -1)):
            left.add(*_chosen(side, keep), sign)
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))  # type: ignore[return-value]


def likeness(one: Paragraphs, other: Paragraphs, first: tuple[Sketches, Sketches] | None = None) -> np.ndarray:
    text, _, _ = differences(one, other, first)
    both = one.count + other.count
    return np.where(both > 0, (both - np.bincount(text, minlength=len(both))) / np.maximum(both, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by the first as many code points of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Texts of these bytes are compared together; one at least.
_BYTES = 1 << 20


def _compare(names: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    encoded = [[t.encode() for t in side] for side in (texts, changed, following)]
    paragraphs = [Paragraphs(side) for side in encoded]
    sketches = [sketch(p) for p in paragraphs]
    columns = [
        names,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in encoded[1]]),
        pa.array(fingerprints(paragraphs[0], sketches[0])),
        pa.array(fingerprints(paragraphs[1], sketches[1])),
        *(pa.array(likeness(paragraphs[0], paragraphs[k], (sketches[0], sketches[k]))) for k in (1, 2)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _below(value, bounds: list[int]):
    """How many of the sorted bounds are less than the value: first among every ``step``-th, then among those between."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    listed = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    outer = F.size(F.filter(F.expr(listed([g[-1] for g in groups])), lambda b: b < value))
    inner = F.get(F.expr(f"array({', '.join(map(listed, groups))})"), outer)
    return F.when(outer == len(groups), len(bounds)).otherwise(outer * step + F.size(F.filter(inner, lambda b: b < value)))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts_a_task: int = 4) -> tuple[DataFrame, int]:
    """Rows (bucket, edge, id, text) dealt by ranges of ids, each range with its next document as edge row.

    Only ids are looked at to find the ranges: their bounds, and the greatest id in each, are a few
    numbers for each task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = tasks * parts_a_task
    bounds = sorted(set(rows.where("id is not null").agg(F.expr(f"approx_percentile(id, array({', '.join(str(k / wanted) for k in range(1, wanted))}), 100000)")).first()[0] or []))
    # ids above bounds[k - 1] and up to bounds[k] are in bucket k; rows without an id come last, so lowest
    bucket = F.when(F.col("id").isNull(), F.lit(-1))
    bucket = bucket.otherwise(_below(F.col("id"), bounds))
    dealt = rows.withColumn("bucket", bucket)
    top = {r.bucket: r.top for r in dealt.groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    order = sorted(top, reverse=True)
    # the first row of each bucket is wanted after the last of the bucket above, in a ring
    above = {b: order[k - 1] for k, b in enumerate(order)}
    plain = dealt.select("bucket", F.lit(0).alias("edge"), "id", "text")
    tops = spark.createDataFrame([(b, top[b], above[b]) for b in order], "b int, top long, above int")
    first = dealt.join(F.broadcast(tops), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("top")))
    first = first.groupBy("above").agg(F.max(F.struct(F.col("id"), F.col("text"))).alias("row"))
    edges = first.select(F.col("above").alias("bucket"), F.lit(1).alias("edge"), F.col("row.id").alias("id"), F.col("row.text").alias("text"))
    return plain.unionByName(edges), tasks


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and to the next document."""
    rows, tasks = with_next(docs, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            while held.num_rows > 1:
                size = pc.cumulative_sum(pc.fill_null(pc.binary_length(held.column(3)), 0).cast(pa.int64())).to_numpy()
                part = held.slice(0, max(2, int(np.searchsorted(size, _BYTES)) + 1))
                texts = part.column(3).to_pylist()
                # an edge row ends its range and is no row of its own
                own = [k for k, edge in enumerate(part.column(1).to_pylist()[:-1]) if not edge]
                if own:
                    yield _compare(part.column(2).take(pa.array(own)).cast(out_type), [texts[k] for k in own], [texts[k + 1] for k in own])
                held = held.slice(part.num_rows - 1)

    from pyspark.sql.pandas.types import to_arrow_type

    out_type = to_arrow_type(docs.schema[id_col].dataType)
    dealt = rows.repartition(tasks, "bucket").sortWithinPartitions(F.col("bucket").desc(), "edge", F.col("id").desc_nulls_last(), F.col("text").desc())
    return dealt.mapInArrow(kernels.freed(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of documents and of its edited text, with likenesses."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
