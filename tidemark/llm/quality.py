"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (no source, language or id) are computed with numpy over Arrow batches. The
trees are fitted on the driver on a bounded sample of labelled rows (``sample_rows``, the rows with the
least hashes of their ids), flattened into arrays, and shipped to the tasks, which walk all rows of a
batch through one tree level at a time.

Defined cases: null text counts as empty, and empty texts are scored like any other; labelled rows that
are null in the id or the label, or have no document, are not learnt from; where an id has several
labels or documents, each labelled row is its own example. Without any example the score is 0.5. A
document without an id is scored and not held out. Ties in the sample go by id. Input columns besides
the id and the text are passed through or ignored, never read as features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels, shared

#: Most labelled rows that the trees are fitted on.
SAMPLE_ROWS = 20_000
STATISTICS = (
    "log_words log_bytes word_length upper digit exclaim symbol pipe stop comma space line_length last_mark distinct_words top_word repeated_neighbour "
    "distinct_pairs marked_words dirty_words repeated_lines dirty_word_run short_words non_ascii upper_words"
).split()


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags(b"0123456789")
_EXCLAIM, _SYMBOL, _PIPE = _flags(b"!"), _flags(b"#$%&*@^~<>{}[]\\_=+"), _flags(b"|")
_STOP, _COMMA, _HIGH = _flags(b".?:;"), _flags(b","), _flags(bytes(range(128, 256)))


def _per_text(block: kernels.Block, per_word: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(per_word, dtype=np.int64)))
    return c[block.first[1:]] - c[block.first[:-1]]


def _runs(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct keys, and how often its commonest key occurs."""
    if not len(key):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    both = np.sort((text.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    counts = np.diff(np.append(new, len(both)))
    at = (both[new] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, at, counts)
    return np.bincount(at, minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for a, b in kernels.blocks(texts):
        out[a:b] = _block_statistics(kernels.Block(texts[a:b]), b - a)
    return out


def _block_statistics(block: kernels.Block, n: int) -> np.ndarray:
    raw, words = block.raw, block.n_words
    size = np.diff(block.text_start) - 1
    per_byte = lambda flags: block.sums(flags[raw]) / np.maximum(size, 1)
    some = np.maximum(words, 1)
    length = block.ends - block.starts
    text, hashed = block.text_of_word(), block.word_hash()
    distinct, top = _runs(text, hashed, n)
    same_text = text[1:] == text[:-1]
    neighbour = np.zeros(len(text), bool)
    neighbour[1:] = same_text & (hashed[1:] == hashed[:-1])
    pairs = kernels.mix(hashed[:-1] * np.uint64(3) + hashed[1:]) if len(hashed) else hashed
    pair_kinds, _ = _runs(text[1:][same_text], pairs[same_text] if len(pairs) else pairs, n)
    bad = np.concatenate(([0], np.cumsum(_SYMBOL[raw] | _EXCLAIM[raw] | _PIPE[raw], dtype=np.int64)))
    dirty = bad[block.ends] > bad[block.starts]
    caps = np.concatenate(([0], np.cumsum(_UPPER[raw], dtype=np.int64)))
    shouted = (caps[block.ends] - caps[block.starts]) * 2 > length
    last = raw[block.ends - 1] if len(text) else raw[:0]
    marked = _STOP[last] | _COMMA[last] | _EXCLAIM[last]
    dirty_run = np.zeros(len(text), bool)
    dirty_run[1:] = same_text & dirty[1:] & dirty[:-1]
    breaks = raw == 10
    line_ends = np.flatnonzero(breaks)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    full = line_ends > line_starts
    line_text = np.searchsorted(block.text_start, line_starts[full], "right") - 1
    lines = np.bincount(line_text, minlength=n)
    line_kinds, _ = _runs(line_text, block.span_hash(line_starts[full], line_ends[full]), n)
    columns = [
        np.log1p(words), np.log1p(size), _per_text(block, length) / some, per_byte(_UPPER), per_byte(_DIGIT), per_byte(_EXCLAIM), per_byte(_SYMBOL), per_byte(_PIPE),
        per_byte(_STOP), per_byte(_COMMA), per_byte(kernels.WHITE), np.log1p(size / np.maximum(lines, 1)), _per_text(block, marked) / some, distinct / some, top / some,
        _per_text(block, neighbour) / some, pair_kinds / np.maximum(words - 1, 1), _per_text(block, marked) / np.maximum(lines, 1), _per_text(block, dirty) / some,
        1 - line_kinds / np.maximum(lines, 1), _per_text(block, dirty_run) / some, _per_text(block, length <= 2) / some, per_byte(_HIGH), _per_text(block, shouted) / some,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees as flat arrays: node k of a tree has children 2k+1 and 2k+2; a leaf has feature -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                down = 2 * at + 1 + (x[row, f] > threshold[at])
                at = np.where(f < 0, at, down)
            total += value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least_rows: float = 5.0, penalty: float = 1.0) -> Trees:
    """Logistic loss, second order; splits are searched in histograms of quantile bins."""
    nodes = (1 << depth + 1) - 1
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, nodes))
        odds = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Trees(odds, empty.astype(np.int64), empty, empty)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T.astype(np.float64)]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T.astype(np.float64))])  # bin b: at most cuts[b]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            first, width = (1 << level) - 1, 1 << level
            live = at >= first
            slot = at[live] - first
            total_g, total_h = (np.bincount(slot, w[live], width) for w in (g, h))
            value[first : first + width] = -rate * total_g / (total_h + penalty)
            if level == depth:
                break
            best = np.full(width, 1e-6)
            for f, b in enumerate(binned):
                key = slot * bins + b[live]
                hg, hh, hn = (np.bincount(key, w, width * bins).reshape(width, bins) for w in (g[live], h[live], np.ones(len(slot))))
                lg, lh, ln = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1], hn.cumsum(1)[:, :-1]
                rg, rh, rn = total_g[:, None] - lg, total_h[:, None] - lh, hn.sum(1)[:, None] - ln
                gain = lg**2 / (lh + penalty) + rg**2 / (rh + penalty) - (total_g**2 / (total_h + penalty))[:, None]
                gain[(ln < least_rows) | (rn < least_rows)] = 0
                gain[:, len(cuts[f]) :] = 0
                k = gain.argmax(1)
                won = np.flatnonzero(gain[np.arange(width), k] > best)
                best[won] = gain[won, k[won]]
                feature[first + won], threshold[first + won] = f, cuts[f][k[won]] if len(cuts[f]) else 0
            f = feature[at]
            right = x[np.arange(len(y)), f].astype(np.float64) > threshold[at]
            at = np.where((f < 0) | ~live, at, 2 * at + 1 + right)
        score += value[at]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(values))


def _crc_mod(id_col: str, k: int):
    return F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % {k}")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees learnt from labelled rows, at most ``sample_rows``, outside the held-out third."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where("_id is not null and _y in (0, 1)").where(_crc_mod("_id", 3) != 1)
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows))  # 12 bytes a row
    joined = docs.select(id_col, F.col(text_col).alias("_text")).join(sample, F.col(id_col) == F.col("_id")).select("_id", "_y", "_text")
    rows = shared.sampled(joined, sample_rows, "_id", "_text", "_y").select("_y", "_text")  # where ids repeat
    names = ", ".join(f"s{k} float" for k in range(len(STATISTICS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(kernels.texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], names=["y", *(f"s{k}" for k in range(x.shape[1]))])

    got = np.array(sorted(tuple(r) for r in rows.mapInArrow(kernels.freed(run), f"y int, {names}").collect()), np.float64)
    if not len(got):
        return fit_trees(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit_trees(got[:, 1:].astype(np.float32), got[:, 0])


def score(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.predict(statistics(kernels.texts_of(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_crc_mod(id_col, 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernels.freed(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.predict(statistics(kernels.texts_of(batch.column(at))))
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(kernels.freed(run), docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents, learnt from labels.quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
