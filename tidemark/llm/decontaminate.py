"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item the windows of a document that are as many words long as the item (the whole
document if that is shorter) are compared with it. Items of one length share a multi-index: their SimHashes
are entered in tables by each of ``radius`` + 1 blocks of bits, one of which is equal whenever two
fingerprints are within the radius. A window's SimHash is looked up in all tables, so none within the radius
is missed. Candidates are verified by the exact weighted similarity of their five-word shingles (each counted
as often as it occurs): shared weight over joint weight, 0.8 or more.

The radius follows from the number of shingles: at the least similarity a bit differs with probability
arccos(shared share) / pi, and more bits than the radius differ with a probability below ``MISSED`` (0 bits
where the least similarity leaves no shingle to differ; about 24 else).

Not every window is fingerprinted: one of similarity 0.8 with an item of n shingles has at least 8/9 n places
with shingles of items of that length, so windows with fewer are passed over. That loses nothing and keeps
the cost proportional to the text, whatever items have in common.

Words are runs of letters, digits and non-ASCII characters, lower-cased; an item with fewer than five
words is one shingle. Items are shipped to tasks in blocks of a bounded size, one pass over the
documents for each block.

Defined cases: null texts count as empty; an empty item or document matches nothing; repeated items and
documents each give their own rows; rows without an id are compared like others. Other columns are
passed through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels

SHINGLE = 5
SIMILARITY = 0.8
#: Probability with which a pair of the least similarity may lie beyond the radius.
MISSED = 1e-6
#: Bytes of item texts that one pass holds.
ITEM_BLOCK_BYTES = 4 << 20
_GATE = 20


def _lowered(column: pa.Array) -> list[bytes]:
    return kernels.texts_of(pc.utf8_lower(column.cast(pa.large_string())))


def _fingerprint(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from bit sums (rows of 64) over n shingles."""
    return np.packbits(2 * sums > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def radius_for(n: int, similarity: float = SIMILARITY, missed: float = MISSED) -> int:
    """Bits by which the SimHashes of two windows of n shingles each may differ at the least similarity."""
    shared = math.ceil(2 * n * similarity / (1 + similarity) - 1e-9)
    if shared >= n:
        return 0
    p, tail = math.acos(shared / n) / math.pi, 1.0
    for r in range(65):
        tail -= math.comb(64, r) * p**r * (1 - p) ** (64 - r)
        if tail < missed:
            return r
    return 64


@dataclass
class Length:
    """The items of one length: their shingles, fingerprints and the multi-index over these."""

    words: int
    size: int  # words of a shingle
    items: np.ndarray
    shingles: np.ndarray  # sorted
    codes: np.ndarray
    radius: int
    tables: list[tuple[np.uint64, np.ndarray, np.ndarray]]  # mask, sorted values, items' places

    @property
    def n(self) -> int:
        return self.words - self.size + 1

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in codes, place in items) of all pairs within the radius."""
        found = [np.zeros(0, np.int64)]
        for mask, values, place in self.tables:
            low, high = (np.searchsorted(values, codes & mask, side) for side in ("left", "right"))
            row, k = _expand(high - low)
            found.append(row * len(self.items) + place[low[row] + k])
        row, item = np.divmod(np.unique(np.concatenate(found)), len(self.items))
        near = np.bitwise_count(codes[row] ^ self.codes[item]) <= self.radius
        return row[near], item[near]


@dataclass
class Items:
    """Index of some benchmark items."""

    ids: list
    shingle_counts: list[Counter]
    lengths: list[Length]
    gates: dict[int, np.ndarray]  # by shingle size: whether a shingle's first bits occur
    similarity: float


def index_items(ids: list, texts: list[bytes], *, size: int = SHINGLE, similarity: float = SIMILARITY, missed: float = MISSED) -> Items:
    counts: list[Counter] = []
    by_words: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, text in enumerate(texts):
        block = kernels.Block([text], word_table=kernels.WORDLIKE)
        n = len(block.starts)
        own = kernels.shingles(block.word_hash(), min(size, n)) if n else np.zeros(0, np.uint64)
        counts.append(Counter(own.tolist()))
        if n:
            by_words.setdefault(n, []).append((k, own))
    lengths, gates = [], {}
    for n, some in sorted(by_words.items()):
        s = min(size, n)
        codes = np.concatenate([_fingerprint(_bits(own).sum(0, dtype=np.int64)[None, :], np.array([len(own)])) for _, own in some])
        radius = radius_for(n - s + 1, similarity, missed)
        tables = []
        for b in range(radius + 1):
            mask = np.uint64(sum(1 << k for k in range(64 * b // (radius + 1), 64 * (b + 1) // (radius + 1))))
            order = np.argsort(codes & mask, kind="stable")
            tables.append((mask, (codes & mask)[order], order))
        shingles = np.unique(np.concatenate([own for _, own in some]))
        lengths.append(Length(n, s, np.array([k for k, _ in some]), shingles, codes, radius, tables))
        gate = gates.setdefault(s, np.zeros(1 << _GATE, bool))
        gate[shingles >> np.uint64(64 - _GATE)] = True
    return Items(ids, counts, lengths, gates, similarity)


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number, and position within the row, for rows of n entries."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def find(texts: list[bytes], items: Items) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity) of the best window of each contaminated text and item."""
    out = []
    for a, b in kernels.blocks(texts):
        out += [(a + t, *rest) for t, *rest in _find_in_block(kernels.Block(texts[a:b], word_table=kernels.WORDLIKE), items)]
    return out


def _windows(places: np.ndarray, length: Length, block: kernels.Block, owner: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Start and words of the windows that can have the similarity with an item of a length; ``places``: of its shingles."""
    starts, widths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    share = similarity / (1 + similarity)
    # windows of the items' length
    need = math.ceil(2 * length.n * share - 1e-9)
    if len(places) >= need:
        first, last = places[: len(places) - need + 1], places[need - 1 :]
        text = owner[first]
        close = (last - first < length.n) & (text == owner[last])
        first, last, text = first[close], last[close], text[close]
        low = np.maximum(last - length.n + 1, block.first[text])
        high = np.minimum(first, block.first[text + 1] - length.words)
        row, k = _expand(np.maximum(high - low + 1, 0))
        starts.append(np.unique(low[row] + k))
        widths.append(np.full(len(starts[-1]), length.words))
    # whole texts that are shorter
    text, hits = np.unique(owner[places], return_counts=True)
    n = block.n_words[text] - length.size + 1
    short = (block.n_words[text] < length.words) & (hits >= share * (n + length.n) - 1e-9)
    starts.append(block.first[text[short]])
    widths.append(block.n_words[text[short]])
    return np.concatenate(starts), np.concatenate(widths)


def _find_in_block(block: kernels.Block, items: Items) -> list[tuple[int, int, int, int, float]]:
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    hashed, owner = block.word_hash(), block.text_of_word()
    for size, gate in items.gates.items():
        grams = kernels.shingles(hashed, size)
        if not len(grams):
            continue
        at = np.flatnonzero(gate[grams >> np.uint64(64 - _GATE)])
        at = at[owner[at] == owner[at + size - 1]]
        seen = grams[at]
        for length in items.lengths:
            if length.size != size or not len(at):
                continue
            k = np.minimum(np.searchsorted(length.shingles, seen), len(length.shingles) - 1)
            start, width = _windows(at[length.shingles[k] == seen], length, block, owner, items.similarity)
            if len(start):
                for i, s, w, like in _similar(grams, start, width, length, items):
                    text = int(owner[s])
                    if (like, -s) > best.get((text, i), (0.0, 0, 0))[:2]:
                        best[text, i] = (like, -s, w)
    return [(t, i, -s - int(block.first[t]), w, like) for (t, i), (like, s, w) in sorted(best.items())]


def _similar(grams: np.ndarray, start: np.ndarray, width: np.ndarray, length: Length, items: Items) -> Iterator[tuple[int, int, int, float]]:
    """(item, start, words, similarity) of the windows that an item within the radius resembles."""
    n = width - length.size + 1
    needed = np.zeros(len(grams) + 1, np.int64)
    np.add.at(needed, start, 1)
    np.add.at(needed, start + n, -1)
    inside = np.cumsum(needed)[:-1] > 0
    compact = np.cumsum(inside) - 1
    sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(_bits(grams[inside]), axis=0, dtype=np.int64)))
    codes = _fingerprint(sums[compact[start] + n] - sums[compact[start]], n)
    window, place = length.lookup(codes)
    counted: dict[int, Counter] = {}
    for k, p in zip(window.tolist(), place.tolist()):
        s, w, i = int(start[k]), int(width[k]), int(length.items[p])
        if k not in counted:
            counted = {k: Counter(grams[s : s + int(n[k])].tolist())}  # pairs come window by window
        own, other = counted[k], items.shingle_counts[i]
        both = sum((own & other).values())
        like = both / (own.total() + other.total() - both)
        if like >= items.similarity:
            yield i, s, w, like


def item_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = ITEM_BLOCK_BYTES, **how) -> Iterator[Items]:
    """Indexes over all items, each over about ``block_bytes`` of texts, so that a pass has a bounded size."""
    items = benchmark.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(((r.id, r.text) for r in own.collect()), key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0], r[1]))
        texts = _lowered(pa.array([t for _, t in rows], pa.string()))
        yield index_items([i for i, _ in rows], texts, **how)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window for each leaked item in a document."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for items in item_blocks(benchmark, id_col=item_col, text_col=item_text_col, **how):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        item_type = benchmark.schema[item_col].dataType

        def run(batches: Iterator[pa.RecordBatch], sent=sent, item_type=item_type) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            items = sent.value
            for batch in batches:
                got = find(_lowered(batch.column(1)), items)
                ids = batch.column(0).take(pa.array([t for t, *_ in got], pa.int64()))
                columns = [ids, pa.array([items.ids[i] for _, i, *_ in got], to_arrow_type(item_type))]
                columns += [pa.array([g[k] for g in got], kind) for k, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = docs.select(id_col, text_col).mapInArrow(kernels.freed(run), f"doc_id {kind}, item_id {item_kind}, start_word long, n_words long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with no benchmark passage, all columns unchanged."""
    at = docs.columns.index(text_col)
    for items in item_blocks(benchmark, **how):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in find(_lowered(batch.column(at)), sent.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(kernels.freed(run), docs.schema)
    return docs


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity for every benchmark passage in documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
