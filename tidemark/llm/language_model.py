"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by workers.

Words are numbered by their place among the sorted word hashes of the training texts. Tasks count the
n-grams of a portion of text with numpy and send them on as compressed columns, one blob for each bucket
of contexts; a task for each bucket adds them up and writes sorted arrays of n-gram hashes with counts,
and of context hashes with totals, to the shared folder. There are as many buckets as keep each at about
``BUCKET_TOKENS`` tokens of text. Contexts with a large share of the corpus are spread over all buckets by the
whole n-gram; their totals are added up by tasks and mapped like the rest, so the driver gets a few numbers a bucket.
The next lower order counts in how many distinct longer n-grams each shorter one occurs.
Scoring maps the arrays into memory and looks up each distinct n-gram of a portion of text once.

An array holds of each hash the 32 bits below those that number its segment of about eight hashes, and of its
values (most are the same few) a byte. Two n-grams of a bucket share an entry with a probability of some 1e-9.

Unknown words share one class: the lowest order is interpolated with 1 / (V + 1).

Defined cases: null texts count as empty and have the end token alone; rows without an id are trained on
and not held out; repeated rows count as often as they occur; without training text every probability is
that of the uniform distribution. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels, shared

ORDER = 3
#: n-grams that a task holds before it sends them on.
PORTION = 1_500_000
#: Tokens of the corpus for each bucket.
BUCKET_TOKENS = 1 << 20
#: Packed totals of frequent contexts, in bytes, that a task adds up.
CONTEXT_BYTES = 8 << 20
#: Bytes of text that are scored together.
SCORE_BYTES = 4 << 20
_END_HASH = np.uint64(0x0123456789ABCDEF)
_CHAIN = np.uint64(0xA24BAED4963EE407)
_HEAD = struct.Struct("<II")
_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_maps: dict[str, np.ndarray] = {}
_tables: dict[str, Table] = {}


def _pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Columns of ids (rows x k, sorted by rows) and counts, byte planes of each compressed together."""
    planes = [np.diff(c.astype(np.int64), prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in ids.T]
    if counts.max(initial=0) > 0xFFFFFFFF:
        raise ValueError("a task has counted an n-gram over 2 ** 32 times")
    planes.append(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return _HEAD.pack(*ids.shape) + _zip.compress(b"".join(planes))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = _HEAD.unpack_from(blob)
    raw = np.frombuffer(_unzip.decompress(blob[_HEAD.size :]), np.uint8).reshape(k + 1, 4, n)
    values = [np.ascontiguousarray(p.T).view("<i4").ravel() for p in raw]
    ids = np.stack([np.cumsum(v, dtype=np.int64).astype(np.uint32) for v in values[:k]], axis=1)
    return ids, values[k].view("<u4").astype(np.int64)


def _pack_contexts(keys: np.ndarray, numbers: np.ndarray) -> bytes:
    """Hashes and rows of four numbers, byte planes of each compressed together."""
    rows = np.concatenate((keys.astype("<u8").view("<i8")[:, None], numbers), axis=1).astype("<i8")
    return _zip.compress(np.ascontiguousarray(rows).view(np.uint8).T.tobytes())


def _unpack_contexts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.ascontiguousarray(np.frombuffer(_unzip.decompress(blob), np.uint8).reshape(40, -1).T).view("<i8")
    return np.ascontiguousarray(rows[:, 0]).view("<u8"), rows[:, 1:]


def gram_keys(ids: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of ids; a row without columns has hash 0."""
    key = np.zeros(len(ids), np.uint64)
    for c in ids.T:
        key = kernels.mix(key * _CHAIN + c.astype(np.uint64) + np.uint64(1))
    return key


def _summed(ids: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, sorted, with their added counts and a place of each; ids are at most ``words`` + 1."""
    if not len(ids):
        return ids, counts, np.zeros(0, np.int64)
    bits = (words + 1).bit_length()
    if bits * ids.shape[1] <= 64:  # a row in one number
        packed = ids[:, 0].astype(np.uint64)
        for c in ids.T[1:]:
            packed = packed << np.uint64(bits) | c
        order = np.argsort(packed)
        new = np.flatnonzero(np.concatenate(([True], np.diff(packed[order]) != 0)))
    else:
        order = np.lexsort(ids.T[::-1])
        new = np.flatnonzero(np.concatenate(([True], (np.diff(ids[order].astype(np.int64), axis=0) != 0).any(axis=1))))
    return ids[order[new]], np.add.reduceat(counts[order], new), order[new]


_TABLE = struct.Struct("<IIIII")


def table_bytes(keys: np.ndarray, values: np.ndarray) -> bytes:
    """A file of sorted distinct 64-bit keys with rows of values; see :class:`Table`."""
    bits = min(26, (len(keys) // 8).bit_length())
    rest = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
    index = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])
    width = values.shape[1]
    if width == 1:  # small numbers are their own codes
        common = np.arange(255)[:, None]
        codes = np.minimum(values[:, 0], 255).astype(np.uint8)
    else:
        small = (values < 1 << 64 // width).all(axis=1)
        packed = np.zeros(len(values), np.uint64)
        for c in values.T:
            packed = packed << np.uint64(64 // width) | (c * small).astype(np.uint64)
        kinds, first, place, times = np.unique(packed[small], return_index=True, return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")[:255]
        common = values[np.flatnonzero(small)[first[often]]]
        code_of = np.full(len(kinds), 255, np.uint8)
        code_of[often] = np.arange(len(often))
        codes = np.full(len(values), 255, np.uint8)
        codes[small] = code_of[place]
    many = np.flatnonzero(codes == 255)
    head = _TABLE.pack(bits, len(keys), width, len(common), len(many))
    return head + b"".join(x.tobytes() for x in (index.astype("<u4"), rest, many.astype("<u4"), common.astype("<u8"), values[many].astype("<u8"), codes))


class Table:
    """Sorted hashes with values, over the bytes of a file.

    The first ``bits`` bits of a hash number a segment; ``index`` has the segments' limits, ``rest`` the next 32
    bits of each hash, in order. A code below 255 is the place of the values among the common ones; those of
    the others are listed by place."""

    def __init__(self, data: np.ndarray):
        self.bits, self.n, self.width, common, many = _TABLE.unpack_from(data[: _TABLE.size].tobytes()) if len(data) else (0, 0, 1, 0, 0)
        at = _TABLE.size

        def part(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            n = n if len(data) else 0
            size = n * np.dtype(dtype).itemsize
            out = np.frombuffer(data, dtype, n, at) if n else np.zeros(0, dtype)
            at += size
            return out

        self.index, self.rest, self.many = part("<u4", (1 << self.bits) + 1), part("<u4", self.n), part("<u4", many)
        self.common, self.values = (part("<u8", k * self.width).reshape(-1, self.width) for k in (common, many))
        self.codes = part("u1", self.n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not self.n:
            return np.full(len(keys), -1)
        segment = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        rest = ((keys << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)
        low, high = self.index[segment].astype(np.int64), self.index[segment + 1].astype(np.int64)
        end = high.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (low < high) & (self.rest[np.minimum(middle, self.n - 1)] < rest)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        hit = (low < end) & (self.rest[np.minimum(low, self.n - 1)] == rest)
        return np.where(hit, low, -1)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The values of each key; zeros for a key that is not there."""
        out = np.zeros((len(keys), self.width), np.int64)
        place = self.find(keys)
        got = np.flatnonzero(place >= 0)
        codes = self.codes[place[got]]
        few = codes < 255
        out[got[few]] = self.common[codes[few]]
        rare = got[~few]
        out[rare] = self.values[np.searchsorted(self.many, place[rare].astype(np.uint32))]
        return out


@dataclass
class Model:
    """Where the arrays are, and the few numbers that every lookup needs."""

    path: str
    order: int
    word_buckets: int
    buckets: int
    offsets: np.ndarray  # number of the first word of each bucket of words; the number of words last
    tokens: int
    hot_count: int
    discounts: list[tuple[float, float, float]] = field(default_factory=list)  # by order
    hot_groups: list[int] = field(default_factory=list)  # by order: the files that hold the numbers of frequent contexts

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    def array(self, name: str, dtype: str) -> np.ndarray:
        uri = f"{self.path}/{name}"
        if uri not in _maps:
            if len(_maps) > 20_000:
                _maps.clear()
            _maps[uri] = shared.map_file(uri, dtype)
        return _maps[uri]

    def table(self, name: str) -> Table:
        """The table of a file; empty if there is no such file."""
        uri = f"{self.path}/{name}"
        if uri not in _tables:
            if len(_tables) > 10_000:
                _tables.clear()
            _tables[uri] = Table(shared.map_file(uri, np.uint8))
        return _tables[uri]

    def lookup_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted word hashes; words that are not known have number words + 1."""
        ids, counts = np.full(len(hashes), self.words + 1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(hashes, np.arange(self.word_buckets, dtype=np.uint64) << np.uint64(64 - self.word_buckets.bit_length() + 1)) if self.word_buckets > 1 else np.array([0])
        for b, (low, high) in enumerate(zip(cut, np.append(cut[1:], len(hashes)))):
            if low < high:
                known = self.array(f"words/{b}.hash", "<u8")
                at = np.searchsorted(known, hashes[low:high])
                hit = np.flatnonzero(at < len(known))
                hit = hit[known[at[hit]] == hashes[low:high][hit]]
                ids[low + hit] = self.offsets[b] + at[hit]
                counts[low + hit] = self.array(f"words/{b}.count", "<u8")[at[hit]]
        return ids, counts

    def numbered(self, block: kernels.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and training counts of all tokens, an end after each text, and the index after each end."""
        hashed = block.word_hash()
        kinds, place = np.unique(hashed, return_inverse=True)
        known, times = (np.append(x, y) for x, y in zip(self.lookup_words(kinds), self.lookup_words(np.array([_END_HASH]))))
        stop = block.first[1:] + np.arange(1, len(block.first))
        ids, counts = np.empty(len(hashed) + len(stop), np.int64), np.empty(len(hashed) + len(stop), np.int64)
        inner = np.ones(len(ids), bool)
        inner[stop - 1] = False
        ids[inner], counts[inner] = known[place], times[place]
        ids[stop - 1], counts[stop - 1] = known[-1], times[-1]
        return ids, counts, stop

    def grams(self, ids: np.ndarray, counts: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of ``order`` ids ending at each token (the start of a text is number words), and the least count in its context."""
        start = np.concatenate(([0], stop[:-1]))
        inside = np.arange(len(ids)) - np.repeat(start, stop - start)
        columns, least = [ids], np.full(len(ids), np.iinfo(np.int64).max)
        for back in range(1, self.order):
            shift = np.full(len(ids), self.words)
            own = np.full(len(ids), len(stop))
            real = inside >= back
            shift[real] = ids[np.flatnonzero(real) - back]
            own[real] = counts[np.flatnonzero(real) - back]
            own[~real] = np.iinfo(np.int64).max  # as frequent as there are texts
            columns.insert(0, shift)
            least = np.minimum(least, own)
        return np.stack(columns, axis=1).astype(np.uint32), least

    def bucket_of(self, ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
        key = np.where(hot, gram_keys(ids), gram_keys(ids[:, :-1]))
        return self.bucket_of_keys(key)

    def bucket_of_keys(self, keys: np.ndarray) -> np.ndarray:
        """In 16 bits if they do, which numpy sorts by radix."""
        return (keys & np.uint64(self.buckets - 1)).astype(np.uint16 if self.buckets <= 1 << 16 else np.uint32)


def _rows(parts: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, data = zip(*parts) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(buckets, pa.int64()), pa.array(data, pa.binary())], names=["kind", "bucket", "data"])


_SCHEMA = "kind string, bucket long, data binary"


def _numbers(values: list) -> bytes:
    return np.array(values, "<i8").tobytes()


def _count_words(docs: DataFrame, buckets: int, path: str) -> DataFrame:
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            kinds, place = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts), len(kinds)).astype(np.int64)
            bucket = (kinds >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(kinds), np.int64)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            return _rows([("words", int(bucket[a]), np.stack((kinds[a:b].astype("<u8"), n[a:b].astype("<u8"))).tobytes()) for a, b in zip(cut[:-1], cut[1:])])

        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            for a, b in kernels.blocks(texts):
                kinds, n = np.unique(kernels.Block(texts[a:b]).word_hash(), return_counts=True)
                hashes += [kinds, np.array([_END_HASH])]
                counts += [n, np.array([b - a])]
                held += len(kinds)
                if held > PORTION:
                    yield flush()
                    hashes, counts, held = [], [], 0
        if hashes:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8").reshape(2, -1) for x in table.column("data").to_pylist()]
        kinds, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.zeros(len(kinds), np.uint64)
        np.add.at(n, place, np.concatenate([p[1] for p in parts]))
        b = table.column("bucket")[0].as_py()
        shared.put_file(f"{path}/words/{b}.hash", kinds.astype("<u8").tobytes())
        shared.put_file(f"{path}/words/{b}.count", n.astype("<u8").tobytes())
        return pa.Table.from_batches([_rows([("sizes", b, _numbers([len(kinds), int(n.sum())]))])])

    return docs.mapInArrow(kernels.freed(count), _SCHEMA).groupBy("bucket").applyInArrow(add, _SCHEMA)


def _send(model: Model, ids: np.ndarray, counts: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    bucket = model.bucket_of(ids, hot)
    order = np.argsort(bucket, kind="stable")
    ids, counts, hot, bucket = ids[order], counts[order], hot[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    parts = []
    for a, b in zip(cut[:-1], cut[1:]):
        for kind, own in (("grams", ~hot[a:b]), ("hot", hot[a:b])):
            if own.any():
                parts.append((kind, int(bucket[a]), _pack(ids[a:b][own], counts[a:b][own])))
    return _rows(parts)


def _count_grams(docs: DataFrame, model: Model) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, leasts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            every, least = np.concatenate(rows), np.concatenate(leasts)
            ids, counts, first = _summed(every, np.ones(len(every), np.int64), model.words)
            return _send(model, ids, counts, least[first] > model.hot_count)

        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            for a, b in kernels.blocks(texts):
                ids, least = model.grams(*model.numbered(kernels.Block(texts[a:b])))
                rows.append(ids)
                leasts.append(least)
                held += len(ids)
                if held > PORTION:
                    yield flush()
                    rows, leasts, held = [], [], 0
        if rows:
            yield flush()

    return docs.mapInArrow(kernels.freed(count), _SCHEMA)


def _context_numbers(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct context hashes, sorted, with the total, and the n-grams of count 1, 2 and more."""
    kinds, place = np.unique(keys, return_inverse=True)
    columns = [np.bincount(place, w, len(kinds)) for w in (counts, counts == 1, counts == 2, counts > 2)]
    return kinds, np.stack(columns, axis=1).astype(np.int64)


def _add_grams(rows: DataFrame, model: Model, size: int) -> DataFrame:
    """Arrays of the n-grams of ``size`` words; returns their numbers, and the n-grams one word shorter."""

    def add(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        parts, every_ids, every_counts = [], [], []
        for kind in ("grams", "hot"):
            blobs = [_unpack(d) for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()) if k == kind]
            if not blobs:
                continue
            ids, counts, _ = _summed(np.concatenate([x for x, _ in blobs]), np.concatenate([n for _, n in blobs]), model.words)
            every_ids.append(ids)
            every_counts.append(counts)
            keys, numbers = _context_numbers(gram_keys(ids[:, :-1]), counts)
            if kind == "hot":
                parts.append(("contexts", b, _pack_contexts(keys, numbers)))
            else:
                shared.put_file(f"{model.path}/contexts{size}/{b}", table_bytes(keys, numbers))
        ids, counts = np.concatenate(every_ids), np.concatenate(every_counts)
        keys = gram_keys(ids)
        order = np.argsort(keys)
        keys, times = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        shared.put_file(f"{model.path}/grams{size}/{b}", table_bytes(keys[new], np.add.reduceat(times, new)[:, None]))
        parts.append(("of", b, _numbers([int((counts == k).sum()) for k in (1, 2, 3, 4)])))
        if size > 1:
            shorter, times, _ = _summed(ids[:, 1:], np.ones(len(ids), np.int64), model.words)
            hot = np.zeros(len(shorter), bool) if size > 2 else np.ones(len(shorter), bool)  # of single words the context is empty
            sent = _send(model, shorter, times, hot)
            return pa.Table.from_batches([_rows(parts), sent])
        return pa.Table.from_batches([_rows(parts)])

    return rows.groupBy("bucket").applyInArrow(add, _SCHEMA)


def _add_contexts(rows: DataFrame, model: Model, size: int, groups: int) -> DataFrame:
    """Arrays of the frequent contexts of n-grams of ``size`` words, whose totals the buckets have in part."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[new], np.add.reduceat(numbers[order], new)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            keys, numbers = summed(parts)
            group = keys & np.uint64(groups - 1)
            return _rows([("contexts", g, _pack_contexts(keys[own], numbers[own])) for g in range(groups) if len(own := np.flatnonzero(group == np.uint64(g)))])

        for batch in batches:
            for data in batch.column("data"):
                parts.append(_unpack_contexts(data.as_py()))
                held += len(parts[-1][0])
                if held > PORTION // 4:  # a row is four times as wide as an n-gram's
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        keys, numbers = summed([_unpack_contexts(d) for d in table.column("data").to_pylist()])
        g = table.column("bucket")[0].as_py()
        shared.put_file(f"{model.path}/hot{size}/{g}", table_bytes(keys, numbers))
        return pa.Table.from_batches([_rows([("contexts", g, b"")])])

    return rows.mapInArrow(kernels.freed(split), _SCHEMA).groupBy("bucket").applyInArrow(add, _SCHEMA)


def _discounts(of: np.ndarray) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float(x) for x in of)
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.0, k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))  # type: ignore[return-value]


def train(docs: DataFrame, *, text_col: str = "text", order: int = ORDER) -> Model:
    """A model of all texts of ``docs``, in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(text_col)
    words = 1 << max(3, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    path = shared.fresh_path(spark, "language-model")
    sizes = {r.bucket: np.frombuffer(r.data, "<i8") for r in _count_words(texts, words, path).collect()}  # two numbers a bucket
    shared.sweep(spark)
    none = np.zeros(2, np.int64)
    offsets = np.concatenate(([0], np.cumsum([sizes.get(b, none)[0] for b in range(words)])))
    tokens = int(sum(s[1] for s in sizes.values()))
    buckets = 1 << max(3, (tokens // BUCKET_TOKENS).bit_length())
    # a context is at most as frequent as the rarest of its words
    model = Model(path, order, words, buckets, offsets.astype(np.int64), tokens, max(tokens // (4 * buckets), 1000))
    found = {}
    rows = _count_grams(texts, model)
    for size in range(order, 0, -1):
        out = shared.written(_add_grams(rows, model, size), f"grams{size}")
        if size < order:
            shared.drop(rows)
        rows = None
        shared.sweep(spark)  # the shuffle files of this order
        # the driver gets the numbers that discounts follow from, and how large the packed contexts are
        few = out.where("kind in ('of', 'contexts')").select("kind", F.expr("if(kind = 'of', data, null)").alias("data"), F.length("data").alias("size")).collect()
        of = sum((np.frombuffer(r.data, "<i8") for r in few if r.kind == "of"), np.zeros(4, np.int64))
        held = sum(r.size for r in few if r.kind == "contexts")
        groups = 1 << (held // CONTEXT_BYTES).bit_length()
        if held:
            _add_contexts(out.where("kind = 'contexts'"), model, size, groups).count()
        found[size] = (_discounts(of), groups)
        rows = out.where("kind in ('grams', 'hot')")
        rows.__dict__["shared_path"] = out.__dict__["shared_path"]
    shared.drop(rows)
    for size in range(1, order + 1):
        model.discounts.append(found[size][0])
        model.hot_groups.append(found[size][1])
    return model


def probabilities(model: Model, ids: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Probability of the last word of each row of ``order`` ids."""
    p = np.full(len(ids), 1.0 / (model.words + 1))
    for size in range(1, model.order + 1):
        own = ids[:, model.order - size :]
        hot = np.ones(len(own), bool) if size == 1 else least > model.hot_count if size == model.order else np.zeros(len(own), bool)
        context, key = gram_keys(own[:, :-1]), gram_keys(own)
        numbers, count = np.zeros((len(own), 4), np.int64), np.zeros(len(own), np.int64)
        if size == 1:  # one context
            numbers[:] = model.table("hot1/0").look(context[:1])
        elif size == model.order:
            which = np.flatnonzero(hot)
            group = context[which] & np.uint64(model.hot_groups[size - 1] - 1)
            for g in range(model.hot_groups[size - 1]):
                part = which[group == np.uint64(g)]
                numbers[part] = model.table(f"hot{size}/{g}").look(context[part])
        bucket = model.bucket_of_keys(np.where(hot, key, context))
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            part = order[a:b]
            name = int(bucket[part[0]])
            count[part] = model.table(f"grams{size}/{name}").look(key[part])[:, 0]
            rare = part[~hot[part]]
            if len(rare):  # the contexts of a bucket's n-grams are in the bucket as well
                numbers[rare] = model.table(f"contexts{size}/{name}").look(context[rare])
        d = np.array([0.0, *model.discounts[size - 1]])
        total = np.maximum(numbers[:, 0], 1)
        weight = (numbers[:, 1:] @ d[1:]) / total
        p = np.where(numbers[:, 0] > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / total + weight * p, p)
    return p


def score(docs: DataFrame, model: Model, held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        floor = np.log10(model.tokens + 0.5 * (model.words + 1))
        for batch in batches:
            texts = kernels.texts_of(batch.column(2))
            n, known, base, own = (np.zeros(len(texts)) for _ in range(4))
            for a, b in kernels.blocks(texts, SCORE_BYTES):
                ids, counts, stop = model.numbered(kernels.Block(texts[a:b]))
                rows, least = model.grams(ids, counts, stop)
                _, first, place = np.unique(gram_keys(rows), return_index=True, return_inverse=True)
                logs = np.log10(probabilities(model, rows[first], least[first]))[place]
                cut = np.concatenate(([0], stop[:-1]))
                n[a:b], known[a:b] = stop - cut, np.add.reduceat(counts > 0, cut, dtype=np.int64)
                base[a:b] = np.add.reduceat(np.log10(counts + 0.5) - floor, cut)
                own[a:b] = np.add.reduceat(logs, cut)
            columns = [batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in (n, known, np.full(len(texts), model.tokens))), *map(pa.array, (base, own, 10 ** (-own / np.maximum(n, 1))))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernels.freed(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every text by a model of the four fifths of documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"), F.lit(False))
    return score(docs, train(docs.where(~held_out)), held_out)
