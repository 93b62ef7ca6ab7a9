"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints of word-shingle SimHash are linked when they differ in at most ``radius`` bits. Distinct
fingerprints are dealt out by masked bit patterns so that each linked pair meets under at least one of
them (``radius`` + 1 masks cover the free bits, so one of them has no difference). A pattern with too
many fingerprints is divided again by masks over its remaining bits, as often as needed: this is exact,
no group is cut. Below, a group is sorted by Gray rank and indexed by a tree whose nodes hold the bits
that all fingerprints under them share; two nodes whose shared bits already differ in more than
``radius`` places are pruned with everything below them. A child adds only the differences of the bits
that it shares beyond its parent.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and is linked like any
other; repeated rows stay repeated rows; rows whose id is null are fingerprinted, and never name a
component unless all of it is null. Input columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm import graph, kernels, shared, shingle_join

RADIUS = 3
#: Largest group that one task indexes; larger ones are divided by further bits.
GROUP_ROWS = 2000
_FAN = 8
_FRONTIER = 8_000
_ALL = (1 << 64) - 1
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8, dtype=np.int64) * 256)[None, :]


def simhash(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles: a bit is 1 if set in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends)]), np.uint8)
    counts = np.bincount((hashes.reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x, size) for x in kernels.texts_of(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(kernels.freed(run), f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the Gray order."""
    x = codes.astype(np.uint64, copy=True)
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Trees over fingerprints sorted by (group, Gray rank); one tree for each group."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.order, self.codes, group = order, codes[order], group[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # value, shared bits, first child
        low = high = self.codes
        at = group
        self.levels.append((self.codes, np.full(len(codes), _ALL, np.uint64), np.zeros(0, np.int64)))
        while True:
            new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            inside = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            first = np.flatnonzero(inside % _FAN == 0)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            at = at[first]
            self.levels.append((low, ~(low ^ high), np.append(first, len(inside))))
            if len(first) == len(new):
                return

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions i < j of the same group whose codes differ in at most ``radius`` bits, in portions."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        parts = [roots[k : k + _FRONTIER] for k in range(0, len(roots), _FRONTIER)]
        stack = [(top, r, r, np.zeros(len(r), np.int64)) for r in parts]
        while stack:
            level, a, b, apart = stack.pop()
            value, common, first = self.levels[level]
            below, below_common, _ = self.levels[level - 1]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            parent = np.repeat(np.arange(len(a)), na * nb)
            k = np.arange(len(parent)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = first[a][parent] + k // nb[parent], first[b][parent] + k % nb[parent]
            keep = (i < j) if level == 1 else (i <= j)
            i, j, parent = i[keep], j[keep], parent[keep]
            own = below_common[i] & below_common[j] & ~(common[a] & common[b])[parent]
            apart = apart[parent] + np.bitwise_count((below[i] ^ below[j]) & own)
            near = apart <= radius
            i, j, apart = i[near], j[near], apart[near]
            if level == 1:
                if len(i):
                    yield i, j
            else:
                stack += [(level - 1, i[s : s + _FRONTIER], j[s : s + _FRONTIER], apart[s : s + _FRONTIER]) for s in range(0, len(i), _FRONTIER)]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j; a class is labelled by its least member."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _star_edges(group: np.ndarray, node: np.ndarray, codes: np.ndarray, checks: list[np.ndarray], radius: int, check_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, representative) that connect what is linked within the groups."""
    index = GrayIndex(group, codes)
    node, checks = node[index.order], [c[index.order] for c in checks]
    label = np.arange(len(codes))
    for i, j in index.pairs(radius):
        if checks:
            same = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int64) for c in checks) <= check_bits
            i, j = i[same], j[same]
        _merge(label, i, j)
    far = np.flatnonzero(label != np.arange(len(codes)))
    return node[far], node[label[far]]


def _index_tasks(rows: DataFrame, radius: int, checks: list[str], check_bits: int) -> DataFrame:
    """Edges (a, b) between nodes of the same key; every key has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(held[0]) > 1:
                key, node, *codes = held
                codes = [c.view(np.uint64) for c in codes]
                a, b = _star_edges(key, node, codes[0], codes[1:], radius, check_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = [np.zeros(0, np.int64) for _ in range(3 + len(checks))]
        for batch in batches:
            held = [np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
            if not len(held[0]):
                continue
            done = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            yield from edges([h[:done] for h in held])
            held = [h[done:] for h in held]
        yield from edges(held)

    return rows.select("key", "node", "fp", *checks).repartition("key").sortWithinPartitions("key").mapInArrow(kernels.freed(run), "a long, b long")


def _masks(fixed: int, parts: int) -> list[int]:
    """The bits that are not fixed, in ``parts`` masks."""
    free = [1 << k for k in range(63, -1, -1) if not fixed >> k & 1]
    return [sum(free[len(free) * p // parts : len(free) * (p + 1) // parts]) for p in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, *, radius: int = RADIUS, equal: int = 1, checks: tuple[str, ...] = (), check_bits: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) whose connected components are those of all linked pairs of nodes.

    ``nodes``: node (a number), fp, and further fingerprints ``checks``; a link also needs those to differ
    in at most ``check_bits`` bits together. Nodes meet under each choice of ``equal`` out of
    ``radius`` + ``equal`` blocks of bits. Not every pair becomes an edge, every connection does.
    """
    spark = nodes.sparkSession
    columns = ["node", "fp", *checks]
    rows = nodes.select(*columns, F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("fixed"))
    found, tables, paths = None, [], [0]  # paths: the sets of fixed bits that occur
    while paths:
        choices = [sum(c) for c in combinations(_masks(0, radius + equal), equal)] if paths == [0] else None
        wider = [(_signed(p), _signed(p | m)) for p in paths for m in choices or _masks(p, radius + 1)]
        masks = F.broadcast(spark.createDataFrame(wider, "fixed long, bits long"))  # a few rows a path
        pattern = F.xxhash64("bits", F.col("fp").bitwiseAND(F.col("bits")), "key")
        level = rows.join(masks, "fixed").select(*columns, F.col("bits").alias("fixed"), pattern.alias("key"))
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("fixed").alias("fixed"))
        large = shared.written(counts.where((F.col("n") > group_rows) & (F.bit_count("fixed") < 64)), "large")
        tables.append(large)
        paths = [r.fixed & _ALL for r in large.select("fixed").distinct().collect()]
        edges = shared.written(_index_tasks(level.join(large.select("key"), "key", "left_anti") if paths else level, radius, list(checks), check_bits).distinct(), "links")
        found = edges if found is None else found.unionByName(edges)
        if paths:
            rows = shared.written(level.join(large.select("key"), "key", "left_semi"), "patterns")
            tables.append(rows)
    for t in tables:
        shared.drop(t)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least id reachable by links."""
    found = shared.written(fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    nodes = shared.written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select(F.col("fp").alias("node"), "fp"), radius=radius, group_rows=group_rows)
    roots = shared.written(graph.components(edges), "roots")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = shared.written(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "components")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def _set_links(nodes: DataFrame, radius: int, group_rows: int) -> DataFrame:
    """Pairs (a, b) of fp: those that the Gray index connects by the column sim, and equal sims."""
    same = nodes.groupBy("sim").agg(F.min("fp").alias("first"))
    linked = links(same.select(F.col("sim").alias("node"), F.col("sim").alias("fp")), radius=radius, group_rows=group_rows)
    a, b = (same.select(F.col("sim").alias(x), F.col("first").alias(f"{x}_fp")) for x in "ab")
    far = linked.join(a, "a").join(b, "b").select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))
    equal = nodes.join(same, "sim").where("fp <> first").select(F.least("fp", "first").alias("a"), F.greatest("fp", "first").alias("b"))
    return far.unionByName(equal)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``docs`` of which one per group of near-duplicates stays: that with the least id.

    Documents are near-duplicates if 0.8 or more of their distinct five-word shingles are the same (of all
    that either has). The Gray index over the SimHashes of the shingle sets gives the first candidates, an exact
    join what lies beyond its radius, see :mod:`tidemark.llm.shingle_join`; every link is verified by the whole
    sets. Words are letters, digits and non-ASCII characters in lower case. Of several rows with an id that
    stays, each distinct text stays once; an id goes if any of its rows is a near-duplicate of a row with a
    smaller id. Rows without an id are kept. Ids are numbers; any other type is refused.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"ids must be whole numbers, not {kind.simpleString()}")
    known = docs.where(F.col(id_col).isNotNull())
    found = shared.written(shingle_join.fingerprints(known, id_col=id_col, text_col=text_col), "fingerprints")
    codes = ["fp", "fp2"]
    others = [c for c in found.columns if c not in ("node", *codes)]
    least = found.groupBy(*codes).agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in others))
    nodes = shared.written(least, "nodes")
    whole, found = found, shared.written(found.select("node", *codes), "codes")
    shared.drop(whole)
    near = _set_links(nodes.select("fp", "sim"), radius, group_rows)
    linked = shingle_join.links(known, nodes.drop("prefix", "sim"), nodes.select("fp", "n", "prefix"), near, id_col=id_col, text_col=text_col, group_rows=group_rows)
    a, b = (nodes.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node")) for x in "ab")
    edges = linked.join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    gone_name, id_name = (_free_name(docs, x) for x in ("_gone", "_least"))
    far = graph.components(edges).where("node <> root").select(F.col("node").alias(gone_name))
    # what has the set of a smaller id goes as well; ids that remain with several rows are few
    twins = found.join(nodes.select(*codes, F.col("node").alias(id_name)), codes).where(F.col("node") != F.col(id_name)).select(F.col("node").alias(gone_name))
    gone = shared.written(far.unionByName(twins).distinct(), "gone")
    twice = shared.written(found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias(gone_name)), "twice")
    left = known.join(gone, F.col(id_col) == F.col(gone_name), "left_anti")
    one = left.join(twice, F.col(id_col) == F.col(gone_name), "left_anti")
    several = left.join(twice, F.col(id_col) == F.col(gone_name), "left_semi").dropDuplicates([id_col, text_col])
    return one.unionByName(several).unionByName(docs.where(F.col(id_col).isNull()))


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer if a column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row of documents."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
