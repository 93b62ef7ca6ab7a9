"""The Kneser-Ney model against dictionaries."""

import inspect
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_model as L

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(train, order):
    """Probability function of an interpolated modified Kneser-Ney model."""
    counts = {order: Counter()}
    for text in train:
        line = ["<s>"] * (order - 1) + tokens(text)
        counts[order].update(tuple(line[i - order + 1 : i + 1]) for i in range(order - 1, len(line)))
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    words = {g[0] for g in counts[1]}
    discounts, contexts = {}, {}
    for size, grams in counts.items():
        of = Counter(grams.values())
        discounts[size] = L._discounts(np.array([of[k] for k in (1, 2, 3, 4)]))
        contexts[size] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in grams.items():
            contexts[size][g[:-1]][0] += c
            contexts[size][g[:-1]][min(c, 3)] += 1

    def p(gram):
        if not gram:
            return 1 / (len(words) + 1)
        size, d = len(gram), (0, *discounts[len(gram)])
        total, *ns = contexts[size].get(gram[:-1], [0, 0, 0, 0])
        if not total:
            return p(gram[1:])
        c = counts[size][gram]
        return max(c - d[min(c, 3)], 0) / total + sum(n * x for n, x in zip(ns, d[1:])) / total * p(gram[1:])

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_matches_dictionaries(spark, order):
    rng = np.random.default_rng(order)
    words = ["the", "Of", "and", *(f"w{k}" for k in range(30)), "é"]
    weights = 1 / np.arange(1, len(words) + 1)
    data = [(k, " ".join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))) for k in range(120)]
    data += [(500, None), (501, ""), (502, " \t\n"), (None, "the of"), (3, "the the the"), (3, "the the the"), (504, "never seen w1"), (505, "long and " * 20000)]
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"), F.lit(False))
    docs = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA).repartition(5)
    got = L.score(docs, L.train(docs.where(~held), order=order), held).collect()
    is_held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in data]
    train = [t for (_, t), h in zip(data, is_held) if not h]
    p = brute(train, order)
    seen = Counter(w for t in train for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = []
    for (d, t), h in zip(data, is_held):
        line = ["<s>"] * (order - 1) + tokens(t)
        own = sum(math.log10(p(tuple(line[i - order + 1 : i + 1]))) for i in range(order - 1, len(line)))
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.append((str(d), h, len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, base, own))
    rows = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(rows), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    total = sum(p((*ctx, w)) for ctx in [("the",) * (order - 1)] for w in [*seen, "<unknown>"])
    assert total == pytest.approx(1.0)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert L.score(docs, L.train(docs), F.lit(False)).count() == 0
    some = spark.createDataFrame([(1, "a b", None)], SCHEMA)
    assert L.score(some, L.train(docs), F.lit(False)).first().score == 0.0


def test_frequent_contexts_stay_out_of_the_driver(spark, monkeypatch):
    """They grow with the square of the number of buckets; many files of them give the same scores."""
    monkeypatch.setattr(L, "BUCKET_TOKENS", 1 << 10)
    if hasattr(L, "CONTEXT_BYTES"):
        monkeypatch.setattr(L, "CONTEXT_BYTES", 1 << 14)
    rng = np.random.default_rng(0)
    data = [(k, " ".join(f"w{j}" for j in rng.integers(0, 40, 600)), None) for k in range(100)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    got_by_driver, collect = [], type(docs).collect

    def counted(df):
        rows = collect(df)
        got_by_driver.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", counted)
        model = L.train(docs)
    assert model.buckets == 64
    assert sum(got_by_driver) < 20_000
    assert len(pickle.dumps(model)) < 4_000
    p = brute([t for _, t, _ in data], 3)
    some = [r for r in L.score(docs, model, F.lit(False)).collect() if r.doc_id < 5]
    for r in some:
        line = ["<s>", "<s>", *tokens(data[r.doc_id][1])]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(line[i - 2 : i + 1]))) for i in range(2, len(line))), rel=1e-9)


def test_query_learns_trigrams():
    assert inspect.signature(L.train).parameters["order"].default == 3


@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 50_000])
def test_tables(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for width in (1, 4):
        values = rng.zipf(1.3, (len(keys), width)).clip(1, 1 << 40).astype(np.int64)
        table = L.Table(np.frombuffer(L.table_bytes(keys, values), np.uint8))
        asked = rng.permutation(np.concatenate((keys, keys ^ np.uint64(1 << 40), rng.integers(0, 1 << 63, 500, dtype=np.uint64))))
        want = {int(k): tuple(v) for k, v in zip(keys, values.tolist())}
        assert [tuple(r) for r in table.look(asked).tolist()] == [want.get(int(k), (0,) * width) for k in asked]
