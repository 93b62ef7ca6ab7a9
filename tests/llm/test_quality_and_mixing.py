"""Quality classifier on held-out labels; mixing rates against numpy."""

import zlib

import numpy as np
import pytest

from tidemark.llm import mixing as M
from tidemark.llm import quality as Q

SCHEMA = "doc_id long, text string, score string, rate string"
SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op8_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(held) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "clash", None), (1, "", None, None), (None, "a b", None, None), (2, "long text " * 50000, None, None), (2, "long text " * 50000, None, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (7, 0), (2, 5)], "doc_id long, quality int")
    trees = Q.fit(docs, labels)
    got = Q.score(docs, trees)
    assert got.count() == 5 and all(0 <= r.score <= 1 for r in got.collect())
    assert Q.keep_good(docs, trees).columns == docs.columns
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), labels)).count() == 0


def test_trees_walk_like_their_definition():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = Q.fit_trees(x, y, trees=30)

    def walk(row):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            k = 0
            while feature[k] >= 0:
                k = 2 * k + 1 + (row[feature[k]] > threshold[k])
            total += value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x], trees.predict(x))
    assert ((trees.predict(x) >= 0.5) == y).mean() > 0.95


def test_rates_match_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(0, 500, 300).astype(float)
    members = spark.createDataFrame([(float(t), [float(v) for v in q]) for t, q in zip(tokens, p)], "_tokens double, _p array<double>").repartition(4)
    weights = [0.7, 0.3, 0.0]
    steps = M.fit_rates(members, weights, rounds=60)
    got = np.array([r.x for r in members.select("_tokens", "_p", M._rate(steps).alias("x")).orderBy("_tokens", "_p").collect()])
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0], tokens))
    p, tokens = p[order], tokens[order]
    target = min(tokens @ p[:, 0] / 0.7, tokens @ p[:, 1] / 0.3) * np.array(weights)
    s = np.linalg.inv((p * tokens[:, None]).T @ p)
    x = np.ones(300)
    for _ in range(4000):
        x = np.maximum(0, x - 0.9 * p @ (s @ ((tokens * x) @ p - target)))
    loss = lambda z: (lambda r: r @ s @ r)((tokens * z) @ p - target)
    assert (got >= 0).all() and loss(got) <= loss(x) + 5e-4 * target.sum()
    assert (tokens * got) @ p[:, :2] == pytest.approx(target[:2], rel=0.05)


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = M.mix(docs, M.label_domains(labels, poor="clean"), M.FILTER_TARGETS, nearest=True)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    rows = labels.collect()
    clean = [r.doc_id in kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.doc_id in kept for r in rows if r.toxic == 1]
    assert np.mean(clean) > 0.97 and np.mean(toxic) < 0.3


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "clash", None), (1, "", None, None), (None, "a b", None, None), (2, "b " * 100000, None, None), (2, "b " * 100000, None, None)], SCHEMA)
    labelled = spark.createDataFrame([(1, "clean"), (2, "toxic"), (None, "clean"), (3, None), (2, "unknown")], "doc_id long, domain string")
    got = M.rates(docs, labelled, M.MIX_TARGETS).collect()
    assert len(got) == 5 and all(r.rate >= 0 and abs(r.p_clean + r.p_poor + r.p_toxic - 1) < 1e-9 for r in got)
    assert M.mix(docs, labelled, M.MIX_TARGETS).columns == docs.columns
    assert M.rates(docs.limit(0), labelled, M.MIX_TARGETS).count() == 0
    assert len(M.rates(docs, labelled.limit(0), M.MIX_TARGETS).collect()) == 5
