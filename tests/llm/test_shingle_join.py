"""Near-duplicates of the pipeline against exact Jaccard similarities."""

import numpy as np

from tests.llm.test_pipeline import grams
from tidemark.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string"


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / max(1, len(a | b))


def least_of_components(data):
    at = {d: d for d, _ in data}
    for k, (d, x) in enumerate(data):
        for e, y in data[:k]:
            if x == y or similarity(x, y) >= 0.8:
                a, b = at[d], at[e]
                at = {i: min(a, b) if c in (a, b) else c for i, c in at.items()}
    return {d for d, c in at.items() if d == c}


def changed(words, new, kind, n):
    """A copy with one contiguous passage of n words appended, cut off or replaced."""
    if kind == 0:
        return words + new[:n]
    return words[:-n] + (new[:n] if kind == 2 else [])


def test_contiguous_changes(spark):
    """Passages appended, cut off and replaced: what is at 0.8 is found, what is below stays."""
    rng = np.random.default_rng(3)
    data = []
    for k in range(60):
        words, new = ([f"w{x}" for x in rng.integers(0, 2000, 200)] for _ in range(2))
        n = int(rng.choice([18, 20, 22, 30, 38, 45, 48, 52, 60]))
        data += [(k, " ".join(words)), (1000 + k, " ".join(changed(words, new, k % 3, n)))]
    want = least_of_components(data)
    assert 70 < len(want) < 110
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for rows in (2, 2000):
        assert {r.doc_id for r in S.keep_one(df, group_rows=rows).collect()} == want


def test_templated_texts_and_groups(spark):
    """Many texts share a long passage: groups are cut into parts, with the same components."""
    rng = np.random.default_rng(4)
    shared = [f"s{x}" for x in range(100)]
    data = [(d, t) for d, t in [(0, None), (1, ""), (2, "!!"), (3, "?"), (4, "?"), (5, "One two"), (6, "one TWO."), (7, "two one")]]
    for k in range(8, 100):
        words = shared + [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(5, 60)))]
        if rng.random() < 0.3:
            words[int(rng.integers(0, 100))] = "other"
        data.append((k, " ".join(words)))
    want = least_of_components([(d, t or "") for d, t in data])
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for rows in (10, 2000):
        assert {r.doc_id for r in S.keep_one(df, group_rows=rows).collect()} == want
