"""Benchmark passages against brute force over all windows."""

import re
from collections import Counter

import numpy as np

from tidemark.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def grams(own):
    size = min(5, len(own))
    return Counter(tuple(own[i : i + size]) for i in range(len(own) - size + 1)) if own else Counter()


def brute(docs, items):
    out = {}
    for d, text in docs:
        own = words(text)
        for i, passage in items:
            n, want = len(words(passage)), grams(words(passage))
            width = min(n, len(own))
            if not n or width < min(5, n):
                continue
            best = 0.0
            for s in range(len(own) - width + 1):
                got = Counter(tuple(own[k : k + min(5, n)]) for k in range(s, s + width - min(5, n) + 1))
                both = sum((got & want).values())
                best = max(best, both / (got.total() + want.total() - both))
            if best >= 0.8:
                out[d, i] = best
    return out


def data():
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{k}" for k in range(300)] + ["Été", "naïve"])
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, some(rng.integers(5, 60))) for k in range(20)] + [(20, "one two"), (21, "one two"), (22, ""), (23, None), (24, "w1 " * 30), (None, some(20))]
    docs = [(k, some(rng.integers(0, 150))) for k in range(40)]
    for k in range(40, 70):
        passage = items[k % 20][1].split()
        if k % 3 == 0:
            passage[len(passage) // 2] = "CHANGED"
        if k % 5 == 0:
            passage = passage[: len(passage) * 9 // 10]
        docs.append((k, some(rng.integers(0, 60)) + " " + ", ".join(passage).upper() + ". " + some(rng.integers(0, 60))))
    docs += [(90, None), (91, ""), (92, "say one  TWO now"), (93, items[0][1]), (94, "w1 " * 200), (95, some(1200) + " " + items[3][1]), (93, items[0][1]), (None, items[5][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = data()
    df, bench = spark.createDataFrame([(*d, "clash") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    want = brute(docs, items)
    for block_bytes in (D.ITEM_BLOCK_BYTES, 1500):
        rows = D.contaminated(df, bench, block_bytes=block_bytes).collect()
        got = {(r.doc_id, r.item_id): r.similarity for r in rows}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
        assert sum(r.doc_id == 93 and r.item_id == 0 for r in rows) == 2
    leaked = {d for d, _ in want}
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaked)


def test_empty(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.contaminated(docs, bench).count() == 0
    assert D.drop_contaminated(spark.createDataFrame([(1, "a", None)], DOCS), bench).count() == 1


def test_text_ids(spark):
    docs = spark.createDataFrame([("", "one two three four five six"), ("b", None), (None, "ONE two, three four five six")], "doc_id string, text string")
    items = spark.createDataFrame([("", "one two three four five six"), (None, "x"), ("k", "nothing like it at all here")], "item_id string, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in D.contaminated(docs, items).collect()) == [("", ""), ("None", "")]


def test_lookup_finds_all_within_the_radius():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 30)).encode() for _ in range(200)]
    (length,) = D.index_items(list(range(200)), texts).lengths
    codes = np.concatenate((length.codes ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), rng.integers(0, 1 << 63, 300, dtype=np.uint64)))
    want = {(a, b) for a in range(len(codes)) for b in range(200) if bin(int(codes[a] ^ length.codes[b])).count("1") <= length.radius}
    assert set(zip(*(x.tolist() for x in length.lookup(codes)))) == want and len(want) >= 200


def test_recall_at_the_least_similarity():
    """Pairs of windows just above similarity 0.8: nearly all lie within the radius that their length gives."""
    rng = np.random.default_rng(10)
    for n in (9, 12, 20, 45, 130):
        away = n - int(np.ceil(2 * n * 0.8 / 1.8 - 1e-9))
        a = rng.integers(0, 1 << 63, (500, n), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (500, n), dtype=np.uint64)
        b = a.copy()
        b[:, :away] = rng.integers(0, 1 << 63, (500, away), dtype=np.uint64) * np.uint64(2)
        code = lambda x: D._fingerprint(D._bits(x.ravel()).reshape(500, n, 64).sum(1, dtype=np.int64), np.full(500, n))  # noqa: B023, E731
        assert (np.bitwise_count(code(a) ^ code(b)) <= D.radius_for(n)).mean() > 0.995, n
    assert [D.radius_for(n) for n in (1, 5, 8)] == [0, 0, 0]
