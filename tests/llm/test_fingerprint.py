"""Sketches against sets, and the comparison with the next document against plain Python."""

import hashlib
from collections import Counter

import numpy as np

from tidemark.llm import fingerprint as P

SCHEMA = "doc_id long, text string, fingerprint string"


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 30))) for _ in range(rng.integers(0, 9))) for _ in range(n)]


def test_peeling_recovers_all_differences():
    one = [*texts(60, 1), "", "", "same text", "x\n" * 5000, " ".join(map(str, range(30000)))]
    other = [*texts(60, 2), "", "a b c", "same text", "x\n" * 5003, " ".join(map(str, range(100, 30100)))]
    a, b = (P.Paragraphs([t.encode() for t in side]) for side in (one, other))
    text, digest, sign = P.differences(a, b)
    for k in range(len(one)):
        x, y = (set(p.digest[p.text == k].tolist()) for p in (a, b))
        assert len(x) == a.count[k] and len(y) == b.count[k]
        assert set(digest[(text == k) & (sign == 1)].tolist()) == x - y
        assert set(digest[(text == k) & (sign == -1)].tolist()) == y - x
        assert np.isclose(P.likeness(a, b)[k], 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0)


def test_paragraphs_cover_the_text():
    p = P.Paragraphs([b"", b"one", b"a b\n\nc d\n", b"\n\n", " ".join(map(str, range(100))).encode()])
    assert p.count[0] == 0 and p.count[1] == 1 and p.count[4] >= 100 // 16


def test_compare_with_next(spark):
    data = [(k * 3 % 101, t) for k, t in enumerate(texts(100, 3))]
    data += [(500, None), (501, ""), (502, "ab\U0001f600cd"), (502, "ab\U0001f600ce"), (503, "long line " * 40000), (None, "no id"), (None, None), (504, "tie"), (504, "tie")]
    got = P.compare_with_next(spark.createDataFrame([(*r, "clash") for r in data], SCHEMA).repartition(6)).collect()
    ordered = sorted(((d, t or "") for d, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = Counter()
    for k, (d, t) in enumerate(ordered):
        new = P.edited(t, ordered[(k + 1) % len(ordered)][1])
        want[d, len(t), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = {(r.doc_id, r.n_chars): r for r in got}
    assert by_id[503, 400000].near_edited > 0.4
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    ties = [r for r in got if r.doc_id == 504]
    assert ties[0].fingerprint == ties[1].fingerprint and {r.near_next for r in ties} >= {1.0}


def test_one_and_none(spark):
    one = P.compare_with_next(spark.createDataFrame([(1, "abcd", None)], SCHEMA)).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(4, 1.0)]
    assert P.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
