"""SimHash near-dedup against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, fp string"


def brute_simhash(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, codes, radius=3):
    at = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    return [min(ids[k] for k in range(len(ids)) if at[k] == at[i]) for i in range(len(ids))]


def rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)] + ["É", "ÄB", "x y"]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "one TWO"), (6, "a b c"), (7, "A b  c")]
    for k in range(8, 60):
        text = " ".join(rng.choice(words, rng.integers(3, 200)))
        out += [(10 * k, text), (10 * k + 1, text.upper()), (10 * k + 2, text + " tail")]
    return [(*r, "clash") for r in out] + [(600, "very long " * 30000, None), (600, "very long " * 30000, None)]


def test_matches_brute_force(spark):
    data = rows()
    got = S.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()
    assert len(got) == len(data)
    codes = [brute_simhash(t) for _, t, _ in data[:-2]]
    want = dict(zip([d for d, *_ in data[:-2]], zip(codes, brute_components([d for d, *_ in data[:-2]], codes))))
    for r in got:
        if r.doc_id != 600:
            assert (r.fp % (1 << 64), r.component_id) == want[r.doc_id]


def test_links_of_dense_codes(spark):
    """Groups over the task limit are divided, with the same components."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    codes = {base}
    while len(codes) < 400:
        x = base if rng.random() < 0.5 else int(rng.choice(list(codes)))
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        codes.add(x)
    codes = sorted(codes | {int(x) for x in rng.integers(0, 1 << 63, 50)})
    df = spark.createDataFrame([(S._signed(c), S._signed(c)) for c in codes], "node long, fp long")
    want = brute_components(codes, codes)
    for rows in (120, 5000):
        edges = S.links(df, group_rows=rows).collect()
        at = {c: c for c in codes}

        def top(x, at=at):
            while at[x] != x:
                x = at[x]
            return x

        for e in edges:
            a, b = top(e.a % (1 << 64)), top(e.b % (1 << 64))
            at[max(a, b)] = min(a, b)
        assert [top(c) for c in codes] == want


def test_keep_one_finds_near_copies(spark):
    rng = np.random.default_rng(9)
    texts, copies = [], []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(60, 300))]
        texts.append((k, " ".join(words)))
        if k % 3 == 0:
            for _ in range(max(1, len(words) // 60)):
                words[rng.integers(0, len(words))] = "changed"
            copies.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame([(*r, None) for r in texts + copies + [(2000, texts[1][1].upper())]], SCHEMA).repartition(5)
    for rows in (30, 2000):
        kept = {r.doc_id for r in S.keep_one(df, group_rows=rows).collect()}
        assert kept >= {k for k, _ in texts}
        assert 2000 not in kept and len(kept) <= len(texts) + 1


def test_keep_one_and_empty(spark):
    data = [(1, "a b c d e f g h", "k"), (2, "a b c d e f g h", None), (2, "a b c d e f g h", None), (3, "other words go here now and on", None), (None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_names_and_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 0, "x", 1), (2, text, 0, "y", 2), (3, None, 1, None, None), (None, text, 2, "z", 3), (4, text + " eleven", 3, "w", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _id string, node long")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r._gone) for r in kept.collect()) == [("1", 0), ("3", 1), ("None", 2)]
    with pytest.raises(TypeError):
        S.keep_one(spark.createDataFrame([("a", text)], "doc_id string, text string"))


def test_near_copies_with_long_passages_changed(spark):
    """Copies with a passage appended, cut off or replaced, at similarity 0.8 and more: none is missed."""
    rng = np.random.default_rng(21)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    rows, groups = [], []
    for g in range(60):
        base = some(200)
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(base + some(40))), (3 * g + 2, " ".join(base[:170] + some(10)))]
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: grams(t) for d, t in rows}
    near = [d for d in sets if d % 3 and len(sets[d] & sets[d - d % 3]) >= 0.8 * len(sets[d] | sets[d - d % 3])]
    assert len(near) > 50 and not set(near) & kept and {3 * g for g in range(60)} <= kept
