"""Each stage of the pipeline on its own input against brute force, and run() against the stages."""

import re
import zlib

import numpy as np

import corpus_pipeline as P
from tidemark.llm import token_output as T

SF = "/root/testdata/sf0.001"


def grams(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
    every, good, single, clean, mixed = seen
    known = [d for d in every if d in labels]
    assert np.mean([(d in good) == (labels[d].quality == 1) for d in known]) > 0.97

    ids = sorted(good)
    shingles = {d: grams(good[d]) for d in ids}
    like = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    for i, a in enumerate(ids):
        near = [b for b in ids[:i] if like(a, b) >= 0.8 or good[a] == good[b]]
        assert (a not in single) if near else True
        assert a in single or any(like(a, b) >= 0.5 for b in ids if b != a)

    leaks = {d for d in single if any(t in single[d] for t in bench)}
    assert not leaks & set(clean) and all(d in clean or any(grams(t) & grams(single[d]) for t in bench) for d in single)

    kept = [d in mixed for d in clean if d in labels and labels[d].toxic == 0]
    assert np.mean(kept) > 0.97
    assert set(mixed) <= set(clean)

    coder = T.encoder(T.default_tokenizer())
    start = 0
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(mixed)
    for r in rows:
        ids = [*coder.tokenizer.encode(mixed[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = {(r.doc_id, r.start, r.ids_crc32) for r in P.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.start, r.ids_crc32) for r in rows}
