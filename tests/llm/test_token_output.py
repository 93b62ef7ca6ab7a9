"""Token output: ids as the library gives them, and an exact round trip."""

import zlib

import numpy as np

from tidemark.llm import token_output as T

SCHEMA = "doc_id long, text string, start string"
TEXTS = [
    (5, "plain words of a text"), (3, None), (4, ""), (1, "two  spaces"), (2, " leads"), (8, "trails "), (7, "tab\t x\n y"), (6, "<|endoftext|> inside <|endoftext|>"), (9, "é à   \U0001f600 x"),
    (10, "line\nnext\n\nlast 12345 it's"), (11, "again " * 20000), (12, "x" * 20000), (2, "same id"), (2, "same id"), (None, "no id"), (13, "　wide 　 x"),
]


def test_round_trip(spark):
    coder = T.encoder(T.default_tokenizer())
    rng = np.random.default_rng(2)
    data = TEXTS + [(100 + k, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 60)))) for k in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA).repartition(5)
    got = sorted(T.token_rows(df, T.default_tokenizer()).collect(), key=lambda r: r.start)
    start = 0
    ordered = sorted(((d, t or "") for d, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for r, (d, t) in zip(got, ordered, strict=True):
        ids = [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_grammar_is_exact_and_random_access():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 5), (1, 5), (2, 1), (5000, 1), (5001, 2), (20000, 50), (3000, 50000)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        grammar = T.Grammar.from_bytes(T.Grammar.of(ids, 50257).to_bytes())
        assert (grammar.decode() == ids).all()
        for a, b in ((0, 7), (n // 3, n // 2), (n - 5, n + 9)):
            assert (grammar.decode(max(a, 0), b) == ids[max(a, 0) : b]).all()
        assert [len(grammar.expand(np.array([50257 + k], np.uint32))) for k in range(len(grammar.rules))] == grammar.lengths.tolist()
    assert len(T.Grammar.of(np.zeros(4096, np.uint32), 10).sequence) <= 20


def test_empty(spark):
    assert T.token_rows(spark.createDataFrame([], SCHEMA), T.default_tokenizer()).count() == 0


def test_one_id_on_all_rows(spark):
    coder = T.encoder(T.default_tokenizer())
    for name in (7, None):
        texts = sorted(f"text number {k % 40} of one id" for k in range(300))
        df = spark.createDataFrame([(name, t) for t in texts], "doc_id long, text string").repartition(6)
        got = sorted(T.token_rows(df, T.default_tokenizer()).collect(), key=lambda r: r.start)
        want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(name, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]


def test_pieces_match_the_library():
    """Random texts of marks, letters, breaks and special tokens, with the table shrunk and forgotten in between."""
    import random

    rng = random.Random(5)
    parts = ["a", "B", "é", "×", "ñ", "日", "😀", ".", ",", "\n", " ", "  ", "\t", "'s", "1", "_", "##", "　", "\xa0", "\x85", "<|", "<|endoftext|>", ".\n", "Ġ", "́", "-", "'", "A.\nB", "\x01", "\x00", "µ", "12", "!!"]
    coder = T.encoder(T.default_tokenizer())
    for k in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)]
        if k % 10 == 3:
            coder.forget()
        if k % 7 == 3:
            coder._shrink()
        ids, sizes = coder.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*e.ids, 0] for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_short_pieces_are_their_own_keys(monkeypatch):
    """Only the bytes of pieces over 16 bytes are hashed; pieces alike but for a byte, or a length, differ."""
    asked, powers = [], T.kernels.powers
    monkeypatch.setattr(T.kernels, "powers", lambda n: asked.append(n) or powers(n))
    coder = T.Encoder(T.default_tokenizer())
    asked.clear()
    sizes = (1, 7, 8, 9, 15, 16, 17, 24, 33)
    texts = [" ".join(p for n in sizes for p in (c * n, c * (n - 1) + "b", "b" + c * (n - 1))) for c in ("a", "\x00", "é", "#", "5")]
    texts += ["all of these are short words of a text " * 500]
    ids, counts = coder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*e.ids, 0] for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert max(asked) < sum(map(len, texts)) / 10
    raw = np.frombuffer(bytes(range(97, 113)) * 64 + b"\0" * 16, np.uint8)
    begins, ends = (x.ravel() for x in np.meshgrid(np.arange(16), np.arange(17)))
    ends = begins + ends
    keys = coder._keys(raw, np.tile(begins, 2), np.tile(ends, 2), np.repeat([True, False], len(begins)))
    want = {(raw[a:b].tobytes(), f) for f in (True, False) for a, b in zip(begins, ends)}
    assert len(set(zip(*(k.tolist() for k in keys)))) == len(want)
