"""Snapshot collapse against plain Python."""

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rendered string, position string"


def brute(rows):
    turns = {}
    for c, _, r, t in sorted(((c, n, r or "", t or "") for c, n, r, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3])):
        turns.setdefault(c, []).append((r, t))
    out = {}
    for c, own in turns.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in turns.values())
        equal = any(o == own and k != c and (c is None or (k is not None and k < c)) for k, o in turns.items())
        if not longer and not equal:
            for p in range(0, len(own), 64):
                out[c, p // 64] = (len(own), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own[p : p + 64]))
    return out


def rows():
    out = []
    for c in range(40):
        n = c % 8 + 1
        out += [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k} of {c // 16}") for k in range(n)]
    out += [(100, k, "user", f"t{k}") for k in range(900)] + [(101, k, "user", f"t{k}") for k in range(500)]
    out += [(102, k, "user", f"t{k}") for k in range(500)] + [(103, 0, "user", "t0"), (103, 1, "user", "other")]
    out += [(200, 1, None, None), (200, 1, "a", "x"), (200, None, "b", "y"), (200, 1, "a", "x"), (None, 0, "user", "nobody"), (300, 0, "user", "long " * 50000)]
    return out


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, None, "clash") for r in data], SCHEMA).repartition(7)
    got = {(r.conv_id, r.part): (r.n_turns, r.rendered) for r in chat.collapse(df).collect()}
    assert got == brute(data)


def test_empty(spark):
    assert chat.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
