import random
from collections import defaultdict

from skein.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=10):
    holders = defaultdict(set)
    key = lambda x: low(x.strip(WS))
    big = float("inf")
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(big if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (big if d is None else d)]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, docs, monkeypatch):
    rng = random.Random(4)
    pool = ["A common line of text", " a Common line OF text\t", "short", "ÉCOLE ouverte ici", "école ouverte ici", "\x0bten chars!", "nine char", "é" * 10, "É" * 10, "", " ", "\x85padded line\x85"]
    pool += [f"line number {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(i, "everywhere the same line\n" + str(i)) for i in range(60, 120)]
    rows += [(None, "A common line of text\nline number 3\nnull only line"), (None, "null only line\nx"), (500, None), (501, ""), (502, "\n"), (7, "line number 1\nonly in this row"),
             (503, "only in this row\n" + "z" * 200_000), (None, None)]
    for hot in (1, 20, 10 ** 9):  # all keys joined, some of them, all in the small table
        monkeypatch.setattr(L, "HOT", hot)
        out = L.line_dedup(docs(rows))
        assert out.columns[:3] == ["doc_id", "text", "lang"]
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
        assert got == [(d, t, n, k) for d, t, n, k in brute(rows)]
    assert L.line_dedup(docs([])).count() == 0


def test_rows_without_an_id_carry_only_their_own_lines(spark, docs, monkeypatch):
    each = 6
    shared = [[f"line {j} of the row {i}" for j in range(each)] for i in range(80)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(shared)] + [(None, "\n".join(x) + f"\nown line {i}") for i, x in enumerate(shared)] + [(500, "\n".join(x)) for x in shared]
    seen, real = [], L.dropped_keys

    def spy(*args):
        seen.append(real(*args))
        return seen[-1]

    monkeypatch.setattr(L, "dropped_keys", spy)
    monkeypatch.setattr(L, "HOT", 1)  # all keys are joined
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.line_dedup(docs(rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == brute(rows)
    sizes = [len(r["__gone"]) for r in seen[0].collect()]
    assert len(sizes) == 160 and max(sizes) == each
