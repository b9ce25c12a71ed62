import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import collocations as C


def plain_pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows, n):
    f = Counter()
    for lang, text in rows:
        for words in plain_pieces(text):
            for k in range(1, n + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und" if lang is None else lang, tuple(words[i:i + k])] += 1
    return f


def plain_collocations(rows, n, least, percent, first):
    f = plain_counts(rows, n)
    total = Counter()
    for (lang, p), a in f.items():
        if len(p) == 1:
            total[lang] += a
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        longer = [b for (l2, q), b in found.items() if l2 == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rs)[:first]))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "The", "É", "x-y", "a", "b", "new", "york", "city", "z" * 30] + [f"w{i}" for i in range(15)]
    fixed = ["one long line that is found again and again in many texts", "new york city hall", "loop loop loop loop"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(9))) for _ in range(rng.randrange(6))]
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice([". ", "\n", "  ", ",", "\t"]).join(parts)))
    return rows + [("en", None), ("fr", ""), ("fr", "only once here"), (None, "new york " * 400), ("und", "new york"), ("en", "!?.\n")]


def test_numbered_and_grams():
    for text in ("A b.c\td,,e f  g\x0bh\x85i\x00j", "", "  ", ".", "a", "É É é"):
        numbers, words = C.numbered([text])
        got = [[words[i - 1].decode() for i in p] for p in "".join(chr(x) for x in numbers).split("\0") for p in [[ord(c) for c in p]] if p]
        assert got == [p for p in plain_pieces(text) if p]
    numbers = np.array([0, 1, 2, 1, 2, 1, 0, 2, 0])
    made = C.grams(numbers, 3)
    as_dict = {tuple(int(c[i]) for c in cols): int(n) for cols, often in made for i, n in enumerate(often)}
    assert as_dict == {(1, 2, 1): 2, (2, 1, 2): 1, (2, 1): 1, (1,): 1, (2,): 1}
    big = C.grams(np.array([0, 1 << 40, 1 << 41, 1 << 40, 0]), 3)
    assert sum(int(o.sum()) for _, o in big) == 3


@pytest.mark.parametrize("n,hot", [(3, 1000), (3, 3), (2, 4), (4, 3)])
def test_counts_and_collocations(spark, monkeypatch, n, hot):
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "SLICE_BYTES", 2000)
    rows = corpus(n + hot, 250)
    df = spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    want = plain_counts(rows, n)
    src = df.selectExpr("coalesce(lang, 'und') AS lang", "text")
    frequent = {}
    for r in C.language_words(src).collect():
        if r.word is None:
            assert r.n == sum(v for (lang, p), v in want.items() if lang == r.lang and len(p) == 1)
        else:
            frequent.setdefault(r.lang, set()).add(r.word.encode())
    for (lang, p), v in want.items():
        if len(p) == 1 and v * hot > sum(x for (l2, q), x in want.items() if l2 == lang and len(q) == 1):
            assert p[0].encode() in frequent[lang]
    made = C.phrase_counts(src, n, 4, frequent).collect()
    counts = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in made}
    assert all(len(r.phrase.split(" ")) == r.k for r in made)
    assert counts == {k: v for k, v in want.items() if v >= 4}
    got = C.collocations(df, max_words=n, min_count=4, first=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, n, 4, 50, 40)


def test_paths_are_compacted(spark):
    rows = [("en", "start a1 a2 a3 a4 a5 finish")] * 6 + [("en", "a3 other")] * 2 + [("en", "p q r")] * 5
    counts = C.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 3, 2)
    paths = {(tuple(r.words), r.n) for r in C.compact_paths(counts).collect()}
    assert paths == {(("start", "a1", "a2", "a3", "a4", "a5", "finish"), 6), (("p", "q", "r"), 5)}
    longest = " ".join(f"v{i}" for i in range(300))
    counts = C.phrase_counts(spark.createDataFrame([("en", longest)] * 3, "lang string, text string"), 3, 2)
    assert [(len(r.words), r.n) for r in C.compact_paths(counts).collect()] == [(300, 3)]


def test_large_products_and_empty_table(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 9 * 10**12), ("en", "a", 1, 3 * 10**13), ("en", "b", 1, 9 * 10**12 + 7)], "lang string, phrase string, k int, n long")
    found = counts.where("k = 2")
    r = C.scored(found, counts).first()
    assert r["score"] == 10**6 * (9 * 10**12) ** 2 // (3 * 10**13 * (9 * 10**12 + 7)) and (r.l, r.r) == (3 * 10**13, 9 * 10**12 + 7)
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_words_whose_rows_span_batches(spark, monkeypatch):
    """Counted lines reach the counting task in rows; those of a word may fill many Arrow batches."""
    monkeypatch.setattr(C, "SLICE_BYTES", 60)
    rows = [r for r in corpus(8, 60) if r[0] in (None, "en")]
    src = spark.createDataFrame([("und" if lang is None else lang, t) for lang, t in rows], "lang string, text string").repartition(4)
    made = C.edges(src, 3, {"en": {b"the", b"of"}})
    assert dict(made.dtypes)["often"] == "array<int>"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in C.phrase_counts(src, 3, 2, {"en": {b"the", b"of"}}).collect()}
            assert got == {k: v for k, v in plain_counts(rows, 3).items() if v >= 2}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
