import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import ranked_search as R

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    """All documents scored for every item."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counts:
            m, score = 100 - 25 + (25 * n * n_docs) // n_terms, 0
            for t in plain_terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(scored[:k])]
    return out


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"É{i}" for i in range(vocabulary)]
    made = lambda most: " ".join(rng.choices(words, [1 / (i + 1) for i in range(vocabulary)], k=rng.randrange(most)))
    docs = [made(60) for _ in range(n)]
    docs += [docs[3]] * 30 + ["", None, "...!", "Alpha_beta-GAMMA alpha", "w1 " * 5000]
    items = [made(12) for _ in range(15)] + ["", None, "unknownword", "w1 w1 W1", "alpha gamma"]
    return docs, items


def test_terms():
    for t in ("Ab_c-d é1É\x00x\x7fy\x85z  q", "", "a'b", "日本 語。x"):
        assert [x.decode() for x in R.terms_of(t)] == plain_terms(t)


@pytest.mark.parametrize("seed", range(6))
def test_segment_finds_the_best(seed, monkeypatch):
    monkeypatch.setattr(R, "FIRST_DEPTH", 1 + seed)
    texts, items = corpus(seed, 200)
    counts = [(i, Counter(x.decode() for x in R.terms_of(t))) for i, t in enumerate(texts) if t and R.terms_of(t)]
    terms = sorted({t for _, c in counts for t in c})
    at = {t: i for i, t in enumerate(terms)}
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weights = np.array([R.weight(n_docs, df[t]) for t in terms], np.int64)
    flat = [sorted((at[t], f) for t, f in c.items()) for _, c in counts]
    seg = R.Segment(pa.array([d for d, _ in counts]), np.array([sum(c.values()) for _, c in counts]), np.array([len(f) for f in flat]),
                    np.array([x for f in flat for x, _ in f], np.int32), np.array([x for f in flat for _, x in f], np.int32), n_docs, n_terms)
    want = plain_ranking(list(enumerate(texts)), list(enumerate(items)), 5)
    for q, text in enumerate(items):
        own = Counter(at[t] for t in plain_terms(text) if t in at)
        t = np.array(sorted(own), np.int64)
        w = weights[t] * np.array([own[x] for x in t.tolist()], np.int64) if len(t) else np.empty(0, np.int64)
        got = [(s, counts[d][0]) for s, d in seg.search(q, t, w, 5, [])]
        assert got == [(s, d) for i, _, d, s in want if i == q]
        # with known scores, what can be among the best is still found
        floor = [s for s, _ in got[:2]] * 2
        again = [(s, counts[d][0]) for s, d in seg.search(1000 + q, t, w, 5, floor)]
        need = sorted([(-s, 0, d) for s, d in got] + [(-s, -1, -1) for s in floor])[:5]
        assert all((-s, d) in again for s, _, d in need if d >= 0)


def test_stops_before_the_end(monkeypatch):
    """One document far above the others: few postings are met."""
    monkeypatch.setattr(R, "FIRST_DEPTH", 4)
    n = 5000
    terms, tfs = np.tile(np.array([0, 1], np.int32), n), np.ones(2 * n, np.int32)
    tfs[:2] = 50
    sizes = np.full(n, 40)
    sizes[0] = 100
    seg = R.Segment(pa.array(range(n)), sizes, np.full(n, 2), terms, tfs, n, int(sizes.sum()))
    assert [d for _, d in seg.search(0, np.array([0, 1]), np.array([3, 3]), 1, [])] == [0]
    assert (seg.met >= 0).sum() < 100


@pytest.mark.parametrize("segment", [40, 1 << 22])
def test_ranked_search(spark, docs, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(R, "QUERY_BYTES", 60)
    texts, items = corpus(7, 120)
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)] + [(None, "w1 w2 É0"), (None, "w1 w2 É0"), (5000, "w1 w2 É0"), (5000, "w1 w2 É0")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(items)], "item_id long, text string, score string, rank int")
    got = R.ranked_search(docs(rows).repartition(3), asked, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0], r[1])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(plain_ranking(rows, list(enumerate(items)), 7), key=key)


def test_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert R.ranked_search(docs([]), asked).count() == 0
    assert R.ranked_search(docs([(1, ""), (2, None)]), asked).count() == 0
    assert R.ranked_search(docs([(1, "a")]), asked.limit(0)).count() == 0
