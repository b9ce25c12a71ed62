import random
from collections import Counter

import numpy as np

from skein.llm import quality as Q


def brute_cover(text, w):
    ws = text.encode().split()
    c = Counter(tuple(ws[i:i + w]) for i in range(len(ws) - w + 1))
    return {p for i in range(len(ws) - w + 1) if c[tuple(ws[i:i + w])] > 1 for p in range(i, i + w)}


def brute_longest(text):
    ws = text.encode().split()
    for n in range(len(ws), 0, -1):
        if max(Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)).values(), default=0) > 1:
            return n
    return 0


def test_kernel_equals_brute_force():
    rng = random.Random(2)
    for least in (3, 5, 7):
        for _ in range(25):
            texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 10))]
            m = Q.measure(texts, least)
            assert m["n_repeat_words"] == [len(brute_cover(t, 5)) for t in texts]
            assert m["covered_words"] == [len(brute_cover(t, least)) for t in texts]
            longest = [brute_longest(t) for t in texts]
            assert m["longest_repeat"] == [n if n >= least else 0 for n in longest]
            for t, spans in zip(texts, m["spans"]):
                assert {p for a, b in spans for p in range(a, b)} == brute_cover(t, least)
                assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    word, doc = rng.integers(0, 3, 200), np.repeat([0, 1, 2, 3], 50)
    sa, _ = Q.suffix_array(word, doc)
    ends = (doc + 1) * 50
    suffixes = [(int(doc[i]), word[i:ends[i]].tolist()) for i in sa]
    assert suffixes == sorted(suffixes)


def test_operator(spark, docs):
    prose = " ".join(f"w{i}" for i in range(120))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, prose), (2, None), (3, ""), (4, "one two three"), (5, "spam ham " * 40), (None, prose), (1, prose),
            (6, f"{' '.join(f'a{i}' for i in range(900))} {passage} b {passage}"), (7, "x" * 300_000 + " " + prose),
            (8, "a #*$ b\n\n same line here\n \t\nsame line here \nsame line here é😀\x85 &&\nsame line here "), (9, "word " * 30_000)]
    out = Q.quality_rules(docs(rows))
    assert out.columns[:4] == ["doc_id", "text", "lang", "source"] and out.columns.count("kept") == 1
    got = [r.asDict() for r in out.collect()]
    assert [r["kept"] for r in got] == [True, False, False, False, False, True, True, False, True, False, False]
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_words"] == by[3]["n_words"] == 0 and by[2]["base_failed"] and by[2]["repeat_spans"] == []
    assert not by[6]["base_failed"] and by[6]["longest_repeat"] == 60 and [tuple(s) for s in by[6]["repeat_spans"]] == [(900, 960), (961, 1021)]
    assert by[8]["n_symbols"] == 5 and by[8]["n_dup_lines"] == 1 and by[8]["word_chars"] == len("a#*$bsamelinehere" + "samelinehere" * 3 + "é😀\x85&&")
    assert by[9]["n_repeat_words"] == by[9]["covered_words"] == 30_000 and by[9]["longest_repeat"] == 29_999
    assert Q.quality_rules(docs([])).count() == 0


def test_intervals_are_the_maximal_repeats():
    """Every maximal repeated substring, and no other, is an interval whose suffixes follow different words."""
    rng = random.Random(3)
    for _ in range(40):
        ws = [rng.randrange(3) for _ in range(rng.randint(2, 40))]
        word, doc = np.array(ws), np.zeros(len(ws), np.int64)
        sa, ranks = Q.suffix_array(word, doc)
        at, size = Q.neighbour_prefixes(sa, ranks, 2)
        value, first, last, parent, of_pair = Q.prefix_intervals(at.tolist(), size.tolist())
        got = set()
        for v, a, b in zip(value, first, last):
            starts = sa[a:b + 1].tolist()
            if len({ws[i - 1] if i else -1 for i in starts}) > 1 or 0 in starts:
                got.add(tuple(ws[starts[0]:starts[0] + v]))
        want = set()
        for n in range(2, len(ws)):
            where = {}
            for i in range(len(ws) - n + 1):
                where.setdefault(tuple(ws[i:i + n]), []).append(i)
            for g, starts in where.items():
                left = {ws[i - 1] if i else -1 for i in starts}
                right = {ws[i + n] if i + n < len(ws) else -1 for i in starts}
                if len(starts) > 1 and len(left) > 1 and len(right) > 1:
                    want.add(g)
        assert got == want
        for i, p in enumerate(parent):
            assert p < 0 or value[p] < value[i] and first[p] <= first[i] and last[i] <= last[p]
        assert all(value[i] == n for i, n in zip(of_pair, size))


def test_long_repetitive_text_in_bounded_memory():
    import tracemalloc

    words = np.tile(np.arange(500), 4000)  # 2 million words
    tracemalloc.start()
    best = Q.longest_repeats(words, np.zeros(len(words), np.int64), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best[0] == len(words) - 500 and peak < 600 * len(words)
