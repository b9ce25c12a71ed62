import math

import pytest

from skein.llm import mixing as M


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the caps, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total, spill = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] > cap * sizes[s]:
                spill += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
        left = spill
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, "d": 1, None: 40}, {"a": 0, "b": 0}, {"a": 7}, {"a": 5, "b": 0, "c": 900}, {f"s{i:02}": 10 ** (i % 5) for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
    got = {r.src: r.target for r in M.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


def test_mix(spark, docs):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 3 else "hot") for i in range(400)]
    rows += [(1000 + i, "null source words", None) for i in range(5)] + [(None, "null id here", "s1"), (None, None, "s1"), (7, "again seven", "s1"), (7, "again seven", "s1"), (2000, "", "empty"), (2001, "many words " * 20_000, "s2"), (2002, "É", "É"), (2003, "É", "é")]
    df = docs(rows)
    out = M.mix(df)
    assert out.columns == [c for c in df.columns if c not in ("size", "target")] + ["size", "source_size", "target", "taken"]
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == round(want[s]) for s in sizes)
    cut = [r for r in got if r.taken % max(r.size, 1)]
    assert len(cut) <= len(sizes)  # one document per source is cut
    key = lambda rs: sorted(repr((r.doc_id, r.text, r.source, r.taken)) for r in rs)
    assert key(got) == key(M.mix(df.repartition(7)).collect())
    assert M.mix(docs([])).count() == 0


def test_mixed_documents(spark, docs):
    rows = [(i, f"doc{i}\n\tsome words " + "x " * (i % 9), "a" if i % 4 else "b") for i in range(60)] + [(90, "", "a"), (91, None, "c"), (92, "one two three", None)]
    df = docs(rows).drop("size", "target")
    mixed, plan = M.mixed_documents(df).collect(), {r.doc_id: r for r in M.mix(df).collect()}
    by = {}
    for r in mixed:
        by.setdefault(r.doc_id, []).append(r.text)
    for d, r in plan.items():
        texts = sorted(by.get(d, []), key=len)
        assert sum(len(t.split()) for t in texts) == r.taken
        whole = [t for t in texts if t == r.text]
        assert len(whole) == (r.taken // r.size if r.size else 0)
        for t in texts:
            assert r.text.startswith(t)
    assert set(by) <= set(plan) and mixed[0].__fields__ == df.columns


@pytest.mark.parametrize("point_bytes", [M.POINT_BYTES, 0])
def test_cut_points(spark, docs, monkeypatch, point_bytes):
    """Repeated ids and null ids at, before and after the cuts; a hot source;
    cut points as one broadcast table or looked up."""
    monkeypatch.setattr(M, "POINT_BYTES", point_bytes)
    rows = [(i % 70, f"{i} " + "w " * (i % 7), ["hot", "hot", "b", None, "d"][i % 5]) for i in range(300)]
    rows += [(None, "null id " * (i % 4), "hot" if i % 2 else None) for i in range(40)] + [(5, "same row here", "hot")] * 9 + [(900, "  ", "blank"), (901, None, "blank")]
    df = docs(rows).drop("size", "target")
    want, got = {}, {}
    for r in M.mix(df).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    mixed = M.mixed_documents(df).collect()
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {s: n for s, n in want.items() if n}
    # per (source, id, size), where mix orders alike
    words = {}
    for r in M.mix(df).collect():
        k = r.source, r.doc_id
        words[k] = words.get(k, 0) + r.taken
    for r in mixed:
        words[r.source, r.doc_id] -= len(r.text.split())
    assert not any(words.values())
    parts = [r for r in mixed if r.text not in {t for _, t, _ in rows}]
    assert len(parts) <= 4
    assert M.mixed_documents(docs([])).count() == 0
