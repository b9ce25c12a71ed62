import hashlib

import pytest

from skein.llm import exact_dedup as X


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.mark.parametrize("hot", [500, 4])
def test_equals_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(X, "HOT", hot)
    rows = [(i, "The Same Text" if i % 2 else "the same text") for i in range(100)]
    rows += [(200 + i, f"text {i % 40}") for i in range(80)] + [(300, None), (301, ""), (302, " "), (None, "The same text"), (None, "null only"), (None, "null only"),
             (400, "É"), (401, "é"), (402, "x" * 300_000), (403, "X" * 300_000), (404, "dup row"), (404, "dup row"), (-5, "negative"), (-6, "NEGATIVE")]
    out = X.exact_dedup(docs(rows).repartition(3)).collect()
    assert len(out) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(low(t).encode()).hexdigest(), []).append(d)
    kept = {}
    for r in out:
        ids = groups[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert r.keep_id == best and r.group_size == len(ids) and r.doc_id in ids
        assert not r.kept or r.doc_id == best
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(d) for d, _ in rows)
    assert X.exact_dedup(docs([])).count() == 0
