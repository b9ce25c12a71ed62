import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from skein.llm import simhash as S
from skein.llm.components import star_components


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in g if x is not None), default=None) for r, g in groups.items() for i in [r]}, [find(i) for i in range(len(ids))]


def test_fingerprints(texts):
    for t in [None, "", "a", "A b", "a b c d", "É é x y Z z", "one\x85two \x1fthree four five six", *(t for _, t in texts[:60])]:
        assert S.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_links_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    fps = {0, 1, 3, 2 ** 64 - 1}
    for _ in range(25):  # families, chains and lone ones
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 12)):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(3)
    for radius, per_prefix, variants in ((4, 256, 1 << 22), (4, 2, 500), (3, 16, 4000), (2, 1, 100), (0, 256, 1 << 22)):
        monkeypatch.setattr(S, "VARIANTS", variants)
        edges = S.near_links(df, radius, per_prefix)
        roots = {r.node: r.root for r in star_components(edges).collect()}
        _, want = plain_components(list(range(len(fps))), fps, radius)
        as_long = [int(np.uint64(f).astype(np.int64)) for f in fps]
        got = [roots.get(f, f) for f in as_long]
        groups = lambda marks: sorted(sorted(i for i in range(len(marks)) if marks[i] == m) for m in set(marks))
        assert groups(got) == groups(want), (radius, per_prefix)


def test_prefixes_that_hold_a_large_family(spark):
    """A third of all fingerprints shares its first 40 bits: its prefixes are
    dealt out by more bits, no group is large, and no link is lost."""
    rng = random.Random(9)
    family = rng.getrandbits(40) << 24
    fps = list({family | rng.getrandbits(12) << 6 for _ in range(600)} | {rng.getrandbits(64) for _ in range(1200)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    _, want = plain_components(fps, fps, 4)
    for radius, load in ((4, 150), (3, 100)):
        over = S.overfull_prefixes(df, len(fps), 6, (radius + 1) // 2, load)
        assert len(over) > 3
        rows = [x for b in S.Deal(6, (radius + 1) // 2, over).rows()([pa.record_batch([pa.array(np.array(fps, np.uint64).view(np.int64))], ["fp"])]) for x in b.select(["bits", "prefix"]).to_pylist()]
        loads = Counter(tuple(r.values()) for r in rows)
        assert all(n <= load for (bits, _), n in loads.items() if bits < 6 + 8 * len(over))
        roots = {r.node: r.root for r in star_components(S.near_links(df, radius, 256, load)).collect()}
        if radius == 3:
            _, want = plain_components(fps, fps, 3)
        as_long = [int(np.uint64(f).astype(np.int64)) for f in fps]
        marks = [roots.get(f, f) for f in as_long]
        groups = lambda m: sorted(sorted(i for i in range(len(m)) if m[i] == x) for x in set(m))
        assert groups(marks) == groups(want)


def test_odd_radii_link_by_the_nearest_owner(spark, monkeypatch):
    # at a variant, two owners at the upper half of an odd radius are too far apart
    x = 2 ** 64 - 1
    chain = [x, x ^ 1, x ^ 1 << 63, x ^ 1 ^ 1 << 62]
    rng = random.Random(3)
    for radius in (1, 3, 5):
        half = (radius + 1) // 2
        cases = [chain] if radius == 1 else []
        for _ in range(40):  # few owners around each of a few variants
            fps = set()
            v = rng.getrandbits(64)
            for _ in range(3):
                for _ in range(4):
                    bits = rng.sample(range(12), rng.choice([half, half, half - 1]))
                    fps.add(v ^ sum(1 << 5 * b for b in bits))
                v ^= 1 << 5 * rng.randrange(12)
            cases.append(sorted(fps))
        for variants in (1 << 22, 300):
            monkeypatch.setattr(S, "VARIANTS", variants)
            for fps in cases:
                _, want = plain_components(fps, fps, radius)
                a, b = S.Ball(radius).forest(np.array(fps, np.uint64), 0, 0)
                root = dict(zip(a.tolist(), b.tolist()))
                got = [root.get(f, f) for f in fps]
                assert [[g == h for h in got] for g in got] == [[g == h for h in want] for g in want], (radius, variants, fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in chain], "fp long")
    roots = {r.node: r.root for r in star_components(S.near_links(df, 1)).collect()}
    assert len(roots) == 4 and len(set(roots.values())) == 1


def test_star_components_of_a_chain(spark):
    df = spark.range(1, 40).selectExpr("id * 7 % 41 AS a", "(id + 1) * 7 % 41 AS b")
    assert {r.root for r in star_components(df.union(df)).collect()} == {1}
    assert star_components(df.limit(0)).count() == 0


def test_groups_and_near_dedup(spark, docs):
    base = " ".join(f"word{i}" for i in range(6000))
    near = base.replace("word200 ", "changed ")
    assert (plain_fingerprint(base) ^ plain_fingerprint(near)).bit_count() <= 4
    rows = [(5, base), (3, near), (9, base.upper()), (4, "something else altogether " * 3), (8, None), (7, ""), (6, "  \n"), (None, base), (None, "lone text without an id"), (9, base), (11, "x " * 100_000)]
    out = {(r.doc_id, r.fingerprint): r.component_id for r in S.simhash_groups(docs(rows)).collect()}
    comp = lambda d, t: out[d, f"{plain_fingerprint(t):016x}"]
    assert comp(5, base) == comp(3, near) == comp(9, base) == comp(None, base) == 3
    assert comp(8, None) == comp(7, "") == comp(6, " ") == 6 and comp(4, rows[3][1]) == 4 and comp(None, rows[8][1]) is None
    assert S.simhash_groups(docs(rows)).count() == len(rows)
    kept = S.near_dedup(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, near), (4, rows[3][1]), (6, "  \n"), (None, base), (None, rows[8][1]), (11, rows[10][1])], key=repr)
    assert S.simhash_groups(docs([])).count() == 0


def test_query_groups_equal_all_pairs(spark, texts):
    import __spark_entry__ as E

    ids, fps = [d for d, _ in texts], [plain_fingerprint(t) for _, t in texts]
    _, roots = plain_components(ids, fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in E.queries()["op4_simhash_groups"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{f:016x}", ids[r]) for d, f, r in zip(ids, fps, roots)}
