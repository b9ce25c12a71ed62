import hashlib
import random
import zlib

import pytest

from skein.llm import sharding as S


def plain_capacity(sizes, shards):
    """Smallest largest sum of a contiguous partition, by dynamic programming."""
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min(max(best[m], upto[i] - upto[m]) for m in range(i + 1)) for i in range(len(upto))]
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_blocks_bound_the_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 40, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 80))]
    for shards in (1, 2, 3, 8):
        want = plain_capacity(sizes, shards)
        single = S.Blocks([(i, s, True) for i, s in enumerate(sizes)])
        assert single.capacity(shards, True) == single.capacity(shards, False) == want and not single.open_blocks(shards)
        # blocks of several groups bound it from both sides
        step = rng.randrange(2, 6)
        mixed = S.Blocks([(i, sum(sizes[i:i + step]), len(sizes[i:i + step]) == 1) for i in range(0, len(sizes), step)])
        assert mixed.capacity(shards, True) <= want <= mixed.capacity(shards, False)


def plain_shards(texts, shards):
    """shard of each text's key, as the method says."""
    sizes = {}
    for t in texts:
        key = int(hashlib.md5((t or "").encode()).hexdigest()[:S.DIGITS], 16)
        sizes[key] = sizes.get(key, 0) + len((t or "").encode()) + 1
    apart = S.set_apart(sorted(((k, n) for k, n in sizes.items()), key=lambda x: (-x[1], x[0]))[:shards], sum(sizes.values()), shards)
    rest = sorted(k for k in sizes if k not in apart)
    left = shards - len(apart)
    cap, out, shard, filled = plain_capacity([sizes[k] for k in rest], left), {}, 0, 0
    for k in rest:
        if filled + sizes[k] > cap:
            shard, filled = shard + 1, 0
        filled += sizes[k]
        out[k] = shard
    return out | {k: left + i for i, k in enumerate(apart)}


CASES = {
    "mixed": [f"text {i} " + "x" * (i * 37 % 101) for i in range(300)] + ["copy"] * 40 + [None, "", "É" * 50, "w " * 9000],
    "third": ["same text again"] * 200 + [f"t{i}" for i in range(400)],
    "few": ["a", "b"],
    "same": ["one"] * 30,
    "giants": ["g" * 5000, "h" * 4000, "i" * 200] + [f"{i}" for i in range(50)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, docs, monkeypatch, case, shards):
    # few bits a step, so that blocks are divided more than once
    monkeypatch.setattr(S, "FIRST_BITS", 3)
    monkeypatch.setattr(S, "MORE_BLOCKS", 16)
    texts = CASES[case]
    got = S.shard_documents(docs([(i if i % 7 else None, t) for i, t in enumerate(texts)]).repartition(3), shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    got = got.collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    want, slots = plain_shards(texts, shards), {}
    for i, t in enumerate(texts):
        if i % 7:
            r, raw = by_id[i], (t or "").encode()
            assert (r["size"], r.text_crc32, r.shard) == (len(raw) + 1, zlib.crc32(raw), want[int(hashlib.md5(raw).hexdigest()[:S.DIGITS], 16)])
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    largest = {}
    for t in texts:
        largest[t or ""] = largest.get(t or "", 0) + len((t or "").encode()) + 1
    even = sum(sums.values()) / shards
    assert max(sums.values()) <= even + max(largest.values())


def test_repeated_ids_and_empty_table(spark, docs):
    got = S.shard_documents(docs([(1, "x")] * 20 + [(None, None)] * 5), 4).collect()
    assert sorted((r.shard, r.slot) for r in got if r.doc_id is None) == [(got[0].shard if got[0].doc_id is None else r.shard, i) for i, r in
                                                                        enumerate(sorted((r for r in got if r.doc_id is None), key=lambda r: r.slot))]
    assert sorted(r.slot for r in got if r.doc_id == 1) == list(range(20))
    assert S.shard_documents(docs([]), 8).count() == 0
