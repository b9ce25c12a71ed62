import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import dac as D

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [200, 256, 70_000, 2 ** 32 - 1])
def test_random_access(n, top):
    rng = np.random.default_rng(n + top)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, top, n), rng.integers(0, 300, n)).astype(np.uint32) if n else np.zeros(0, np.uint32)
    shard = D.Shard(pa.PythonFile(io.BytesIO(D.encode_shard(ids)), mode="r"))
    assert shard.n == n and np.array_equal(shard.tokens(0, n), ids)
    for _ in range(30):
        a = int(rng.integers(0, n + 1))
        k = int(rng.integers(0, n - a + 1))
        assert np.array_equal(shard.tokens(a, k), ids[a:a + k])
    more = ids > 255
    for i in {0, n // 2, n}:
        assert shard.rank(0, i) == int(more[:i].sum())
    with pytest.raises(IndexError):
        shard.tokens(0, n + 1)
    with pytest.raises(ValueError):
        D.Shard(pa.PythonFile(io.BytesIO(b"x" * 100), mode="r"))


def test_words_equal_the_library(lib, texts, monkeypatch):
    rng = random.Random(8)
    odd = ["", " ", "a\x85b c", "It's WE'RE  x's", "é ́e", "<|endoftext|>", "a<|startoftext|>b c", "ΑΣ ΟΔΟΣ.", "字😀ü 12 3a!!?", "İstanbul ﬁ", "Word word, WORD. ÉTÉ été. été, Straße ſ ŉ ǅ ª. . , ., x.. ,x İ. ΣΑΣ. ẞ ɐ K Å"]
    odd += ["".join(rng.choice("aB'sé \t ́12!<|字") for _ in range(40)) for _ in range(200)]
    odd += ["".join(rng.choices(D._PLAIN, k=9)) + rng.choice(["", "'s", "'LL", "\xad", "İ", "\x1c", "\xa0x", "Σ", "<", "e\u0301"]) for _ in range(3000)]
    w = D.Words(open(PATH, "rb").read())
    assert w.merges
    monkeypatch.setattr(D, "REMEMBERED", 300)
    for part in (odd, [t for _, t in texts[:80]], [None]):
        for t, got in zip(part, w.encode(part)):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_tokenizers_for_which_white_space_matters(spark, docs, tmp_path):
    import json

    rows = [(1, "two  spaces\n\nand lines\tof  text "), (2, " leading, WORDS x's"), (3, None), (4, "a b\x0cc <x y> d"), (5, "word " * 600)]
    spec = json.load(open(PATH))
    tokens = [{**spec["added_tokens"][0], "id": 49408, "content": "<x y>"}]
    meta = {"type": "Metaspace", "replacement": "\u2581", "prepend_scheme": "first", "split": True}
    other = {
        "byte level": json.load(open(public_tokenizers.path("byte_bpe_50k.json"))),
        "added": {**spec, "added_tokens": spec["added_tokens"] + tokens},
        "metaspace": {**spec, "pre_tokenizer": meta},
        "strips": {**spec, "normalizer": {"type": "Replace", "pattern": {"String": "\n"}, "content": ""}},
        "none": {**spec, "pre_tokenizer": None},
        "cuts": {**spec, "truncation": {"direction": "Right", "max_length": 7, "strategy": "LongestFirst", "stride": 0}},
        "white space": {**spec, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}},
    }
    assert D.words_fit(open(PATH, "rb").read())
    for name, spec in other.items():
        content = json.dumps(spec).encode()
        assert D.words_fit(content) == (name in ("cuts", "white space")), name
        lib = Tokenizer.from_str(content.decode())
        lib.no_truncation()
        want = {d: lib.encode(t or "", add_special_tokens=False).ids for d, t in rows}
        if name in ("byte level", "cuts"):
            path = tmp_path / f"{name}.json"
            path.write_bytes(content)
            out = D.read_tokens(D.write_tokens(docs(rows), str(path), f"file://{tmp_path}/{name.replace(' ', '-')}")).collect()
            got = {r.id: np.frombuffer(bytes(r.tokens), "<u4").tolist()[:-1] for r in out}
        else:
            got = {d: np.frombuffer(b, "<u4").tolist() for (d, _), b in zip(rows, D.encoder_of(content, D.words_fit(content)).encode([t for _, t in rows]))}
        assert got == want, name


def test_files_round_trip(spark, docs, lib, monkeypatch, tmp_path):
    rng = random.Random(1)
    rows = [(i * 3 % 101, " ".join(rng.choice(["alpha", "beta", "Gamma!", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(101)]
    rows += [(200, None), (201, ""), (None, "null id"), (50, "same id again"), (300, "long " * 50_000)]
    df = docs(rows).repartition(3)
    index = D.write_tokens(df, PATH, f"file://{tmp_path}/t")
    out = D.read_tokens(index).collect()
    assert len(out) == len(rows)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(((r.id, r.start, r.n_tokens, bytes(r.tokens)) for r in out), key=lambda r: r[1]) == want
    assert D.read_tokens(D.write_tokens(docs([]), PATH)).count() == 0


def test_a_task_writes_several_shards(spark, docs, lib, monkeypatch):
    # the limit travels in the kernel's module, so the small one is set there
    rows = [(i, "one two three") for i in range(50)]
    n = len(lib.encode("one two three", add_special_tokens=False).ids) + 1
    src = docs(rows).coalesce(1)

    from pyspark.sql import functions as F

    big = D.write_tokens(src, PATH)
    assert big.select("path").distinct().count() >= 1
    starts = [r.start for r in big.orderBy("start").collect()]
    assert starts == [n * i for i in range(50)]
    assert big.agg(F.sum("n_tokens")).first()[0] == 50 * n


def test_query_equals_the_library(spark, texts, lib):
    import __spark_entry__ as E

    got = {tuple(r) for r in E.queries()["op7_token_files"](spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    want, start = set(), 0
    for d, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
