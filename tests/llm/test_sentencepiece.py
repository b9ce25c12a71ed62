import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from skein.llm import sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " \n", "a\n", "<s>", "</s> <0x0A>", "▁", "▁▁a", " a", "a ", "a  b", "a \n\n b", "a" * 500, "\x00\x85 x", "字😀ü" * 9, "0123 456"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.read_model(PATH))


def same(codec, lib, texts):
    ids, n = codec.encode(texts)
    want = [lib.encode(t or "") for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert codec.decode(ids, n) == [lib.decode(w) for w in want]


def test_equals_the_library(codec, lib, texts, monkeypatch):
    same(codec, lib, ODD)
    rng = random.Random(3)
    alphabet = list("abcdeéthe   \n\n.,▁▁12😀字ü\t\x00<s>") + ["the", "ing", "  "]
    for _ in range(40):
        same(codec, lib, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(20)])
    monkeypatch.setattr(S, "REMEMBERED", 500)
    for at in range(0, len(texts), 25):
        same(codec, lib, [t for _, t in texts[at:at + 25]])


def test_decodes_any_ids_like_the_library(codec, lib):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int32), np.array([len(ids)])) == [lib.decode(ids)], ids


def test_early_pieces_merge_one_at_a_time():
    c = S.Codec(S.read_model(PATH))
    assert c.early.any()  # the vocabulary has pieces for which rounds must take care


def test_operator(spark, docs, lib):
    rows = list(enumerate([*ODD, None, "word " * 60_000])) + [(None, "null id"), (0, "")]
    df = docs(rows)
    out = S.encode_decode(df, PATH)
    assert out.columns == [c for c in df.columns if c != "ids"] + ["ids", "decoded"]
    for r in out.collect():
        want = lib.encode(r.text or "")
        assert r.ids == want and r.decoded == lib.decode(want)
    again = S.decode_ids(out.select("doc_id", "ids"), PATH)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.select("doc_id", "decoded").collect()))
    assert S.encode_decode(docs([]), PATH).count() == 0
    assert S.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()[0].decoded == ""


def test_query_equals_the_library(spark, texts, lib):
    import hashlib

    import __spark_entry__ as E

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {tuple(r) for r in E.queries()["op6_sentencepiece"](spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(d, len(w), sha(",".join(map(str, w))), sha(lib.decode(w))) for d, t in texts for w in [lib.encode(t or "")]}
