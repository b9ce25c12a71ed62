"""All stages of the pipeline against plain Python on each stage's own input."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline as P
import pytest
import sentencepiece
from test_line_dedup import brute
from test_mixing import plain_targets
from test_quality import brute_cover
from test_simhash import plain_components, plain_fingerprint

from skein.llm import quality as Q
from skein.llm import simhash as S

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abdeilnorstué") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    common = [line(6) for _ in range(5)]
    texts = ["\n".join([line(rng.randint(3, 20)) for _ in range(rng.randint(2, 9))] + rng.sample(common, 2)) for _ in range(40)]
    base = " ".join(f"word{i}" for i in range(6000))
    passage = line(60)
    texts += [base, base.replace("word200 ", "changed "), base.upper() + "\n" + line(3), "too short", "spam ham " * 40, f"{line(900)} {passage} and {passage}", None, "", f"  {line(30)}\n\n {line(30)}\t"]
    sources = ["web", "books", "code", None]
    rows = [(i * 7 % 101, t, "en", sources[i * i % 11 % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, line(40) + "\n" + common[0], "fr", "web", 1)]


def plain_quality(rows):
    def kept(text):
        n = len((text or "").encode().split())
        share = lambda w: 100 * len(brute_cover(text or "", w))
        return n >= Q.MIN_WORDS and share(Q.BASE_WINDOW) <= Q.BASE_PERCENT * n and share(Q.MIN_REPEAT) <= Q.MAX_PERCENT * n and not share(Q.MAX_REPEAT + 1)

    return [r for r in rows if kept(r[1])]


def plain_lines(rows):
    other = {r[0]: r[2:4] for r in rows}
    return [(d, t, *other[d], len(t)) for d, t, _, _ in brute([r[:2] for r in rows])]


def plain_near(rows):
    ids = [r[0] for r in rows]
    names, root = plain_components(ids, [plain_fingerprint(r[1]) for r in rows], S.MAX_BITS)
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] == names[root[i]]]


def plain_mix(rows):
    n = lambda r: len((r[1] or "").encode().split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n(r)
    target, out = plain_targets(sizes), []
    key = lambda r: hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
    for source, size in sizes.items():
        epochs, left = divmod(int(target[source] + 0.5), size)
        for r in sorted((r for r in rows if r[3] == source), key=key):
            cut, left = min(n(r), left), max(left - n(r), 0)
            texts = [r[1]] * (epochs + (cut == n(r))) + (["".join(re.findall(r"[ \t-\r]*[^ \t-\r]+", r[1])[:cut])] if 0 < cut < n(r) else [])
            out += [(r[0], t, r[2], r[3], len(t)) for t in texts]
    return out


def plain_pieces(rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = [(r, lib.encode(r[1])) for r in rows]
    return [(r[0], r[3], len(ids), ids, sha(",".join(map(str, ids))), sha(lib.decode(ids))) for r, ids in coded]


@pytest.fixture
def ran(spark, tmp_path, monkeypatch):
    """(stage, its input's columns and rows) of one run, and what comes out."""
    seen = []

    def recorded(name, stage):
        def run_stage(spark, docs, sf_dir):
            seen.append((name, docs.columns, [tuple(r) for r in docs.collect()]))
            return stage(spark, docs, sf_dir)

        return name, run_stage

    spark.createDataFrame(rows_of(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "STAGES", [recorded(*s) for s in P.STAGES])
    out = P.run(spark, str(tmp_path))
    return [*seen, ("end", out.columns, [tuple(r) for r in out.collect()])]


def test_each_stage_equals_plain_python_on_its_input(ran):
    plain = {"quality_rules": plain_quality, "line_dedup": plain_lines, "simhash_near_dedup": plain_near, "source_mixing": plain_mix, "sentencepiece": plain_pieces}
    assert [name for name, _, _ in ran] == [*plain, "end"]  # in this order
    assert sorted(ran[0][2], key=repr) == sorted(rows_of(), key=repr)
    for (name, columns, rows), (_, after, got) in zip(ran, ran[1:]):
        assert columns == COLUMNS and after == (COLUMNS if name != "sentencepiece" else ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        assert sorted(got, key=repr) == sorted(plain[name](rows), key=repr), name
        assert name == "sentencepiece" or sorted(got, key=repr) != sorted(rows, key=repr), name  # the stage had something to do
