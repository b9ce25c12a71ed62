import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from skein.llm import url_filter as U


def test_hosts_paths_and_rules(spark):
    cases = {
        "HTTP://A.Org/x?q#f": ("a.org", "/x", "org/", "allow"),
        "http://a.org": ("a.org", "", None, None),
        "http://a.org?x/": ("a.org", "", None, None),
        "https://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://m.example.org/en/12#t": ("m.example.org", "/en/12", "example.org/en/1", "block"),
        "https://myexample.org/es/1": ("myexample.org", "/es/1", "org/", "allow"),
        "https://x.com/FR/": ("x.com", "/FR/", None, None),
        "https://x.com/fr/a?b": ("x.com", "/fr/a", "com/fr/", "allow"),
        "https://com/de/": ("com", "/de/", "com/de/", "block"),
        "a://b://c.org/d": ("b:", "//c.org/d", None, None),
        "no scheme.org/": ("", "", None, None),
        "://": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://É.ORG/\nx": ("É.org", "/\nx", "org/", "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(None, "http://a.org/"), (0, None)], "page_id long, url string")
    out = U.url_verdicts(df.selectExpr("*", "'clash' AS host", "1 AS score")).collect()
    assert len(out) == len(cases) + 2
    got = {r.page_id: r for r in out if r.page_id}
    for i, (url, (host, path, rule, verdict)) in enumerate(cases.items()):
        if i:
            r = got[i]
            assert (r.host, r.path, r.rule) == (host, path, rule), url
            assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
            if not url:
                assert r.score is None and r.verdict == "allow"
    empty = U.url_verdicts(df.limit(0))
    assert empty.count() == 0


def brute_ratio(accepted, rejected, order):
    def model(urls):
        n, kinds, total = Counter(), defaultdict(set), Counter()
        for u in urls:
            s = U.PAD * order + u
            for i in range(order, len(s)):
                for k in range(order + 1):
                    ctx = s[i - k:i]
                    n[ctx, s[i]] += 1
                    kinds[ctx].add(s[i])
                    total[ctx] += 1

        def p(ctx, c):
            lower = p(ctx[1:], c) if ctx else U.UNSEEN
            return (n[ctx, c] + len(kinds[ctx]) * lower) / (total[ctx] + len(kinds[ctx])) if total[ctx] else lower

        return p

    a, r = model(accepted), model(rejected)

    def score(u):
        s = U.PAD * order + u
        return sum(math.log(a(s[i - order:i], s[i])) - math.log(r(s[i - order:i], s[i])) for i in range(order, len(s))) / len(u)

    return score


def test_scores_equal_a_plain_model_and_separate_hosts(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    urls = []
    for _ in range(150):
        urls.append(f"http://{word('aeio')}.org/{word('aeio')}")
        urls.append(f"http://{word('xzqk')}.com/de/{word('xzqk')}")
    urls += ["http://aeioae.net/ioaeio", "http://xzqkxz.net/qkxzqk", "é😀", "b"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS html")
    held = {r.url for r in df.selectExpr("url", f"pmod(xxhash64(lower(regexp_extract(url, '://([^/]*)', 1))), {U.HELD_OUT}) = 0 AS h").where("h").collect()}
    score = brute_ratio([u for u in urls if ".org/" in u and u not in held], [u for u in urls if "/de/" in u and u not in held], U.ORDER)
    for r in U.url_verdicts(df).collect():
        u = urls[r.page_id]
        assert abs(r.score - score(u)) < 1e-9, u
        if "aeioae.net" in u:
            assert r.verdict == "allow" and r.rule is None
        if "xzqkxz.net" in u:
            assert r.verdict == "block" and r.rule is None


def test_calibration():
    assert U.calibrate([]) == (1.0, 0.0)
    assert U.calibrate([(10, 5, 0)]) == (1.0, 0.0)
    mid = U.BINS // 2
    slope, offset = U.calibrate([(mid - 200, 1, 50), (mid + 100, 30, 2), (mid + 300, 20, 0)])
    at = lambda b: 1 / (1 + math.exp(-(slope * (-U.CLIP + (b + .5) * 2 * U.CLIP / U.BINS) + offset)))
    assert slope > 0 and at(mid - 200) < 0.2 and at(mid + 300) > 0.8


def fold(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return (h - (1 << 64) * (h >> 63)) % U.HELD_OUT


@pytest.mark.parametrize("host", ["www.example.org", "m.example.org", "one url"])
def test_a_class_on_one_host_trains_and_calibrates(spark, host):
    # every blocked URL is on the host: in the held-out fold of hosts, outside it, or the same URL
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    accepted = [f"http://{word('aeio')}.org/{word('aeio')}" for _ in range(80)]
    rejected = ["http://www.example.org/es/xzqkxz"] * 60 if host == "one url" else [f"http://{host}/es/{word('xzqk')}" for _ in range(60)]
    assert fold("www.example.org") == 0 and fold("m.example.org") != 0
    probes = ["http://aeioae.net/ioaeio", "http://www.example.net/es/xzqkxz"]
    urls = accepted + rejected + probes
    out = {r.page_id: r for r in U.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(out) == len(urls)

    def parts(members):
        of = Counter(map(fold, members))
        if len(of) == 1:
            return members, members
        held = min(of, key=lambda f: (of[f], f))
        return [u for u in members if fold(u) != held], [u for u in members if fold(u) == held]

    (train_a, held_a), (train_r, held_r) = parts(accepted), parts(rejected)
    score = brute_ratio(train_a, train_r, U.ORDER)
    bins = Counter()
    for c, members in enumerate((held_a, held_r)):
        for u in members:
            bins[min(max(math.floor((score(u) + U.CLIP) / (2 * U.CLIP / U.BINS)), 0), U.BINS - 1), c] += 1
    slope, offset = U.calibrate([(b, bins[b, 0], bins[b, 1]) for b in sorted({b for b, _ in bins})])
    assert (slope, offset) != (1.0, 0.0)
    for i, u in enumerate(urls):
        assert abs(out[i].score - score(u)) < 1e-9, u
        assert abs(out[i].p_accept - 1 / (1 + math.exp(-(slope * score(u) + offset)))) < 1e-6, u
    assert [out[len(urls) - 2 + i].verdict for i in (0, 1)] == ["allow", "block"]


def test_held_folds():
    assert U.held_folds([("allow", 0, 1, 5), ("allow", 1, 1, 5), ("block", 0, 2, 1), ("block", 3, 2, 9)]) == ("host_fold", {"allow": 0, "block": 0})
    # most of a class in fold 0, or none of it
    assert U.held_folds([("allow", 0, 1, 5), ("allow", 1, 3, 6), ("block", 0, 2, 9), ("block", 3, 4, 1)]) == ("url_fold", {"allow": 1, "block": 4})
    assert U.held_folds([("allow", 0, 1, 5), ("allow", 1, 3, 4), ("block", 1, 2, 9)]) == ("url_fold", {"allow": 3, "block": None})
