"""URL filter: host and path rules, and a character language-model ratio.

URLs that a rule allows or blocks train two variable-order Markov models of
characters. A character's probability interpolates all orders up to ``ORDER``
by Witten-Bell weights, so it follows the longest contexts that the class has
seen. A URL's score is its log-likelihood difference (accepted - rejected) per
character. Scores of held-out labelled hosts (of held-out URLs where a class has
too few hosts) calibrate it: a logistic curve of the score gives the probability
of acceptance.

Everything is counted over all URLs: characters with their contexts are
exploded once per URL, counted per distinct string, and lower orders come from
the counts of the next higher one. The log ratio of every distinct string is
found by joins along that tower, and URLs look it up: strings with more than a
thousandth of all characters by broadcast (fewer than a thousand), the others
by a shuffle in which none is large.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import UPPER, lookup
from skein.session import cut_lineage

#: characters of the longest context
ORDER = 4
#: what precedes a URL's first character in its contexts
PAD = "\x02"
#: probability of any character where nothing is known
UNSEEN = 1 / 256
#: one of so many hosts (or URLs) with a rule is held out for calibration
HELD_OUT = 5
#: bins of the calibration's histogram, between -CLIP and CLIP
BINS, CLIP = 4096, 8.0
#: log ratios are added as whole multiples of 1 / SCALE, in any order alike
SCALE = 1e9
#: least calibrated probability of acceptance of an allowed URL
ACCEPT = 0.5

#: verdicts of the rules, whose URLs train a model each
CLASSES = ("allow", "block")
#: (verdict, host, path) of the rules
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty where the url is null or has no ://"""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)"))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string (null: none fits) and its verdict; the longest rule wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones come first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def strings(url: str = "url", order: int = ORDER) -> Column:
    """Array of each character with the ``order`` ones before it."""
    padded = F.concat(F.lit(PAD * order), F.col(url))
    n = F.length(url)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(padded, i, F.lit(order + 1))))


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n_a, n_r, uses): counts of strings of ``order + 1`` characters in
    accepted and rejected training URLs and in all URLs -> (gram, uses, ratio):
    log P(last | others, accepted) - log P(last | others, rejected)."""
    levels = {order: grams}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("n_a").alias("n_a"), F.sum("n_r").alias("n_r"), F.sum("uses").alias("uses"))
    known = None
    for k in range(order + 1):
        of_context = Window.partitionBy("context")
        t = levels[k].withColumn("context", F.substring("gram", 1, k)).withColumn("shorter", F.expr("substring(gram, 2)"))
        for c in "ar":
            t = t.withColumn(f"all_{c}", F.sum(f"n_{c}").over(of_context)).withColumn(f"kinds_{c}", F.sum((F.col(f"n_{c}") > 0).cast("long")).over(of_context))
        if known is None:
            t = t.withColumn("q_a", F.lit(UNSEEN)).withColumn("q_r", F.lit(UNSEEN))
        else:
            t = t.join(known, "shorter")
        p = {c: F.when(F.col(f"all_{c}") > 0, (F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"q_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"q_{c}")) for c in "ar"}
        t = t.select("gram", "uses", p["a"].alias("p_a"), p["r"].alias("p_r"))
        known = t.select(F.col("gram").alias("shorter"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r"))
    return t.select("gram", "uses", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def calibrate(histogram: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits binned scores (bin,
    accepted, rejected), both classes weighing the same. Without both classes,
    or where the score doesn't rise with acceptance: slope 1, offset 0."""
    total_a, total_r = sum(h[1] for h in histogram), sum(h[2] for h in histogram)
    if not total_a or not total_r:
        return 1.0, 0.0
    # soft targets keep the curve finite where the classes don't overlap
    hi, lo = (total_a + 1) / (total_a + 2), 1 / (total_r + 2)
    points = [(-CLIP + (b + 0.5) * 2 * CLIP / BINS, a / total_a, r / total_r) for b, a, r in sorted(histogram)]

    def loss(s, o):
        return sum(w * (max(z, 0) - z * t + math.log1p(math.exp(-abs(z)))) for x, a, r in points for z in (s * x + o,) for w, t in ((a, hi), (r, lo)))

    slope, offset = 1.0, 0.0
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, a, r in points:
            p = 1 / (1 + math.exp(-max(min(slope * x + offset, 500), -500)))
            d, v = a * (p - hi) + r * (p - lo), (a + r) * max(p * (1 - p), 1e-12)
            g0, g1, h00, h01, h11 = g0 + d * x, g1 + d, h00 + v * x * x, h01 + v * x, h11 + v
        h00, h11 = h00 + 1e-9, h11 + 1e-9
        det = h00 * h11 - h01 * h01
        ds, do = (g0 * h11 - g1 * h01) / det, (g1 * h00 - g0 * h01) / det
        step, now = 1.0, loss(slope, offset)
        while step > 1e-6 and loss(slope - step * ds, offset - step * do) > now:
            step /= 2
        slope, offset = slope - step * ds, offset - step * do
        if abs(step * ds) + abs(step * do) < 1e-9:
            break
    return (slope, offset) if slope > 0 else (1.0, 0.0)


def held_folds(counts: list[tuple[str, int, int, int]]) -> tuple[str, dict[str, int | None]]:
    """(verdict, host fold, URL fold, rows) of the URLs with a rule -> the kind
    of fold that is held out, and each class's held-out fold.

    Host fold 0, if it has some and at most half of each class. Otherwise each
    class's smallest URL fold; None for a class whose URLs are all in one fold
    (mostly copies of one URL): it can't be split, so it trains and calibrates.
    """
    hosts, urls = {c: Counter() for c in CLASSES}, {c: Counter() for c in CLASSES}
    for verdict, host_fold, url_fold, n in counts:
        hosts[verdict][host_fold] += n
        urls[verdict][url_fold] += n
    if all(0 < hosts[c][0] <= hosts[c].total() / 2 for c in CLASSES):
        return "host_fold", dict.fromkeys(CLASSES, 0)
    return "url_fold", {c: min(urls[c], key=lambda f: (urls[c][f], f)) if len(urls[c]) > 1 else None for c in CLASSES}


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER, accept: float = ACCEPT) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score, p_accept.

    ``verdict`` is the rule's; where none fits, ``block`` if the calibrated
    probability ``p_accept`` is under ``accept``, else ``allow``. URLs with no
    rule never train. A null or empty url has no score and no p_accept, and is
    allowed, as there is nothing against it; so is every URL when no URL of one
    class is in the table (its models can't differ by evidence). URLs held out
    for calibration don't train; ``held_folds`` says which, and always leaves
    each class some that do. Repeated rows count as often as they occur; ids
    may be null or repeat. Other columns are not carried.
    """
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("__url"))
    host, path = host_path(F.col("__url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = urls.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("by_rule", verdict)
    # whole hosts are held out if possible, so that their names can't be learnt by heart
    for fold, key in (("host_fold", "host"), ("url_fold", "__url")):
        judged = judged.withColumn(fold, F.pmod(F.xxhash64(key), F.lit(HELD_OUT)).cast("int"))
    judged = cut_lineage(judged.withColumn("row", F.monotonically_increasing_id()))
    labelled = judged.where(F.col("by_rule").isin(*CLASSES) & (F.length("__url") > 0))
    counts = [tuple(r) for r in labelled.groupBy("by_rule", "host_fold", "url_fold").count().collect()]  # at most 2 x 5 x 5 rows
    known = {c[0] for c in counts} == set(CLASSES)
    fold, folds = held_folds(counts)
    held = {c: F.lit(True) if folds[c] is None else F.col(fold) == folds[c] for c in CLASSES}
    trains = {c: (F.col("by_rule") == c) & (F.lit(True) if folds[c] is None else ~held[c]) for c in CLASSES}
    judged = judged.withColumn("held", F.coalesce(*(F.when(F.col("by_rule") == c, held[c]) for c in CLASSES), F.lit(False)))
    judged = judged.withColumn("trains", F.coalesce(*(F.when(trains[c], F.lit(c)) for c in CLASSES)))

    each = judged.select("row", "trains", F.explode(strings("__url", order)).alias("gram"))
    grams = each.groupBy("gram").agg(
        F.count_if(F.col("trains") == "allow").alias("n_a"), F.count_if(F.col("trains") == "block").alias("n_r"), F.count("*").alias("uses"))
    ratios = cut_lineage(log_ratios(cut_lineage(grams), order))
    total = ratios.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    sums = lookup(each.select("row", "gram"), ratios, "gram", "uses", total).groupBy("row").agg(
        (F.sum(F.round(F.col("ratio") * SCALE).cast("long")) / (F.count("*") * SCALE)).alias("score"))
    scored = cut_lineage(judged.join(sums, "row", "left").select("id", "host", "path", "rule", "by_rule", "held", "score"))

    bin_ = F.least(F.greatest(F.floor((F.col("score") + CLIP) / (2 * CLIP / BINS)), F.lit(0)), F.lit(BINS - 1))
    histogram = (scored.where("held AND score IS NOT NULL").groupBy(bin_.alias("bin"))
                 .agg(F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("r")).collect())  # at most BINS rows
    slope, offset = calibrate([tuple(h) for h in histogram])
    p = F.when(F.lit(known), 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(offset)))))
    by_model = F.when(F.col("p_accept") < accept, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("p_accept", p).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score", "p_accept")
