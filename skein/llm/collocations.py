"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are phrases of N - 1 words, an edge is a phrase of N words (the longest
that are asked for) and joins the nodes of its first and of its last N - 1
words; its weight is how often it occurs. Only these longest phrases are
counted in the texts. Every place of a text starts one edge, or, near the end
of its piece, a shorter rest: the flow out of a node plus the rests that equal
it is the node's count, and in the same way a shorter phrase counts what all
nodes and rests that begin with it count.

Nodes whose whole count comes in by one edge and leaves by one edge are unary:
paths over them are compacted to one string of words with one weight. All
phrases inside of such a path have its weight; the ends of paths have counts
of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import lookup, pieces
from skein.session import cut_lineage

MAX_WORDS, MIN_COUNT, PERCENT, FIRST, SCALE = 3, 10, 50, 2000, 1_000_000
#: text whose phrases are counted together before the shuffle
SLICE_BYTES = 4 << 20
#: rows of an Arrow batch that a task returns
BATCH_ROWS = 1 << 14
#: a word with more than 1/HOT of a language's words is frequent
HOT = 1000
#: tasks that share the edges of a frequent word
SALTS = 64
#: language of texts that have none
NO_LANGUAGE = "und"

# A-Z lower-cased, the characters that end a piece, and tab as a space
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEAN = bytes.maketrans(_UPPER + _PIECE_ENDS + b"\t", _UPPER.lower() + b"\n" * len(_PIECE_ENDS) + b" ")


def numbered(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """The words of the texts as numbers from 1 on with 0 between pieces, and
    the words by number (the first is number 1)."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    nothing, end = number[b""], number[b"\n"]
    parts = [np.array([end])]
    for t in texts:
        tokens = t.encode().translate(_CLEAN).replace(b"\n", b" \n ").split(b" ")
        parts += [np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)), np.array([end])]
    every = np.concatenate(parts)
    return every[every != nothing] - 1, list(number)[2:]


def grams(words: np.ndarray, n: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """What every place starts, counted: for r = 1 .. n the numbers of the
    first, second, ... word of each different phrase of r words (r < n: up to
    the end of its piece; n: any), and how often each occurs."""
    padded = np.concatenate((words, np.zeros(n, np.int64)))
    at = np.flatnonzero(words)
    columns, alive = [], np.ones(len(at), bool)
    for i in range(n):
        column = np.where(alive, padded[at + i], 0)
        alive = column > 0
        columns.append(column)
    code, size, base = np.zeros(len(at), np.int64), 1, int(words.max(initial=0)) + 1
    for column in columns:
        if size * base >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code, size = code * base + column, size * base
    _, first, often = np.unique(code, return_index=True, return_counts=True)
    columns = [c[first] for c in columns]
    length = sum((c > 0).astype(np.int64) for c in columns) if len(first) else np.empty(0, np.int64)
    return [([c[length == r] for c in columns[:r]], often[length == r]) for r in range(1, n + 1)]


def _by_language(part: pa.RecordBatch):
    """(language, texts) of a slice."""
    held: dict[str, list[str]] = {}
    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
        if text:
            held.setdefault(NO_LANGUAGE if lang is None else lang, []).append(text)
    return held.items()


def language_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of a few thousand words at most per language, with every
    word that is more than 1 / HOT of all its words, and of all words of the
    language (a null word). A slice reports the words that are more than
    1 / (2 HOT) of its own: there a frequent word has half of its share."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, SLICE_BYTES):
                for lang, texts in _by_language(part):
                    numbers, words = numbered(texts)
                    often = np.bincount(numbers, minlength=len(words) + 1)[1:]
                    top = np.flatnonzero(often * 2 * HOT > often.sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * (len(top) + 1)), pa.array([None, *(words[i].decode() for i in top)], pa.string()),
                        pa.array([int(often.sum()), *often[top].tolist()], pa.int64())], names=["lang", "word", "n"])

    counted = docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("word").isNull(), F.col("n"))).over(Window.partitionBy("lang"))
    return counted.withColumn("all", total).where(F.col("word").isNull() | (F.col("n") * 2 * HOT > F.col("all"))).select("lang", "word", "n")


def edges(docs: DataFrame, max_words: int, hot: dict[str, set[bytes]]) -> DataFrame:
    """(lang, word, salt, often, lines): the edges and rests that begin with a
    word, counted per slice: a line for the words that follow, and its count.

    All that begins with a word meets at one (lang, word, salt). A frequent
    word (``hot``) is spread by the word that follows, and where that is
    frequent too, by the next one as well: its own count, and that of the two
    words, have parts at several salts, all else is whole at one."""

    def lines(lang, words, found, busy, codes):
        names = pa.array(words, pa.binary()).cast(pa.string())
        first, salt, times, line = [], [], [], []
        for numbers, often in found:
            if not len(often):
                continue
            u, *tail = [c - 1 for c in numbers]
            code, wide = (codes[tail[0]], busy[tail[0]]) if tail else (np.zeros(len(u), np.int64), np.ones(len(u), bool))
            more = codes[tail[1]] if len(tail) > 1 else np.zeros(len(u), np.int64)
            spread = np.where(wide, 1 + SALTS + (31 * code + more) % SALTS, 1 + code % SALTS)
            first.append(u)
            salt.append(np.where(busy[u], spread, 0))
            rest = [names.take(pa.array(c)) for c in tail]
            line.append(pc.binary_join_element_wise(*rest, " ") if len(rest) > 1 else rest[0] if rest else pa.array([""] * len(u)))
            times.append(often)
        if not first:
            return None
        first, salt = np.concatenate(first), np.concatenate(salt)
        order = np.lexsort((salt, first))
        key = (first * (2 * SALTS + 1) + salt)[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = pa.array(np.append(at, len(key)).astype(np.int32))
        held = pa.ListArray.from_arrays(ends, pa.concat_arrays(line).take(pa.array(order)))
        times = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times)[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(at)), names.take(pa.array(first[order[at]])), pa.array(salt[order[at]].astype(np.int32)),
            times, pc.binary_join(held, "\n")], names=["lang", "word", "salt", "often", "lines"])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, SLICE_BYTES):
                for lang, texts in _by_language(part):
                    numbers, words = numbered(texts)
                    own = hot.get(lang, set())
                    busy = np.fromiter((w in own for w in words), bool, len(words))
                    codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
                    made = lines(lang, words, grams(numbers, max_words), busy, codes)
                    for i in range(0, made.num_rows if made else 0, BATCH_ROWS):
                        yield made.slice(i, BATCH_ROWS)

    return docs.mapInArrow(run, "lang string, word string, salt int, often array<int>, lines string").repartition("lang", "word", "salt")


def _summed(code: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the sum of ``often`` of each."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(often[order], first)


def _flows(part: pa.RecordBatch, max_words: int, min_count: int) -> list[pa.RecordBatch]:
    """(lang, phrase, k, n) of all that begins with the words of ``part``, which
    has every row of its (lang, word, salt): a phrase counts the edges that
    begin with it and the rests that equal it."""
    _, lang, word, salt, often, lines = part.columns
    lang, word = lang.dictionary_encode(), word.dictionary_encode()
    salt = salt.to_numpy().astype(np.int64)
    key = (word.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()) * (2 * SALTS + 1) + salt
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    group = np.repeat(group, pc.list_value_length(often).to_numpy())
    tail = pc.split_pattern(lines, "\n").flatten().dictionary_encode()
    at, often = tail.indices.to_numpy().astype(np.int64), often.flatten().to_numpy().astype(np.int64)
    tail = tail.dictionary
    length = np.where(pc.equal(tail, "").to_numpy(zero_copy_only=False), 0, pc.count_substring(tail, " ").to_numpy() + 1)
    made = []
    for j in range(max_words):  # phrases of j words after the first
        begins = tail.filter(pa.array(length >= j))
        if not j:
            begins = pa.repeat("", len(begins))
        elif j < max_words - 1:
            begins = pc.binary_join(pc.list_slice(pc.split_pattern(begins, " "), 0, j), " ")
        begins = begins.dictionary_encode()
        if not len(begins):
            break
        code = np.full(len(tail), -1, np.int64)
        code[length >= j] = begins.indices.to_numpy()
        code = code[at]
        own = code >= 0
        code, n = _summed(group[own] * len(begins.dictionary) + code[own], often[own])
        row, code = first[code // len(begins.dictionary)], code % len(begins.dictionary)
        # a frequent word's own count, and that of two frequent words, have parts at several salts
        keep = (n >= min_count) | (salt[row] > 0) & (j == 0) | (salt[row] > SALTS) & (j == 1)
        row, code, n = pa.array(row[keep]), pa.array(code[keep]), n[keep]
        words = word.dictionary.take(word.indices.take(row))
        made.append(pa.RecordBatch.from_arrays([
            lang.dictionary.take(lang.indices.take(row)), pc.binary_join_element_wise(words, begins.dictionary.take(code), " ") if j else words,
            pa.array(np.full(len(n), j + 1, np.int32)), pa.array(n)], names=["lang", "phrase", "k", "n"]))
    return pa.Table.from_batches(made).combine_chunks().to_batches()


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, hot: dict[str, set[bytes]] | None = None) -> DataFrame:
    """(lang, phrase, k, n): how often every phrase of 1 to ``max_words`` words
    occurs, for those with ``min_count`` or more. ``docs`` has lang and text;
    ``hot`` (frequent words by language) only spreads the work."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the hashes that are not complete
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1]))
            if held and (cut or held[-1].column(0)[-1].as_py() != h[-1]):
                yield from counted([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from counted([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from counted(held)

    def counted(parts):
        return _flows(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], max_words, min_count)

    # rows of one (lang, word, salt) have one hash, so they come together
    row = edges(docs, max_words, hot or {}).select(F.xxhash64("lang", "word", "salt").alias("h"), "lang", "word", "salt", "often", "lines")
    flow = row.sortWithinPartitions("h").mapInArrow(run, "lang string, phrase string, k int, n long")
    return flow.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _first(phrase, k):
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(k))


def _last(phrase, k):
    return F.call_function("substring_index", phrase, F.lit(" "), -F.lit(k))


def compact_paths(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, words array, n): the edges of the graph with paths over unary
    nodes joined to one. An edge follows another if their common node has the
    weight of both; pointers to earlier edges are doubled until all have
    reached the head of their path. Some edge of a path starts a piece, so
    paths never close to rings."""
    node = counts.where(F.col("k") == max_words - 1).select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    edge = cut_lineage(counts.where(F.col("k") == max_words).select("lang", "phrase", "n"))
    out = edge.select("lang", _first(F.col("phrase"), max_words - 1).alias("node"), F.col("phrase").alias("after"), F.col("n").alias("flow"))
    into = edge.select("lang", _last(F.col("phrase"), max_words - 1).alias("node"), F.col("phrase").alias("before"), F.col("n").alias("flow"))
    # equal flows leave no room for another edge, so each side has one row per node
    steps = cut_lineage(node.join(out, ["lang", "node", "flow"]).join(into, ["lang", "node", "flow"]).select("lang", F.col("after").alias("phrase"), "before"))
    reach = edge.join(steps, ["lang", "phrase"], "left").select(
        "lang", "phrase", "n", F.coalesce("before", "phrase").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"))
    moved = None
    while True:
        reach = cut_lineage(reach)
        before, moved = moved, reach.agg(F.sum("place")).first()[0]
        if before == moved:
            break
        # heads of paths point to themselves at no distance
        jump = reach.select("lang", F.col("phrase").alias("head"), F.col("head").alias("to"), F.col("place").alias("more")).where("more > 0")
        reach = reach.join(jump, ["lang", "head"], "left").select("lang", "phrase", "n", F.coalesce("to", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
    rest = F.sort_array(F.collect_list(F.when(F.col("place") > 0, F.struct("place", _last(F.col("phrase"), 1).alias("word")))))
    return reach.groupBy("lang", "head").agg(rest.alias("rest"), F.max("n").alias("n")).select(
        "lang", F.concat(F.split("head", " "), F.col("rest.word")).alias("words"), "n")


def candidates(counts: DataFrame, max_words: int = MAX_WORDS, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, k, n) of the phrases of two words or more that are not
    inside a longer candidate with at least ``percent`` of their count. A
    longer candidate around a phrase holds one with a single word more that is
    as frequent or more, so only those are looked at."""
    paths = cut_lineage(compact_paths(counts, max_words))
    size = F.size("words")
    at = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))
    edge = paths.select("lang", F.explode(at(max_words)).alias("phrase"), "n")
    out = edge.withColumn("k", F.lit(max_words)).select("lang", "phrase", "k", "n")
    longer = None
    for k in range(max_words - 1, 1, -1):
        own = counts.where(F.col("k") == k)
        if k == max_words - 1:
            # inner nodes of a path have its weight, so an edge covers them
            inner = paths.where(size > max_words).select("lang", F.explode(F.slice(at(k), F.lit(2), size - max_words)).alias("phrase"))
            own = own.join(inner, ["lang", "phrase"], "left_anti")
            longer = paths.select("lang", F.explode(F.array(F.struct(F.array_join(F.slice("words", 1, k), " ").alias("p"), "n"), F.struct(
                F.array_join(F.slice("words", -k, k), " ").alias("p"), "n"))).alias("e")).select("lang", "e.p", "e.n")
        else:
            above = counts.where(F.col("k") == k + 1)
            longer = above.select("lang", F.explode(F.array(_first(F.col("phrase"), k), _last(F.col("phrase"), k))).alias("p"), "n")
        cover = longer.groupBy("lang", F.col("p").alias("phrase")).agg(F.max("n").alias("over"))
        own = own.join(cover, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("n") * percent))
        out = out.unionByName(own.select("lang", "phrase", "k", "n"))
    return out


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the cut with the least score of every
    phrase, ties to the shortest first part. Scores are exact decimals."""
    cuts = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    split = found.select("lang", "phrase", "k", F.col("n").alias("a"), cuts.alias("cut"))
    split = cut_lineage(split.select("lang", "phrase", "a", "cut", _first(F.col("phrase"), F.col("cut")).alias("left"), _last(F.col("phrase"), F.col("k") - F.col("cut")).alias("right")))
    total = split.count()
    for side, name in (("left", "l"), ("right", "r")):
        # a frequent word is a part of many phrases
        used = split.groupBy(F.struct("lang", F.col(side).alias("phrase")).alias("key")).agg(F.count("*").alias("uses"))
        parts = used.join(counts.select(F.struct("lang", "phrase").alias("key"), F.col("n").alias(name)), "key")
        split = lookup(split.withColumn("key", F.struct("lang", F.col(side).alias("phrase"))), parts, "key", "uses", total).drop("key", "uses")
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide("a") * wide("a"), wide("l") * wide("r"))
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return split.groupBy("lang", "phrase").agg(F.max("a").alias("a"), least).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 percent: int = PERCENT, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of every
    language, by score, count (both falling) and phrase in byte order.

    Words, pieces and formulas are those of this module's constants. Documents
    without a language are one of their own (``NO_LANGUAGE``); null and empty
    texts have no words; a language without a phrase that is frequent enough
    has no rows, like an empty table. Repeated rows count each. A text of any
    length is counted whole. Other columns are not read.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    src = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    words = cut_lineage(language_words(src))
    hot: dict[str, set[bytes]] = {}
    for r in words.where("word IS NOT NULL").select("lang", "word").collect():  # under 2 HOT words of a language
        hot.setdefault(r["lang"], set()).add(r["word"].encode())
    sizes = words.where("word IS NULL").select("lang", F.col("n").alias("all"))  # one row per language
    counts = cut_lineage(phrase_counts(src, max_words, min_count, hot))
    ranked = scored(candidates(counts, max_words, percent), counts)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.join(F.broadcast(sizes), "lang").select(
        F.col("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), F.col("score").cast("long").alias("score"))
