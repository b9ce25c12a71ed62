"""Quality rules with suffix-array repetition.

Words are the symbols. A partition's documents are handled some megabytes at
a time: one suffix array (prefix doubling over flat numpy arrays, only tied
positions are sorted again) covers all documents of a slice, whose suffixes
never tie across documents. Longest common prefixes of neighbours, found by
descent through the doubling ranks, form a tree of intervals; those whose
suffixes follow different words are the maximal repeats. Their spans are
merged per document. No shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import map_texts

#: words of a repeat that counts for the base rule
BASE_WINDOW = 5
#: fewest words; most percent of words in repeated base windows
MIN_WORDS, BASE_PERCENT = 10, 20
#: words of the shortest repeat that the method covers
MIN_REPEAT = 10
#: most percent of the words that repeats may cover; longest repeat, in words
MAX_PERCENT, MAX_REPEAT = 15, 50

SYMBOLS = "#*$%&|<>"


def suffix_array(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the documents' words and the ranks of each doubling.

    ``ranks[j][i]`` is equal for two positions of a document exactly when the
    2**j words from them on are equal and lie inside the document, or both
    positions are the same. Ranks are slots of the array, from 1; 0 is what
    lies beyond the end.
    """
    n = len(word)
    key = doc.astype(np.int64) * (int(word.max()) + 1 if n else 1) + word
    sa = np.argsort(key, kind="stable")
    start = np.ones(n, bool)
    start[1:] = key[sa][1:] != key[sa][:-1]
    rank = np.empty(n + 1, np.int32)  # a slice has fewer words
    rank[n] = 0
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(1, n + 1, dtype=np.int32), 0))
    ranks, h = [rank], 1
    while True:
        alone = start & np.append(start[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa, ranks
        pos = sa[slots]
        nxt = np.minimum(pos + h, n)
        inside = (nxt < n) & (doc[np.minimum(nxt, n - 1)] == doc[pos])
        second = np.where(inside, rank[nxt], 0)
        first = rank[pos]
        order = np.lexsort((second, first))
        pos, first, second = pos[order], first[order], second[order]
        sa[slots] = pos
        new = np.ones(len(pos), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        # truncated substrings never equal another one of their document
        new[1:] |= second[1:] == 0
        start[slots] = new
        rank = rank.copy()
        rank[pos] = np.maximum.accumulate(np.where(new, slots + 1, 0))
        ranks.append(rank)
        h *= 2


def neighbour_prefixes(sa: np.ndarray, ranks: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, words) of the neighbours in the suffix array, slot and slot + 1,
    that share ``least`` words or more."""
    n = len(sa)
    level = min(int(least).bit_length() - 1, len(ranks) - 1)
    if 1 << level <= least:  # neighbours that share fewer words can't reach it
        at = np.flatnonzero(ranks[level][sa[1:]] == ranks[level][sa[:-1]])
    else:
        at = np.arange(n - 1)
    i, j, size = sa[at], sa[at + 1], np.zeros(len(at), np.int64)
    i, j = i.copy(), j.copy()
    for k in range(len(ranks) - 1, -1, -1):
        # equal ranks of different positions: these words are all inside the document
        same = ranks[k][i] == ranks[k][j]
        same &= (i < n) & (j < n)
        step = same.astype(np.int64) << k
        size += step
        i = np.minimum(i + step, n)
        j = np.minimum(j + step, n)
    keep = size >= least
    return at[keep], size[keep]


def prefix_intervals(at: list[int], size: list[int]) -> tuple[list, list, list, list, list]:
    """The tree of longest-common-prefix intervals: for each one its value, its
    first and last slot and its parent (-1: none); and for each pair of
    neighbours the interval whose value it has."""
    value, first, last, parent, of_pair, stack, before = [], [], [], [], [], [], -2

    def close():
        i = stack.pop()
        last[i] = before + 1
        parent[i] = stack[-1] if stack else -1
        return i

    for slot, n in zip(at, size):
        lo, child = slot, -1
        if slot != before + 1:
            while stack:
                close()
        while stack and value[stack[-1]] > n:
            child = close()
            lo = first[child]
        if not stack or value[stack[-1]] < n:
            if child >= 0:
                parent[child] = len(value)
            stack.append(len(value))
            value.append(n)
            first.append(lo)
            last.append(lo)
            parent.append(-1)
        of_pair.append(stack[-1])
        before = slot
    while stack:
        close()
    return value, first, last, parent, of_pair


def longest_repeats(word: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each word, the length of the longest maximal repeat of its document
    that starts there, 0 where it is under ``least`` words.

    An interval's suffixes share its value and no more; the repeat is maximal
    if the words before them differ. Where they don't, the interval one word
    earlier has all its occurrences, and its own suffixes go to the nearest
    maximal interval around it.
    """
    n = len(word)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    sa, ranks = suffix_array(word, doc)
    at, size = neighbour_prefixes(sa, ranks, least)
    del ranks
    if not len(at):
        return best
    value, first, last, parent, of_pair = (np.array(x, np.int64) for x in prefix_intervals(at.tolist(), size.tolist()))
    # the word before each suffix; one that starts its document differs from all
    before = np.where((sa > 0) & (doc[sa - 1] == doc[sa]), word[sa - 1], -1 - np.arange(n))
    turns = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    length = np.where(turns[last] > turns[first], value, -1)
    while True:  # up the tree
        open_ = np.flatnonzero((length < 0) & (parent >= 0))
        if not len(open_):
            break
        length[open_], parent[open_] = length[parent[open_]], parent[parent[open_]]
    length = np.maximum(length, 0)[of_pair]
    np.maximum.at(best, sa[at], length)
    np.maximum.at(best, sa[at + 1], length)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more."""
    at = np.flatnonzero(best >= least)
    edge = np.zeros(len(best) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge[:-1]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def measure(texts: list, min_repeat: int = MIN_REPEAT) -> dict[str, list]:
    """Counts of the rules for each text (null: no word); see quality_rules."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    flat: list[int] = []
    n_words, chars, symbols, dup_lines = [], [], [], []
    for text in texts:
        text = text or ""
        words = text.encode().split()
        flat += map(ids.__getitem__, words)
        n_words.append(len(words))
        chars.append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        dup_lines.append(len(lines) - len(set(lines)))
    word = np.array(flat, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    best = longest_repeats(word, doc, min(BASE_WINDOW, min_repeat))
    ends = np.cumsum(n_words)
    base, wide, found = covered(best, BASE_WINDOW), covered(best, min_repeat), np.flatnonzero(best >= min_repeat)

    def per_doc(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[ends] - total[ends - np.array(n_words, np.int64)]).tolist() if len(ends) else []

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[found], best[found])
    span_lists = [[] for _ in texts]
    for d in np.unique(doc[found]):
        lo = ends[d] - n_words[d]
        span_lists[d] = spans(wide[lo:ends[d]])
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": per_doc(base),
            "covered_words": per_doc(wide), "longest_repeat": longest.tolist(), "spans": span_lists}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def quality_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_repeat: int = MIN_REPEAT,
                  max_percent: int = MAX_PERCENT, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and, for each row,

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words in 5-word
    windows found twice or more), covered_words (words in repeats of at least
    ``min_repeat`` words), longest_repeat (words of the longest one, else 0),
    repeat_spans (its merged word spans: start, end), base_failed (under 10
    words, or over 20 % repeated) and kept: not base_failed, at most
    ``max_percent`` of the words covered, no repeat over ``max_repeat`` words.

    A null or empty text has no word, so it fails the base rule. Rows are
    judged by themselves: ids may be null or repeat. Very long texts are
    handled whole, one at a time. An empty table gives no rows. Input columns
    named like an added one give way.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [(c, T.LongType()) for c in COUNTS] + [("repeat_spans", span), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def kernel(texts):
        m = measure(texts, min_repeat)
        failed = [n < MIN_WORDS or 100 * r > BASE_PERCENT * n for n, r in zip(m["n_words"], m["n_repeat_words"])]
        kept = [not f and 100 * c <= max_percent * n and x <= max_repeat for f, c, x, n in zip(failed, m["covered_words"], m["longest_repeat"], m["n_words"])]
        out = [[{"start": a, "end": b} for a, b in s] for s in m["spans"]]
        return [*(m[c] for c in COUNTS), pa.array(out, arrow_span), failed, kept]

    return map_texts(docs, text_col, kernel, added, keep)
