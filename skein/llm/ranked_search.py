"""Ranked lexical search by the Best Position Algorithm.

The texts are read once: every document becomes its number of terms and the
frequencies of the terms that some query has (an index table in the shared
folder, which also gives the global counts). A task then takes a segment of
that table at a time. For each query term the segment has an impact list
(documents by falling score) and the same postings by document. Lists are read
in parallel from the top; each document met is looked up in all lists of the
query (direct access), which scores it and marks its position in each of them.
The best position of a list is the end of its unbroken run of marked
positions. A document not yet met lies beyond all of them, so no such document
scores more than the sum of the scores there, and a query stops when that sum
is strictly below its k-th score: documents that tie with it are all met.

Segments are independent and global counts make their scores comparable, so
the best of all segments are the best of all documents. The k best found so
far in a task carry over to its next segment.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import pieces
from skein.session import scratch_path

TOP = 20
#: text of the queries that are ranked together (their terms travel in the task closure)
QUERY_BYTES = 1 << 20
#: postings of a segment, about; a longer document has its own
SEGMENT_POSTINGS = 1 << 22
#: positions that the first round reads of every list; each round reads twice as many
FIRST_DEPTH = 32
#: partial rankings of one query that are merged together
MERGE = 64

# ASCII characters that are no part of a term, the weight and the impact formula
_BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
_TERMS = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().lower().translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# ------------------------------------------------------------ index
def term_index(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term, as a written table:
    its number of terms and, for those in ``terms``, number and frequency."""
    number = {t: i for i, t in enumerate(terms)}
    width = max(len(terms), 1)
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                sizes, found = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text) if text else []
                    sizes.append(len(words))
                    own = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    found.append(own[own >= 0] + i * width)
                code, tf = np.unique(np.concatenate(found), return_counts=True)
                sizes = np.array(sizes, np.int64)
                keep = np.flatnonzero(sizes)
                ends = np.searchsorted(code, (keep + 1) * width)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(keep)), pa.array(sizes[keep]), pa.ListArray.from_arrays(offsets, pa.array((code % width).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=out.fieldNames())

    path = scratch_path(docs.sparkSession, "terms")
    docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, out).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


# ------------------------------------------------------------ search
class Segment:
    """Impact lists of some documents, in order of impact and by document."""

    def __init__(self, ids: pa.Array, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.n = ids, len(n)
        doc = np.repeat(np.arange(self.n), lengths)
        impact = impacts(tfs.astype(np.int64), n[doc], n_docs, n_terms)
        by_doc = np.argsort(terms, kind="stable")  # by term, then document
        term, self.doc, self.impact = terms[by_doc].astype(np.int64), doc[by_doc], impact[by_doc]
        self.key = term * self.n + self.doc
        self.by_impact = np.argsort((term << 32) - self.impact, kind="stable")
        self.bounds = np.searchsorted(term, np.arange((int(term[-1]) if len(term) else -1) + 2))
        self.place = np.empty(len(term), np.int64)  # in the order of impact
        self.place[self.by_impact] = np.arange(len(term))
        self.met = np.full(len(term), -1)  # by place: the last query that met the posting
        self.met_doc = np.full(self.n, -1)
        order = pc.array_sort_indices(ids)  # nulls last
        self.rank = np.empty(self.n, np.int64)
        self.rank[np.asarray(order)] = np.arange(self.n)

    def search(self, query: int, terms: np.ndarray, weights: np.ndarray, k: int, known: list[int]) -> list[tuple[int, int]]:
        """The k best (score, document) above 0, or those that can be among the
        k best beside ``known`` scores; best first, ties by id."""
        here = terms < len(self.bounds) - 1
        terms, weights = terms[here], weights[here]
        start, size = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        held = (size > 0) & (weights > 0)
        terms, weights, start, size = terms[held], weights[held], start[held], size[held]
        if not len(terms):
            return []
        best_score, best_doc = np.empty(0, np.int64), np.empty(0, np.int64)
        best = np.zeros(len(terms), np.int64)  # best positions, as counts
        depth, step = 0, FIRST_DEPTH
        while True:
            # sorted access to positions depth .. depth + step of every list
            count = np.clip(size - depth, 0, step)
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(start + depth - ends + count, count)
            docs = np.unique(self.doc[self.by_impact[at]])
            docs = docs[self.met_doc[docs] != query]
            self.met_doc[docs] = query
            depth, step = depth + step, 2 * step
            # direct access to all lists of the query
            key = (terms[:, None] * self.n + docs).ravel()
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[spot] == key
            self.met[self.place[spot[hit]]] = query
            score = (weights[:, None] * np.where(hit, self.impact[spot], 0).reshape(len(terms), -1)).sum(axis=0)
            score, doc = np.concatenate((best_score, score)), np.concatenate((best_doc, docs))
            order = np.flatnonzero(score > 0)
            order = order[np.lexsort((self.rank[doc[order]], -score[order]))][:k]
            best_score, best_doc = score[order], doc[order]
            # best positions: the ends of the unbroken runs of met postings
            best = np.maximum(best, np.minimum(depth, size))
            ahead, probe = best < size, 32
            while ahead.any():
                i = np.flatnonzero(ahead)
                look = best[i][:, None] + np.arange(probe)
                beyond = look >= size[i][:, None]
                met = (self.met[np.where(beyond, 0, start[i][:, None] + look)] == query) & ~beyond
                run = np.where(met.all(axis=1), probe, np.argmin(met, axis=1))
                best[i] += run
                ahead[i] = (run == probe) & (best[i] < size[i])
                probe *= 2
            # no document that is not met yet scores more than this
            last = self.impact[self.by_impact[start + best - 1]]
            threshold = int((weights * np.where(best < size, last, 0)).sum())
            found = sorted([*known, *best_score.tolist()], reverse=True)
            if (best >= size).all() or len(found) >= k and threshold < found[k - 1]:
                return list(zip(best_score.tolist(), best_doc.tolist()))


def _merged(best: list, new: list, k: int) -> list:
    """The k best of (score, id): highest score first, then ids, null last."""
    return sorted(best + new, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k] if new else best


def _ranked(index: DataFrame, queries: list, weights: np.ndarray, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(query, part, id, score): the k best of every task for every query."""
    kind = index.schema["id"].dataType
    out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    asked = []
    for counts in queries:
        t = np.array(sorted(counts), np.int64)
        asked.append((t, weights[t] * np.array([counts[x] for x in t.tolist()], np.int64)))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % MERGE
        best: list[list] = [[] for _ in asked]
        held, postings, kind = [], 0, None

        def search():
            cols = [[b.column(i) for b in held] for i in range(4)]
            ids, terms, tfs = pa.concat_arrays(cols[0]), pa.concat_arrays(cols[2]), pa.concat_arrays(cols[3])
            segment = Segment(ids, pa.concat_arrays(cols[1]).to_numpy(), pc.list_value_length(terms).to_numpy(zero_copy_only=False),
                              terms.flatten().to_numpy(), tfs.flatten().to_numpy(), n_docs, n_terms)
            for q, (t, w) in enumerate(asked):
                got = segment.search(q, t, w, k, [s for s, _ in best[q]])
                best[q] = _merged(best[q], [(s, ids[d].as_py()) for s, d in got], k)

        for batch in batches:
            kind = batch.schema.field(0).type
            upto = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + SEGMENT_POSTINGS - postings, "right")))
                held.append(batch.slice(at, end - at))
                postings, at = postings + int(upto[end - 1]) - before, end
                if postings >= SEGMENT_POSTINGS or at < batch.num_rows:
                    search()
                    held, postings = [], 0
        if held:
            search()
        if kind is not None:
            rows = [(q, s, d) for q, found in enumerate(best) for s, d in found]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[2] for r in rows], kind),
                pa.array([r[1] for r in rows], pa.int64())], names=out.fieldNames())

    return index.mapInArrow(run, out)


def _blocks(items: DataFrame, item_col: str, text_col: str):
    """The queries as lists of (item, text) with about ``QUERY_BYTES`` of text."""
    block, size = [], 0
    for r in items.select(items[item_col].alias("item"), items[text_col].cast("string").alias("text")).toLocalIterator():
        text = r["text"] or ""
        if block and size + len(text) > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item"], text))
        size += len(text)
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k best documents with a score above 0 of
    every row of ``items``, equal scores by ascending id.

    Terms and formulas are those of this module; a term that a query repeats
    counts as often. Null and empty texts have no term: such documents are not
    ranked and not counted, such queries have no rows. Rows that share an id
    are ranked each by itself, and null ids come last among equal scores. Rows
    of ``items`` that share an item are queries of their own. A document of
    any length is one row of the index. Without documents or queries there
    are no rows. Queries are ranked in blocks of ``QUERY_BYTES`` of text.
    """
    spark = docs.sparkSession
    kinds = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
                          T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    out = None
    for block in _blocks(items, item_col, item_text_col):
        counted = [Counter(terms_of(t)) for _, t in block]
        terms = sorted(set().union(*counted))
        number = {t: i for i, t in enumerate(terms)}
        index = term_index(docs, terms, id_col, text_col)
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(terms), np.int64)  # one row per term of the block
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
            df[r["t"]] = r["n"]
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        found = _ranked(index, [{number[t]: c for t, c in q.items()} for q in counted], weights, k, n_docs, n_terms)
        order = [F.desc("score"), F.col("id").asc_nulls_last()]
        # at most MERGE x k rows of a query meet in the last step
        some = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        top = some.withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)],
                                      T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", kinds[0].dataType)]))
        top = top.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = top if out is None else out.unionByName(top)
    return spark.createDataFrame([], kinds) if out is None else out
