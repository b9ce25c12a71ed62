"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Misra-Gries (Spark's frequent-items sketch, ``approx_top_k``) names candidate
digests in one pass; an exact recount verifies them; the verified winners (at
most ``2 * HOT``) are broadcast, so rows of frequent digests are settled in
the task that reads them. All other digests take an ordinary shuffle, in which
no group has more than ``1 / HOT`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower
from skein.session import cut_lineage

#: a digest with more than 1/HOT of all rows is frequent
HOT = 500
#: counters of the sketch: its error is under rows / (2 * HOT), so each
#: frequent digest is among the 2 * HOT candidates it returns
COUNTERS = 16384


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the
    empty text. Of equal texts the row with the largest id stays (``kept``);
    a null id is smaller than any other. Of rows that tie on the largest id
    exactly one is kept. ``keep_id`` is the id of the row that stays, so null
    only where every equal text has a null id. An empty table gives no rows;
    other columns are not carried.
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), 256))
    # row ids are fixed by the checkpoint, which every later step reads
    rows = cut_lineage(docs.select(docs[id_col].alias("id"), digest.alias("digest")).withColumn("row", F.monotonically_increasing_id()))

    best = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "row")).alias("best")
    sketch = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(hex(digest), {2 * HOT}, {COUNTERS})").alias("top"))
    candidates = sketch.select("n", F.explode("top").alias("t")).select("n", F.unhex("t.item").alias("digest"))
    winners = cut_lineage(
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest").agg(best, F.count("*").alias("size"), F.first("n").alias("n"))
        .where(F.col("size") * HOT > F.col("n"))
        .select("digest", "best", "size")
    )
    settled = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "id", "row", best_over(group), F.count("*").over(group).alias("size"))
    out = settled.select("digest", "id", "row", "best", "size").unionByName(rest)
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def best_over(group):
    return F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "row")).over(group).alias("best")
