"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key. Within a source, documents are ranged
by that key: its first ``DIGITS`` hex digits name one of 16**DIGITS ranges of
equal width, which hold equal shares of any source, also of one that has a
third of all rows. Range totals, their running sums per source and a window
inside each range give every document the words before it; the source's budget
cuts there, after as many whole epochs as it asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import SPACE, SPACE_CLASS, lookup, n_words
from skein.session import cut_lineage

#: hex digits of the key that name a range: 4,096 ranges per source
DIGITS = 3
#: weights of the sources in code-point order, repeating
WEIGHTS = (5, 2, 1)
#: most epochs of a source
EPOCHS = 3
#: names and keys of cut points that are broadcast as one table
POINT_BYTES = 8 << 20


def source_targets(per_source: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(src, source_size) -> (src, source_size, target).

    Sources in code-point order, null last, take the weights in turn. They
    share the sum of all sizes by weight; a target stops at ``epochs`` times
    its source's size and the excess is shared again by weight until no target
    is above: the stopped sources are those whose cap per weight lies under the
    water level, found with running sums over the caps per weight. One row per
    source is sorted here, never documents.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    pos = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(epochs))
    level = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (ranked.withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
         .withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("all_w", F.sum("weight").over(everything))
         .withColumn("cum_cap", F.sum("cap").over(upto)).withColumn("cum_w", F.sum("weight").over(upto)))
    stopped = F.col("cum_cap") + F.col("ratio") * (F.col("all_w") - F.col("cum_w")) < F.col("total")
    t = (t.withColumn("stopped", stopped)
         .withColumn("s_cap", F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0.0)).over(everything))
         .withColumn("s_w", F.sum(F.when(F.col("stopped"), F.col("weight")).otherwise(0.0)).over(everything)))
    water = F.col("weight") * ((F.col("total") - F.col("s_cap")) / F.nullif(F.col("all_w") - F.col("s_w"), F.lit(0.0)))
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(F.least(F.col("cap"), water))
    return t.select("src", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _ranges(rows: DataFrame, weights, epochs: float) -> DataFrame:
    """(__no, __src, __range, size) -> per source and range its words ``n``,
    the words ``before`` it, and the source's size and target."""
    ranges = rows.groupBy("__no", "__src", "__range").agg(F.sum("size").alias("n"))
    per_source = ranges.groupBy("__no", "__src").agg(F.sum("n").alias("source_size"))
    targets = source_targets(
        per_source.select(F.when(~F.col("__no"), F.col("__src")).alias("src"), "source_size"), weights, epochs
    ).select(F.col("src").isNull().alias("__no"), F.coalesce("src", F.lit("")).alias("__src"), "source_size", "target")
    before = F.sum("n").over(Window.partitionBy("__no", "__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return ranges.withColumn("before", before).join(targets, ["__no", "__src"])


def _keys(docs: DataFrame, id_col: str, source_col: str, seed: str) -> list[Column]:
    """__no and __src, null-free join keys of the source (a flag and the name), and __key."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))))
    return [docs[source_col].isNull().alias("__no"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("__src"), key.alias("__key")]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        size: Column | str | None = None, seed: str = "mix", weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and taken (words).

    ``size`` (default: words of the text, null: 0) is what targets count.
    ``taken`` is size times the whole epochs of the source, plus what the
    remaining budget reaches in key order: the document on which the budget
    ends is cut there, so a source's taken words are its target rounded to a
    whole number. Null sources are one source. The order is by key, id and
    size, all derived from the row, so reruns agree; rows that tie on all of
    them are alike in every column this adds. Input columns named like an
    added one give way. A document without words takes none.
    """
    added = ["size", "source_size", "target", "taken"]
    size = n_words(docs[text_col]) if size is None else (docs[size] if isinstance(size, str) else size)
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], size.cast("long").alias("size"), *_keys(docs, id_col, source_col, seed),
                       docs[id_col].alias("__id")).withColumn("__range", F.substring("__key", 1, DIGITS))
    offsets = _ranges(rows, weights, epochs).drop("n")
    within = Window.partitionBy("__no", "__src", "__range").orderBy("__key", "__id", "size")
    placed = (rows.join(offsets, ["__no", "__src", "__range"])
              .withColumn("__start", F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = budget - whole * F.col("source_size") - F.col("__start")
    taken = F.col("size") * whole + F.greatest(F.lit(0), F.least(F.col("size"), part))
    return placed.select(*[placed[f"`{c}`"] for c in kept], "size", "source_size", "target", taken.cast("long").alias("taken"))


def cut_points(sized: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(__no, __src, __key, size) -> one row per source that has words: its
    rows ``n``, the ``__whole`` epochs it is taken, and the ``__at`` key on which
    the rest of its budget ends, with ``__left`` words still to take there.

    Only the range of keys in which a budget ends is looked at row by row, and
    its rows are summed by key first.
    """
    sized = sized.withColumn("__range", F.substring("__key", 1, DIGITS))
    whole = F.floor(F.round("target").cast("long") / F.col("source_size"))
    held = (F.col("__part") >= F.col("before")) & (F.col("__part") < F.col("before") + F.col("n"))
    cut = (_ranges(sized, weights, epochs).where("source_size > 0").withColumn("__whole", whole)
           .withColumn("__part", F.round("target").cast("long") - F.col("__whole") * F.col("source_size"))
           .where(held).select("__no", "__src", "__range", "__whole", "__part", "before"))
    by_key = Window.partitionBy("__no", "__src").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    near = (sized.join(cut, ["__no", "__src", "__range"]).groupBy("__no", "__src", "__whole", "__part", "before", "__key").agg(F.sum("size").alias("n"))
            .withColumn("before", F.col("before") + F.sum("n").over(by_key) - F.col("n")).where(held))
    rows = sized.groupBy("__no", "__src").agg(F.count("*").alias("n"))
    return near.select("__no", "__src", "__whole", F.col("__key").alias("__at"), (F.col("__part") - F.col("before")).alias("__left")).join(rows, ["__no", "__src"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    seed: str = "mix", weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as
    its taken words hold it (``mix``); the one on which a budget ends is cut
    after the word that fills it. Documents without words are never taken, an
    empty table gives no rows.

    Texts stay where they are: keys and sizes settle one cut point per source,
    and a document is before, at or after it. The cut points go to the documents by
    broadcast while their names and keys are under ``POINT_BYTES``, else those
    of sources with more than a thousandth of all rows do (fewer than a
    thousand) and the others meet theirs in a shuffle. Only documents at a cut
    point, one per source where ids are unique, are put in order, by size.
    """
    cols, keys = docs.columns, _keys(docs, id_col, source_col, seed)
    sized = cut_lineage(docs.select(*keys, n_words(docs[text_col]).alias("size")))
    points = cut_lineage(cut_points(sized, weights, epochs))
    total = sized.count()
    held = points.agg(F.coalesce(F.sum(F.octet_length("__src") + 64), F.lit(0))).first()[0]
    has_words = F.btrim(docs[text_col], F.lit(SPACE)) != ""
    rows = docs.where(has_words).select(*[docs[f"`{c}`"] for c in cols], *keys).withColumn("__source", F.struct("__no", "__src"))
    points = points.select(F.struct("__no", "__src").alias("__source"), "__whole", "__at", "__left", "n")
    m = rows.join(F.broadcast(points), "__source") if held <= POINT_BYTES else lookup(rows, points, "__source", "n", total)
    clear = m.where("__key != __at").withColumn("__cut", F.explode(F.array_repeat(F.lit(0).cast("long"), (F.col("__whole") + (F.col("__key") < F.col("__at")).cast("long")).cast("int"))))
    size = Window.partitionBy("__source").orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    at = (m.where("__key = __at").withColumn("__size", n_words(F.col(text_col)))
          .withColumn("__rest", F.least(F.col("__size"), F.greatest(F.lit(0), F.col("__left") - F.sum("__size").over(size) + F.col("__size")))))
    copies = F.array_repeat(F.lit(0).cast("long"), (F.col("__whole") + (F.col("__rest") == F.col("__size")).cast("long")).cast("int"))
    part = (F.col("__rest") > 0) & (F.col("__rest") < F.col("__size"))
    at = at.withColumn("__cut", F.explode(F.concat(copies, F.when(part, F.array("__rest")).otherwise(F.array().cast("array<long>")))))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+"), F.lit(0)), F.lit(1), F.col("__cut").cast("int"))
    at = at.withColumn(text_col, F.when(F.col("__cut") > 0, F.array_join(words, "")).otherwise(F.col(text_col)))
    return clear.select(*[F.col(f"`{c}`") for c in cols]).unionByName(at.select(*[F.col(f"`{c}`") for c in cols]))
