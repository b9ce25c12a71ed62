"""Chat formatting from event logs.

A log has one row per event: (conv_id, seq, turn, kind, role, text). It is
folded in sequence order: ``open`` starts a turn's message, ``delta`` appends
to it, ``edit`` replaces it, ``regenerate`` empties it and takes back every
later turn that was there before. Which events still count follows from the
last reset of their turn and the last regeneration of an earlier turn, both
small aggregates, so the fold itself splits by (conversation, turn): a
conversation that has a third of all events is folded by many tasks.

A message is rendered as ``<|start|>role<|message|>text<|end|>``. Inside roles
and texts every control string of the list below is broken by a backslash
after its first character, and backslashes are doubled, so what stands between
the marks can be read back exactly and never looks like a mark.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: strings that some chat template gives a meaning to (fixed values)
CONTROL = (START, MESSAGE, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: roles whose text is trained on
LEARNED = ("assistant",)

_OPEN = "([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _OPEN, r"$1\\")


def unescape(s: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", s)


# ------------------------------------------------------------ fold
def fold_events(events: DataFrame) -> DataFrame:
    """Events -> messages (conv_id, turn, role, text).

    ``seq`` orders the events of a conversation; events that tie on it apply
    in the order open, regenerate, edit, delta, then by text. A turn exists
    once it has any event that counts; its role is that of its last event that
    names one, else empty. Null texts are empty, events of another or null
    kind are ignored; a null conv_id is one conversation, and null turns and
    null seqs are the first.
    """
    order = F.create_map(*[F.lit(x) for p in (("open", 0), ("regenerate", 1), ("edit", 2), ("delta", 3)) for x in p])
    at = F.struct(F.col("seq").alias("seq"), order[F.col("kind")].alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    e = events.where(F.col("kind").isin("open", "delta", "edit", "regenerate")).select(
        "conv_id", "turn", "kind", "role", at.alias("at"))
    reset = F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("reset")
    redone = F.max(F.when(F.col("kind") == "regenerate", F.col("at.seq"))).alias("redone")
    turns = e.groupBy("conv_id", "turn").agg(reset, redone)
    # regenerations of earlier turns: one small row per turn
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("redone").over(before)).drop("redone")
    turns = turns.withColumnsRenamed({"conv_id": "of_conv", "turn": "of_turn"})
    alive = e.join(turns, F.col("conv_id").eqNullSafe(F.col("of_conv")) & F.col("turn").eqNullSafe(F.col("of_turn"))).where(
        (F.col("reset").isNull() | (F.col("at") >= F.col("reset"))) & (F.col("cut").isNull() | (F.col("at.seq") > F.col("cut"))))
    parts = F.sort_array(F.collect_list("at"))
    return alive.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


#: seq of what comes after all drafts of a conversation
_REWRITES = 1 << 61


def events_of(conversations: DataFrame, delta_chars: int = 256, rewrites: bool = False, learned=LEARNED) -> DataFrame:
    """A log that folds to the rows (conv_id, turn, role, text): an ``open``
    event per row and the text as streamed deltas of ``delta_chars`` characters.
    Turns are numbered anew by turn, role and text, so that rows that tie on
    the turn stay apart.

    With ``rewrites`` the conversation is first streamed as drafts. Then every
    turn of a learned role is regenerated, which takes back all later turns,
    and streamed again; every other one is opened again and its first deltas
    come as an edit.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.ceil(F.length("text") / delta_chars)
    cuts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>"))
    base = F.lit(_REWRITES if rewrites else 0).cast("long")
    again = F.lit(rewrites) & F.coalesce(F.col("role").isin(*learned), F.lit(False))

    def event(at, kind, text):
        return F.struct(at.alias("at"), kind.alias("kind"), text.alias("text"))

    deltas = F.transform(cuts, lambda i: event(
        base + i + 1, F.when(F.lit(rewrites) & ~again & (i == 0), F.lit("edit")).otherwise(F.lit("delta")), F.substr(F.col("text"), (i * delta_chars + 1).cast("int"), F.lit(delta_chars))))
    first = [event(base, F.when(again, F.lit("regenerate")).otherwise(F.lit("open")), F.lit(""))]
    if rewrites:
        zero = F.lit(0).cast("long")
        first = [event(zero, F.lit("open"), F.lit("")), event(zero + 1, F.lit("delta"), F.concat(F.lit("draft of "), F.substring("text", 1, delta_chars))), *first]
    x = rows.withColumn("e", F.explode(F.concat(F.array(*first), deltas)))
    return x.select("conv_id", (F.col("turn") * F.lit(1 << 32) + F.col("e.at")).alias("seq"), "turn", F.col("e.kind").alias("kind"),
                    F.when(F.col("e.kind") != "delta", F.col("role")).alias("role"), F.col("e.text").alias("text"))


# ------------------------------------------------------------ render
def render(messages: DataFrame, learned=LEARNED) -> DataFrame:
    """Messages -> (conv_id, turn, formatted, mask_start, mask_chars): the
    formatted conversation is its segments in order of turns. The loss mask of
    a segment is the characters of its escaped text, for learned roles; it is
    empty for others."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit(MESSAGE))
    learn = F.coalesce(F.col("role").isin(*learned), F.lit(False))
    return messages.select("conv_id", "turn", F.concat(head, text, F.lit(END)).alias("formatted"),
                           F.length(head).cast("long").alias("mask_start"),
                           F.when(learn, F.length(text)).otherwise(0).cast("long").alias("mask_chars"))


def parse(segment: str) -> list[tuple[str, str]]:
    """(role, text) of the messages of a formatted text."""
    out, at = [], 0
    while at < len(segment):
        middle = segment.index(MESSAGE, at)
        end = segment.index(END, middle)
        if not segment.startswith(START, at):
            raise ValueError("not a formatted conversation")
        out.append((unescape(segment[at + len(START):middle]), unescape(segment[middle + len(MESSAGE):end])))
        at = end + len(END)
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Segments -> one row per conversation: conv_id, n_turns, turns_sha256
    (of role, line end, text, line end per turn), loss_chars and loss_sha256
    (of all unescaped text under the mask) and formatted_chars.

    Turns stream through the task of their conversation in order; it keeps two
    running digests and one message, however long the conversation is.
    """
    kind = formatted.schema["conv_id"].dataType

    class Sums:
        def __init__(self, conv):
            self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text, start, chars):
            self.chars += len(text)
            for role, body in parse(text):
                self.n += 1
                self.turns.update(f"{role}\n{body}\n".encode())
            learned = unescape(text[start:start + chars])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        sums, types = None, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = []
            for conv, text, start, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if sums is None or conv != sums.conv:
                    if sums is not None:
                        rows.append(sums.row())
                    sums = Sums(conv)
                sums.add(text, start, chars)
            yield table(rows)
        if sums is not None:
            yield table([sums.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "formatted", "mask_start", "mask_chars")
    out = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    return ordered.mapInArrow(run, out)
