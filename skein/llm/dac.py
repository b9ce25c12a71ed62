"""Token files of directly addressable codes.

An id is split into bytes, lowest first. Level 0 has the first byte of every
token and a bitmap that tells which ids continue; level 1 the second byte of
those, and so on. A rank directory counts the continuing ids before every 512
bits, so any token, or run of tokens, is found by one rank per level, without
decoding what stands before it.

A shard file is: magic, then little-endian u64: number of tokens, number of
levels, and for each level its number of entries and the places of its bytes,
its bitmap and its directory; then these sections.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections import defaultdict
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import SPACE, pieces
from skein.llm.files import Reader, fresh, make_folder, opened
from skein.session import scratch_path

MAGIC = b"DACTOK01"
#: bits that one entry of a rank directory covers
BLOCK = 512
#: tokens after which a task starts another shard; a longer document has its own
SHARD_TOKENS = 1 << 23
#: parts of words whose ids a worker remembers
REMEMBERED = 600_000
#: tokens read from a shard at once where documents follow each other
RUN_TOKENS = 1 << 20


# ------------------------------------------------------------ file format
def encode_shard(ids: np.ndarray) -> bytes:
    """The file of these ids (unsigned, up to 32 bits)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    at, head, body = len(MAGIC) + 16 + 32 * len(levels), [], []
    for n, *sections in levels:
        places = []
        for s in sections:
            pad = -at % 8
            body.append(b"\0" * pad + s)
            places.append(at + pad)
            at += pad + len(s)
        head.append(struct.pack("<4Q", n, *places))
    return MAGIC + struct.pack("<2Q", len(ids), len(levels)) + b"".join(head) + b"".join(body)


class Shard:
    """Random access to the tokens of an open shard file."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(len(MAGIC) + 16, 0)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.n, n_levels = struct.unpack("<2Q", head[len(MAGIC):])
        table = file.read_at(32 * n_levels, len(MAGIC) + 16)
        self.levels = [struct.unpack_from("<4Q", table, 32 * i) for i in range(n_levels)]

    def rank(self, level: int, i: int) -> int:
        """Continuing ids of a level before its entry ``i``."""
        n, _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        if i >= n and n % BLOCK == 0:  # behind the last block
            if not n:
                return 0
            i, block = n, n // BLOCK - 1
        before, = struct.unpack("<Q", self.file.read_at(8, directory + 8 * block))
        bits = np.unpackbits(np.frombuffer(self.file.read_at(BLOCK // 8, bitmap + block * BLOCK // 8), np.uint8), bitorder="little")
        return before + int(bits[:i - block * BLOCK].sum())

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count``."""
        if start < 0 or count < 0 or start + count > self.n:
            raise IndexError("beyond the file")
        out = np.zeros(count, np.uint32)
        slots = np.arange(count)
        for level, (_, data, bitmap, _) in enumerate(self.levels):
            if not len(slots):
                break
            n = len(slots)
            out[slots] |= np.frombuffer(self.file.read_at(n, data + start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            bits = np.unpackbits(np.frombuffer(self.file.read_at((start + n + 7) // 8 - first, bitmap + first), np.uint8), bitorder="little")
            more = bits[start - 8 * first:start - 8 * first + n].astype(bool)
            start = self.rank(level, start) if more.any() else 0
            slots = slots[more]
        return out


# ------------------------------------------------------------ tokenising
#: steps that treat the strings between white space each by itself
APART = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
#: pre-tokenizers, and a pattern of pieces to keep, that drop all white space
DROPS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
KEEPS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_fit(model: bytes) -> bool:
    """Whether the ids of a text are those of its strings between white space:
    true only where each step of the tokenizer is known to allow it."""
    spec = json.loads(model)

    def steps(kind, inner):
        step = spec.get(kind)
        return [] if step is None else step[inner] if step["type"] == "Sequence" else [step]

    def apart(s):
        return s["type"] in APART or s["type"] == "Replace" and (s["pattern"], s["content"]) == ({"Regex": r"\s+"}, " ")

    def drops(s):
        return s["type"] in DROPS or s["type"] == "Split" and (s["pattern"], s["behavior"], s["invert"]) == ({"Regex": KEEPS}, "Removed", True)

    def inside(s):
        return drops(s) or s["type"] in ("Digits", "Punctuation") or s["type"] == "ByteLevel" and not s["add_prefix_space"]

    first, *more = steps("pre_tokenizer", "pretokenizers") or [None]
    return (first is not None and drops(first) and all(map(inside, more)) and all(map(apart, steps("normalizer", "normalizers")))
            and not any(c.isspace() for t in spec.get("added_tokens") or [] for c in t["content"]))


# Printable ASCII and the Latin letters before the later additions to Unicode's
# case tables: NFC leaves them alone, and they are lower-cased one by one (but
# for a dotted I, which becomes two characters)
_PLAIN = [chr(i) for i in (*range(0x21, 0x7F), *range(0xA1, 0x220)) if i not in (0xAD, 0x130)]


def _class(kind: str) -> str:
    """Characters of a category among which are the lower-case forms of plain ones."""
    return "".join(re.escape(chr(i)) for i in range(0x21, 0x300) if unicodedata.category(chr(i))[0] == kind)


_parts = re.compile(KEEPS.replace(r"\s", re.escape(SPACE)).replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N"))).findall
# bytes that are not printable stand as characters from 256 on
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def parts_fit(model: bytes) -> bool:
    """Whether the tokenizer's steps before its model are those that ``Words``
    takes over for plain words: NFC, lower case, ``KEEPS`` and bytes as characters."""
    spec = json.loads(model)
    steps = [s["type"] for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for s in (spec.get(k) or {}).get(inner, [])]
    return (words_fit(model) and steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and spec["model"]["type"] == "BPE"
            and not spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"] and not spec["model"].get("dropout"))


class Merges:
    """Byte pair merges of many parts of words at once: their symbols are one
    flat array, and each round merges the leftmost occurrences of the pair of
    least rank of every part, until no pair remains."""

    NONE = np.int64(1) << 40

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        shown = [chr(_BYTE_CHARS.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab[c + x] for c in shown], np.int64) for x in ("", end))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.wide = max(vocab.values()) + 1
        pair = np.array([vocab[x] * self.wide + vocab[y] for x, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.rank = np.argsort(pair, kind="stable")
        self.pair, self.made = pair[self.rank], made[self.rank]

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty parts, and the number of ids of each."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        raw, of = np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), size)
        sym, place, ends = self.inner[raw], np.arange(len(raw)), np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        seg, done = of, []
        while len(sym):
            key = sym[:-1] * self.wide + sym[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            ranks = np.full(len(sym), self.NONE)
            hit = (self.pair[at] == key) & (seg[:-1] == seg[1:])
            ranks[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            mine = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(sym))))
            open_ = mine < self.NONE
            done.append((place[~open_], sym[~open_]))
            i = np.flatnonzero((ranks == mine) & open_)
            # of a run of overlapping occurrences every other one, from the left
            run = np.concatenate(([True], np.diff(i) > 1))
            i = i[(i - np.maximum.accumulate(np.where(run, i, 0))) % 2 == 0]
            sym[i] = self.made[at[i]]
            open_[i + 1] = False
            sym, seg, place = sym[open_], seg[open_], place[open_]
        place, sym = (np.concatenate(c) for c in zip(*done)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(place)
        return sym[order].astype("<u4"), np.bincount(of[place], minlength=len(parts))


class Texts:
    """Ids of whole texts, by any tokenizer."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for t in texts for e in self.tokenizer.encode_batch_fast([t or ""], add_special_tokens=False)]


class Words(Texts):
    """Ids of texts, by a tokenizer whose words never reach over white space (``words_fit``).

    A text becomes its parts: where the tokenizer's steps are known and its
    characters are plain (``parts_fit``), what the model itself gets; else the
    strings between white space, marked by a space. The ids of up to
    ``REMEMBERED`` parts are kept in flat arrays; when they are full, those
    stay that several slices had, and of these the ones that most slices had.
    """

    def __init__(self, model: bytes):
        super().__init__(model)
        spec = json.loads(model)
        self.merges = Merges(spec["model"]) if parts_fit(model) else None
        # added tokens are found before all other steps
        starts = {t["content"][0] for t in spec.get("added_tokens") or []}
        plain = "".join(re.escape(c) for c in _PLAIN if c not in starts)
        self.plain = re.compile(f"[{plain}{re.escape(SPACE)}]*").fullmatch
        self.at: dict[str, int] = {}
        self.start = self.size = self.hits = np.empty(0, np.int64)
        self.flat = np.empty(0, "<u4")

    def cut(self, text: str) -> list[str]:
        if self.merges and self.plain(text):
            return _parts(text.lower())
        # str.split would also split at other white space
        words = [w.decode() for w in text.encode().split()]
        if not self.merges:
            return [" " + w for w in words]
        return list(chain.from_iterable(_parts(w.lower()) if self.plain(w) else (" " + w,) for w in words))

    def encode(self, texts: list) -> list[bytes]:
        # parts of the slice are numbered in a small table of its own, and only
        # different ones meet the large one
        number: dict[str, int] = defaultdict(count().__next__)
        of, n_parts = [], []
        for t in texts:
            parts = self.cut(t or "")
            of += map(number.__getitem__, parts)
            n_parts.append(len(parts))
        at = self.places(list(number))
        part = np.array(of, np.int64)
        size = self.size[at][part]
        ends = np.cumsum(size)
        tokens = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at][part] - ends + size, size)].tobytes()
        ends = 4 * np.concatenate(([0], ends))[np.cumsum([0, *n_parts])]
        return [tokens[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def places(self, parts: list[str], full: bool = False) -> np.ndarray:
        """Places of different parts in the arrays; unknown ones are learnt.
        Those of one slice fit whatever their number."""
        at = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        if not full and len(self.at) + len(new) > REMEMBERED:
            self.forget()
            return self.places(parts, full=True)
        if len(new):
            names = [parts[i] for i in new.tolist()]
            ids, sizes = self.learn(names)
            at[new] = len(self.at) + np.arange(len(new))
            self.at.update(zip(names, at[new].tolist()))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
            self.size, self.hits = np.concatenate((self.size, sizes)), np.concatenate((self.hits, np.zeros(len(new), np.int64)))
            self.flat = np.concatenate((self.flat, ids))
        self.hits[at] += 1
        return at

    def forget(self) -> None:
        often = 2
        while (self.hits >= often).sum() > REMEMBERED // 2:
            often *= 2
        stay = np.flatnonzero(self.hits >= often)
        names = list(self.at)
        size = self.size[stay]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[stay] - ends + size, size)]
        self.start, self.size, self.hits = ends - size, size, np.ones(len(stay), np.int64)
        self.at = {names[i]: k for k, i in enumerate(stay.tolist())}

    def learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the parts, and the number of ids of each."""
        whole = np.fromiter((p[0] == " " for p in parts), bool, len(parts))
        if not whole.any():
            return self.merges.encode([p.encode() for p in parts])
        sizes, found = np.zeros(len(parts), np.int64), []
        for group in np.split(np.flatnonzero(whole), np.arange(4096, whole.sum(), 4096)):
            strings = [parts[i][1:] for i in group.tolist()]
            e = self.tokenizer.encode(" ".join(strings), add_special_tokens=False)
            cuts = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), np.cumsum([0, *(len(w) + 1 for w in strings)]))
            sizes[group] = np.diff(cuts)
            found.append(np.array(e.ids, "<u4"))
        order = np.flatnonzero(whole)
        if not whole.all():
            rest = np.flatnonzero(~whole)
            ids, sizes[rest] = self.merges.encode([parts[i].encode() for i in rest.tolist()])
            found.append(ids)
            order = np.concatenate((order, rest))
        # from the order of learning to the order of the parts
        flat, size = np.concatenate(found), sizes[order]
        start = np.empty(len(parts), np.int64)
        start[order] = np.cumsum(size) - size
        ends = np.cumsum(sizes)
        return flat[np.arange(len(flat)) + np.repeat(start - ends + sizes, sizes)], sizes


_ENCODERS: dict[bytes, Texts] = {}


def encoder_of(model: bytes, by_words: bool) -> Texts:
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = (Words if by_words else Texts)(model)
    return _ENCODERS[model]


# ------------------------------------------------------------ tables
def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write the texts' ids in ascending id order and return the index:
    (id, path, at, n_tokens, start), ``at`` in the file and ``start`` over all.

    Each document ends with ``end_id``, so a null or empty text has one token.
    Null ids come first; rows that tie on the id are ordered by text. The
    texts are shuffled once, by ranges of ids; a task writes its range as
    shards of at most ``SHARD_TOKENS`` tokens (or one document). The index is
    a table in the same folder. Any tokenizer file will do: where white space
    could matter to the ids, texts are encoded whole, which takes longer. Its
    truncation and padding are not applied.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    make_folder(folder)
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    model, by_words = spark.sparkContext.broadcast(content), words_fit(content)
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task, seq, ids, rows, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal seq, ids, rows, size
            path = fresh(folder, ".dac")
            files, local = opened(path)
            with files.open_output_stream(local, compression=None) as out:
                out.write(encode_shard(np.frombuffer(b"".join(ids), "<u4")))
            doc, at, n = pa.concat_arrays([r[0] for r in rows]), *(np.concatenate([r[i] for r in rows]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([doc, pa.array([path] * len(n)), pa.array(np.full(len(n), task, np.int32)), pa.array(np.full(len(n), seq, np.int32)),
                                              pa.array(at), pa.array(n)], names=["id", "path", "task", "seq", "at", "n_tokens"])
            seq, ids, rows, size = seq + 1, [], [], 0

        for batch in batches:
            for part in pieces(batch, 1):
                made = [x + end for x in encoder_of(model.value, by_words).encode(part.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in made], np.int64)
                done = 0
                while done < len(n):
                    fits = max(int(np.searchsorted(np.cumsum(n[done:]), SHARD_TOKENS - size, "right")), 0 if size else 1)
                    if fits:
                        own = n[done:done + fits]
                        rows.append((part.column(0).slice(done, fits), size + np.cumsum(own) - own, own))
                        ids += made[done:done + fits]
                        size += int(own.sum())
                        done += fits
                    if done < len(n):
                        yield from flush()
        if rows:
            yield from flush()

    out = T.StructType([T.StructField("id", kind), T.StructField("path", T.StringType()), T.StructField("task", T.IntegerType()),
                        T.StructField("seq", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())])
    ordered = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, out).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    # tokens before each shard: one row per file
    shards = index.groupBy("task", "seq").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return index.join(shards.select("task", "seq", before.alias("before")), ["task", "seq"]).select(
        "id", "path", "at", "n_tokens", (F.col("before") + F.col("at")).alias("start"))


def read_tokens(index: DataFrame) -> DataFrame:
    """(id, path, at, n_tokens, ...) -> the same and ``tokens``: the document's
    ids as little-endian unsigned 32-bit integers, read from its file."""
    cols = index.columns

    def run(batches):
        reader, shard = Reader(), None
        try:
            for batch in batches:
                for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                    tokens, rows, i = [], list(zip(*(part.column(cols.index(c)).to_pylist() for c in ("path", "at", "n_tokens")))), 0
                    while i < len(rows):
                        # documents that follow each other in a file are read together
                        path, first, n = rows[i]
                        j = i + 1
                        while j < len(rows) and rows[j][0] == path and rows[j][1] == first + n and n + rows[j][2] <= RUN_TOKENS:
                            n, j = n + rows[j][2], j + 1
                        if path != reader.uri:
                            shard = Shard(reader.of(path))
                        run = shard.tokens(first, n).astype("<u4").tobytes()
                        tokens += [run[4 * (at - first):4 * (at - first + own)] for _, at, own in rows[i:j]]
                        i = j
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.binary())], names=[*cols, "tokens"])
        finally:
            reader.close()

    near = index.repartition("path").sortWithinPartitions("path", "at")
    return near.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("tokens", T.BinaryType())]))
