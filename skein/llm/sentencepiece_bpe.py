"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text is cut into words at which no vocabulary piece can reach across; words
met before come from a bounded table of the worker. All new words of a slice
are encoded together: their symbols are one flat numpy array, and each round
finds the smallest pair rank of every word (a segmented minimum), merges its
leftmost occurrences at once and compacts the array, until no pair remains.
No shuffle; the model travels with the task.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import map_texts

#: words a worker remembers, per generation: a full one becomes the old one,
#: from which words that come again move on
REMEMBERED = 150_000
SPACE_MARK = "▁"
NONE = np.int64(1) << 40

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Codec:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        kinds = {p.type for p in m.pieces}
        norm = m.normalizer_spec
        if (m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED} or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("needs a BPE model with byte fallback, an identity normaliser with a dummy prefix, and no user-defined or unused pieces")
        pieces = [p.piece for p in m.pieces]
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        if any(re.search("[^▁]▁|\n.|.\n", p, re.S) for p in normal):
            raise ValueError("a piece spans words")
        byte_ids = [0] * 256
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                byte_ids[int(p.piece[1:-1], 16)] = i
        self.byte_ids = np.array(byte_ids, np.int32)
        # symbols: ids of normal pieces, then characters that are no piece, as
        # len(pieces) + code point
        self.n = len(pieces)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.n
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

        def symbol(s):
            return int(self.of_char[ord(s)]) if len(s) == 1 else normal.get(s)

        score = {p: m.pieces[i].score for p, i in normal.items()}
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pair, rank, made, bigrams = [], [], [], set()
        early = set()
        for p, i in normal.items():
            bigrams.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is not None and b is not None:
                    pair.append(a * (self.n + 0x110000) + b)
                    rank.append(rank_of[score[p]])
                    made.append(i)
                # a piece inside this one that is merged later than this one:
                # making it may open a pair that comes first
                for part in (p[:cut], p[cut:]):
                    if part in normal and score[part] <= score[p]:
                        early.add(normal[part])
        order = np.argsort(np.array(pair, np.int64))
        self.pair, self.rank, self.made = np.array(pair, np.int64)[order], np.array(rank, np.int64)[order], np.array(made, np.int64)[order]
        self.early = np.zeros(self.n, bool)
        self.early[list(early)] = True
        self.bigrams = np.array(sorted(ord(a) * 0x110000 + ord(b) for a, b in bigrams), np.int64)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # decoding
        kind = [p.type for p in m.pieces]
        self.is_byte = np.array([k == BYTE for k in kind])
        self.special = np.array([k in (UNKNOWN, CONTROL) for k in kind])
        unk = m.trainer_spec.unk_surface.encode()
        self.surface = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else unk if k == UNKNOWN else p.replace(SPACE_MARK, " ").encode()
                        for p, k in zip(pieces, kind)]
        self.length = np.fromiter(map(len, self.surface), np.int64, self.n)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)

    # -------------------------------------------------------- encoding
    @staticmethod
    def words(text: str) -> list[str]:
        """Words of the marked text. One that starts with a space mark is given
        without that mark; any other starts with a line end."""
        if not text:
            return []
        text = text.replace(SPACE_MARK, " ")
        if text[0] == " " or "  " in text:
            return [w if w[0] == "\n" else w[1:] for w in re.findall(r"\n[^ \n]*| *[^ \n]+| +", " " + text)]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and the number of ids of each text."""
        split = [self.words(t or "") for t in texts]
        need = set(chain.from_iterable(split))
        new = need.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.old, new = {}, self.known, need
        again = new.intersection(self.old)
        self.known.update((w, self.old[w]) for w in again)
        if new := new.difference(again):
            self.learn(list(new))
        get = self.known.__getitem__
        parts = [b"".join(map(get, w)) for w in split]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)

    def learn(self, words: list[str]) -> None:
        marked = [w if w[:1] == "\n" else SPACE_MARK + w.replace(" ", SPACE_MARK) for w in words]
        ids, counts = self.merge(marked)
        raw, at = ids.astype("<i4").tobytes(), 0
        for w, n in zip(words, (counts * 4).tolist()):
            self.known[w] = raw[at:at + n]
            at += n

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words, flat, and the number of ids of each."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        of_word = np.repeat(np.arange(len(words)), lens)
        # segments: runs of characters that pieces can span
        cut = np.ones(len(chars), bool)
        bigram = chars[:-1] * 0x110000 + chars[1:]
        cut[1:] = (of_word[1:] != of_word[:-1]) | ~_in_sorted(self.bigrams, bigram)
        sym, seg = self.of_char[chars], np.cumsum(cut) - 1
        place = np.arange(len(chars))  # first character of each symbol
        done_sym, done_place = [], []
        wide = self.n + 0x110000
        while len(sym):
            ranks = np.full(len(sym), NONE)
            key = sym[:-1] * wide + sym[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = (self.pair[at] == key) & (seg[:-1] == seg[1:])
            ranks[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            mine = np.repeat(best, sizes)
            open_ = mine < NONE
            done_sym.append(sym[~open_])
            done_place.append(place[~open_])
            take = (ranks == mine) & open_
            # leftmost occurrences that don't overlap: every other one of a run
            i = np.flatnonzero(take)
            run = np.concatenate(([True], np.diff(i) > 1))
            first = np.maximum.accumulate(np.where(run, i, 0))
            i = i[(i - first) % 2 == 0]
            made = self.made[at[i]]
            # where the new symbol may open a pair of a better rank, one at a time
            s = seg[i]
            i_ok = ~self.early[made] | np.concatenate(([True], s[1:] != s[:-1]))
            i, made = i[i_ok], made[i_ok]
            sym = sym.copy()
            sym[i] = made
            stay = open_
            stay[i + 1] = False
            sym, seg, place = sym[stay], seg[stay], place[stay]
        sym, place = np.concatenate(done_sym), np.concatenate(done_place)
        order = np.argsort(place, kind="stable")
        sym, place = sym[order], place[order]
        word = of_word[place]
        if (sym >= self.n).any():
            sym, word = self._with_bytes(sym, word)
        return sym, np.bincount(word, minlength=len(words))

    def _with_bytes(self, sym, word):
        """Characters that are no piece, as the ids of their UTF-8 bytes."""
        at = np.flatnonzero(sym >= self.n)
        cps = sym[at] - self.n
        raw = np.frombuffer("".join(map(chr, cps.tolist())).encode(), np.uint8)
        n_bytes = np.select([cps < 0x80, cps < 0x800, cps < 0x10000], [1, 2, 3], 4)
        times = np.ones(len(sym), np.int64)
        times[at] = n_bytes
        out, out_word = np.repeat(sym, times), np.repeat(word, times)
        out[np.repeat(sym >= self.n, times)] = self.byte_ids[raw]
        return out, out_word

    # -------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of flat ids; the dummy prefix goes, bytes that are no UTF-8
        become one U+FFFD each, control ids nothing."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        raw = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + sizes, sizes)].tobytes()
        ends = np.concatenate(([0], ends))
        plain = not self.special[ids].any()
        out, a = [], 0
        for n in counts.tolist():
            b = a + n
            own = raw[ends[a]:ends[b]]
            if n and own[:1] == b" " and not self.is_byte[ids[a]]:
                own = own[1:]
            try:
                out.append(own.decode() if plain else self._decode_one(ids[a:b]))
            except UnicodeDecodeError:
                out.append(self._decode_one(ids[a:b]))
            a = b
        return out

    def _decode_one(self, ids: np.ndarray) -> str:
        out, run, prefix = [], b"", True
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run, prefix = run[n:], False
            if i is not None and self.surface[i]:
                piece = self.surface[i].decode()
                out.append(piece[1:] if prefix and piece[0] == " " and not self.special[i] else piece)
                prefix = False
        return "".join(out)


def _in_sorted(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, v), len(table) - 1)] == v


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec of a model."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all), ``ids`` (array of int,
    without begin or end ids) and ``decoded`` (their text).

    A null or empty text has no ids and decodes to the empty text. Rows are
    handled by themselves, very long texts whole. Input columns named ids or
    decoded give way. The model file is read on the driver.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def kernel(texts):
        c = codec(model.value)
        ids, counts = c.encode(texts)
        ends = np.cumsum(counts)
        decoded = c.decode(ids, counts)
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(ids)), decoded]

    return map_texts(docs, text_col, kernel, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], keep)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all but ``ids_col``) and ``decoded``;
    null ids decode to the empty text."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    kept = [f for f in df.schema.fields if (f.name != ids_col if keep is None else f.name in keep) and f.name.lower() != "decoded"]
    names = [*(f.name for f in kept), "decoded"]

    def run(batches):
        for batch in batches:
            c = codec(model.value)
            ids = [np.array(x or [], np.int32) for x in batch.column(len(kept)).to_pylist()]
            decoded = c.decode(np.concatenate([np.empty(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.string())], names=names)

    return df.select(*[df[f"`{f.name}`"] for f in kept], df[ids_col].alias("__ids")).mapInArrow(run, T.StructType(kept + [T.StructField("decoded", T.StringType())]))
