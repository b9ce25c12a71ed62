"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``max_bits`` bits have a common
variant within half of them of either. Every distinct fingerprint therefore
stands for all its variants within half the radius; equal variants meet in one
task and their owners are verified and linked. The variants are dealt out in
two steps. The shuffle key is a variant's first bits: a fingerprint is sent
once to every prefix that some variant of it has (56 rows for 10 bits instead
of 2,081 variants); a prefix that too many reach gives way to longer ones, so no
task gets a large share of all. The task of a prefix completes the variants there, as flat
numpy arrays, splitting by more bits whenever they would not fit, sorts them
and links the owners of equal ones. Nothing is approximated: a variant is made
in the one task whose prefix it has.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import lookup, map_texts
from skein.llm.components import star_components
from skein.session import cut_lineage

SHINGLE, MAX_BITS = 4, 4
#: variants completed at once by a task (8 bytes each)
VARIANTS = 1 << 22
#: distinct fingerprints per shuffle prefix, on average
PER_PREFIX = 256
#: fingerprints that a prefix may have before it is dealt out by STEP more bits
LOAD, STEP = 1 << 18, 8

_hash = xxhash.xxh64_intdigest


# ------------------------------------------------------------ fingerprints
def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64 (seed 42), repeats included; the
    whole sequence where there are fewer than ``k`` words, 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return _hash(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        s, e = starts[at:min(n, at + (1 << 16))].tolist(), ends[at + k - 1:min(n, at + (1 << 16)) + k - 1].tolist()
        h = np.fromiter([_hash(joined[a:b], 42) for a, b in zip(s, e)], np.uint64, len(s))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``fp``, the fingerprint as a signed long."""

    def kernel(texts):
        fps = np.array([fingerprint((t or "").encode(), k) for t in texts], np.uint64)
        return [pa.array(fps.view(np.int64))]

    return map_texts(docs, text_col, kernel, [("fp", T.LongType())], keep)


# ------------------------------------------------------------ variants
def masks(bits: int, weight: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``weight`` ones, lightest first."""
    out = [0]
    for w in range(1, min(bits, weight) + 1):
        out += [sum(1 << p for p in c) for c in combinations(range(bits), w)]
    return np.array(out, np.uint64)


class Ball:
    """Completes and matches the variants of one prefix."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, bits: int, weight: int) -> np.ndarray:
        if (bits, weight) not in self._masks:
            self._masks[bits, weight] = masks(bits, weight)
        return self._masks[bits, weight]

    def links(self, low: np.ndarray, left: np.ndarray, bits: int):
        """Index pairs of rows that share a variant: ``low`` has the last
        ``bits`` bits of each, ``left`` the flips that it may still make.
        Of the rows at one variant, one with the most flips left is paired
        with each other one. Nothing is lost: rows within the radius of each
        other share a variant that is within its lower half of one of them, and
        a row so near is within the radius of all others there. (With an odd
        radius, two rows at its upper half may be one bit too far apart.)"""
        if len(low) < 2:
            return
        made = sum(len(self.masks(bits, w)) * int((left == w).sum()) for w in np.unique(left))
        if made > VARIANTS and bits > 4:
            top = bits - 4
            high, rest = (low >> np.uint64(top)).astype(np.uint8), low & np.uint64((1 << top) - 1)
            for q in range(16):
                more = left - np.bitwise_count(high ^ np.uint8(q))
                at = np.flatnonzero(more >= 0)
                for a, b in self.links(rest[at], more[at], top):
                    yield at[a], at[b]
            return
        values, owners = [], []
        for w in np.unique(left):
            at, m = np.flatnonzero(left == w), self.masks(bits, int(w))
            values.append((low[at][:, None] ^ m).ravel())
            owners.append((at, len(m)))
        every = np.concatenate(values)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        if not len(twice):
            return
        # rows of these values: a bitmap sorts out nearly all others
        seen = np.zeros(1 << 20, bool)
        seen[_spot(twice)] = True
        value, owner = [], []
        for v, (at, n) in zip(values, owners):
            i = np.flatnonzero(seen[_spot(v)])
            i = i[twice[np.minimum(np.searchsorted(twice, v[i]), len(twice) - 1)] == v[i]]
            value.append(v[i])
            owner.append(at[i // n])
        value, owner = np.concatenate(value), np.concatenate(owner)
        unused = left[owner] - np.bitwise_count(value ^ low[owner])
        order = np.lexsort((owner, -unused, value))
        value, owner = value[order], owner[order]
        first = np.concatenate(([True], value[1:] != value[:-1]))
        head = owner[np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
        pair = np.unique(np.stack([head[~first], owner[~first]], 1), axis=0)
        yield pair[:, 0], pair[:, 1]

    def forest(self, fps: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The links of one prefix, as one (fingerprint, smaller one) per
        linked fingerprint: no group is emitted as all its pairs."""
        half = (self.max_bits + 1) // 2
        fps = np.unique(fps)
        rest = 64 - bits
        left = half - np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(prefix)).astype(np.int64) if bits else np.full(len(fps), half)
        low = fps & np.uint64((1 << rest) - 1)
        root = np.arange(len(fps))
        for a, b in self.links(low, left, rest):
            near = np.bitwise_count(fps[a] ^ fps[b]) <= self.max_bits
            root = hook(root, a[near], b[near])
        child = np.flatnonzero(root != np.arange(len(fps)))
        return fps[child], fps[root[child]]


def _spot(v: np.ndarray) -> np.ndarray:
    return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a to b: smaller roots win, paths are halved."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (jump := root[root] != root).any():
            root[jump] = root[root[jump]]


class Deal:
    """Where a fingerprint's variants are: the prefixes of ``bits`` bits that it
    reaches with the flips it may make, or, for prefixes in ``overfull`` (a
    sorted array per level), their extensions by ``STEP`` more bits."""

    def __init__(self, bits: int, half: int, overfull: list[np.ndarray]):
        self.bits, self.overfull = bits, overfull
        self.reach, self.more = masks(bits, half), [masks(STEP, w) for w in range(half + 1)]
        self.left = half - np.bitwise_count(self.reach).astype(np.int64)

    def levels(self, fp: np.ndarray):
        """Per level: its bits, the prefixes that are not overfull, the fingerprint of each."""
        prefix = ((fp >> np.uint64(64 - self.bits))[:, None] ^ self.reach).ravel()
        fp, left, bits = np.repeat(fp, len(self.reach)), np.tile(self.left, len(fp)), self.bits
        for over in self.overfull:
            at = np.minimum(np.searchsorted(over, prefix), len(over) - 1)
            full = over[at] == prefix
            yield bits, prefix[~full], fp[~full]
            prefix, fp, left, bits = prefix[full], fp[full], left[full], bits + STEP
            parts = []
            for w, m in enumerate(self.more):
                own = left == w
                tail = (fp[own] >> np.uint64(64 - bits)) & np.uint64((1 << STEP) - 1)
                parts.append((((prefix[own] << np.uint64(STEP))[:, None] | (tail[:, None] ^ m)).ravel(),
                              np.repeat(fp[own], len(m)), (w - np.bitwise_count(np.tile(m, int(own.sum()))).astype(np.int64))))
            prefix, fp, left = (np.concatenate(x) for x in zip(*parts))
        yield bits, prefix, fp

    def rows(self, last_only: bool = False):
        """mapInArrow body: (bits, prefix, fp), of the last level or of all."""

        def run(batches):
            for batch in batches:
                for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                    for level, (bits, prefix, fp) in enumerate(self.levels(part.column(0).to_numpy().view(np.uint64))):
                        if len(fp) and (level == len(self.overfull) or not last_only):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), bits, np.int32)), pa.array(prefix.view(np.int64)), pa.array(fp.view(np.int64))],
                                                             names=["bits", "prefix", "fp"])

        return run


_DEALT = "bits int, prefix long, fp long"


def overfull_prefixes(fps: DataFrame, n: int, bits: int, half: int, load: int) -> list[np.ndarray]:
    """Prefixes that more than ``load`` of the ``n`` fingerprints reach, and of
    their extensions those that are still so, level by level. A level has less
    than 2**20 of them, as the bound rises with all there is to deal out."""
    reach = masks(bits, half)
    own = fps.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("p")).agg(F.count("*").alias("n"))
    loads = own.select(F.explode(F.array(*[F.col("p").bitwiseXOR(F.lit(int(m))) for m in reach])).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("n"))
    load = max(load, (n * len(masks(64, half))) >> 20)
    found = []
    while True:
        over = np.sort(loads.where(F.col("n") > load).select("prefix").toArrow().column(0).to_numpy()).astype(np.uint64)
        if not len(over) or bits + STEP > 56:
            return found
        found.append(over)
        bits += STEP
        loads = fps.mapInArrow(Deal(bits - STEP * len(found), half, found).rows(last_only=True), _DEALT).groupBy("prefix").agg(F.count("*").alias("n"))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, per_prefix: int = PER_PREFIX, load: int = LOAD) -> DataFrame:
    """(fp) distinct -> (a, b): links that connect exactly the fingerprints
    which chains of at most ``max_bits`` differing bits connect. A prefix that
    more than ``load`` fingerprints reach, as where a large family of near
    copies shares its first bits, is dealt out by more bits."""
    fps = fps.select("fp")
    n, half = fps.count(), (max_bits + 1) // 2
    bits = min(max((max(n, 1) // per_prefix).bit_length(), 6), 24)
    ball = Ball(max_bits)

    def match(key, group):
        a, b = ball.forest(group.column("fp").to_numpy().view(np.uint64), key[1].as_py(), key[0].as_py())
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    deal = Deal(bits, half, overfull_prefixes(fps, n, bits, half, load))
    return fps.mapInArrow(deal.rows(), _DEALT).groupBy("bits", "prefix").applyInArrow(match, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Words are runs of non-white-space after lower-casing A-Z, shingles ``k``
    of them; null and empty texts have fingerprint zero and link like any
    other. ``component_id`` is the smallest id reachable over fingerprints at
    ``max_bits`` or fewer differing bits. Rows may share ids; a null id gets
    the component of its fingerprint and is never its name, unless all ids of
    the component are null. An empty table gives no rows; other columns are
    not carried. Copies share a fingerprint, so only distinct fingerprints are
    compared, and their number alone sets the cost.
    """
    rows = cut_lineage(fingerprints(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), k=k, keep=["id"]))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    root_of = star_components(near_links(fps, max_bits))
    rooted = cut_lineage(fps.join(root_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps")))
    n_fps, n_rows = rooted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_fp = cut_lineage(lookup(rooted, names, "root", "fps", n_fps).select("fp", "n", "component_id"))
    return lookup(rows, of_fp, "fp", "n", n_rows).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents of ``docs`` that stay, with all their columns: of each
    group the one with the smallest id. Rows that share an id are one document
    and go together; rows without an id can't be told apart, so they stay."""
    groups = simhash_groups(docs, id_col, text_col, k, max_bits)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    named = docs.where(docs[id_col].isNotNull())
    # a task holds its even share of the ids that go (distinct), and streams texts
    stay = named.join(gone.hint("shuffle_hash"), named[id_col] == gone["__gone"], "left_anti")
    return stay.unionByName(docs.where(docs[id_col].isNull()))
