"""Sharding by a minimax contiguous partition (DataFrame functions only).

Equal texts are one atomic group. Groups are ordered by a digest of the text,
and the smallest capacity is sought at which a greedy walk over the ordered
group sizes fills no more than the wanted number of shards; the walk at that
capacity gives the cuts. A group that alone is above an even share has a shard
to itself, and the rest is divided over the other shards.

The group sizes stay a table. The search sees them as blocks of neighbouring
digests (a bounded number of rows): it takes each block once as divisible
anywhere and once as whole, which bounds the capacity and every cut from both
sides. Only the blocks between those bounds are divided further, until each
possible cut lies between two groups and both searches agree.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage

#: hex digits of the digest that order the groups, and their bits
DIGITS = 15
BITS = 4 * DIGITS
#: digest bits of the first blocks, and the most blocks that one further step may read
FIRST_BITS, MORE_BLOCKS = 12, 1 << 16
#: hex digits of the id's digest that name a range of slots
SLOT_DIGITS = 3
#: ranges over which rows without an id are spread
SPREAD = 4096


# ------------------------------------------------------------ search over blocks
class Blocks:
    """Ordered blocks of groups: ``lows`` the least key of each, ``sizes`` its
    bytes, ``whole`` whether it is a single group."""

    def __init__(self, blocks: list[tuple[int, int, bool]]):
        self.lows = [b[0] for b in blocks]
        self.whole = [b[2] for b in blocks]
        self.upto = [0]
        for _, size, _ in blocks:
            self.upto.append(self.upto[-1] + size)
        self.total = self.upto[-1]

    def cut(self, start: int, capacity: int, divisible: bool) -> int:
        """The farthest place a shard from ``start`` reaches."""
        end = start + capacity
        if end >= self.total:
            return self.total
        i = bisect_right(self.upto, end) - 1
        return end if divisible and not self.whole[i] else max(start, self.upto[i])

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """The ends of all shards but the last."""
        at, out = 0, []
        for _ in range(shards - 1):
            at = self.cut(at, capacity, divisible)
            out.append(at)
        return out

    def fits(self, capacity: int, shards: int, divisible: bool) -> bool:
        at = 0
        for _ in range(shards):
            at = self.cut(at, capacity, divisible)
        return at == self.total

    def capacity(self, shards: int, divisible: bool) -> int:
        """The smallest capacity that fits, by binary search."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards, divisible) else (mid + 1, high)
        return low

    def open_blocks(self, shards: int) -> list[int]:
        """Blocks of several groups in which some cut may lie."""
        least, most = self.capacity(shards, True), self.capacity(shards, False)
        found = set()
        for low, high in zip(self.cuts(least, shards, False), self.cuts(most, shards, True)):
            first, last = bisect_right(self.upto, low) - 1, bisect_right(self.upto, high) - 1
            found.update(i for i in range(max(first, 0), min(last, len(self.lows) - 1) + 1)
                         if not self.whole[i] and self.upto[i] < high and self.upto[i + 1] > low)
        return sorted(found)

    def bounds(self, shards: int) -> list[int]:
        """The least key of every shard but the first, at the smallest capacity."""
        ends = self.cuts(self.capacity(shards, False), shards, False)
        return [self.lows[bisect_right(self.upto, e) - 1] if e < self.total else 1 << BITS for e in ends]


def _blocks(rows: DataFrame, bits: int) -> list[tuple[int, int, bool, int]]:
    """(least key, bytes, single group, block number) at so many digest bits."""
    block = F.shiftright("key", BITS - bits)
    got = rows.groupBy(block.alias("b")).agg(F.min("key").alias("lo"), F.sum("size").alias("n"), (F.min("key") == F.max("key")).alias("whole"))
    return sorted((r["lo"], r["n"], r["whole"], r["b"]) for r in got.collect())


def shard_bounds(rows: DataFrame, shards: int) -> list[int]:
    """Least keys of all shards but the first, for rows (key, size)."""
    bits = FIRST_BITS
    known = [(*b, bits) for b in _blocks(rows, bits)]
    while known:
        todo = Blocks([b[:3] for b in known]).open_blocks(shards)
        if not todo:
            return Blocks([b[:3] for b in known]).bounds(shards)
        # blocks to divide may have different depths; all go to the same new one
        spans = [(known[i][3] << (BITS - known[i][4]), (known[i][3] + 1) << (BITS - known[i][4])) for i in todo]
        wide = sum(1 << max(0, bits - known[i][4]) for i in todo)
        bits = min(BITS, bits + max(1, (MORE_BLOCKS // wide).bit_length() - 1))
        merged = [spans[0]]
        for lo, hi in spans[1:]:
            if lo == merged[-1][1]:
                merged[-1] = (merged[-1][0], hi)
            else:
                merged.append((lo, hi))
        near = F.lit(False)
        for lo, hi in merged:  # a few stretches for each cut
            near = near | ((F.col("key") >= lo) & (F.col("key") < hi))
        gone = set(todo)
        known = sorted([b for i, b in enumerate(known) if i not in gone] + [(*b, bits) for b in _blocks(rows.where(near), bits)])
    return [1 << BITS] * (shards - 1)


def set_apart(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Keys of groups above an even share of what the larger ones leave;
    ``largest`` has (key, size) by falling size."""
    apart = []
    for key, size in largest:
        if shards - len(apart) < 2 or size * (shards - len(apart)) <= total:
            break
        apart.append(key)
        total -= size
    return apart


# ------------------------------------------------------------ operator
def text_key(text: Column) -> Column:
    """The first ``BITS`` bits of the text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as the empty
    one. Equal texts share a shard (so do texts whose first ``BITS`` digest
    bits agree), and the largest shard is as small as the order of the groups
    allows. Shards may be empty where there are fewer groups than shards.
    ``slot`` numbers a shard's rows from 0 without gaps, in the order of the
    ids' digests; rows that tie on the id are numbered in the order they are
    read, and rows without an id come by range of that order. Texts of any
    length are read once; only their digests, sizes and ids are kept. An empty
    table gives no rows; other columns are not carried.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(
        docs[id_col].alias("id"), text_key(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("key").agg(F.sum("size").alias("n"))
    largest = [(r["key"], r["n"]) for r in groups.orderBy(F.desc("n"), "key").limit(shards).collect()]
    apart = set_apart(largest, total, shards)
    others = rows.where(~F.col("key").isin(apart)) if apart else rows
    bounds = shard_bounds(others, shards - len(apart))
    shard = sum((F.when(F.col("key") >= b, 1).otherwise(0) for b in bounds if b < 1 << BITS), F.lit(0))
    for i, key in enumerate(apart):
        shard = F.when(F.col("key") == key, F.lit(shards - len(apart) + i)).otherwise(shard)

    digest = F.md5(F.col("id").cast("string"))
    named = F.when(F.col("id").isNotNull(), F.substring(digest, 1, SLOT_DIGITS)).otherwise(
        F.concat(F.lit("~"), F.lpad((F.col("row") % SPREAD).cast("string"), 4, "0")))
    dealt = rows.select("id", "size", "crc", "row", digest.alias("digest"), shard.cast("int").alias("shard"), named.alias("range"))
    ranges = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # shards x (16**SLOT_DIGITS + SPREAD) rows at most
    offsets = ranges.select("shard", "range", before.alias("before"))
    within = Window.partitionBy("shard", "range").orderBy("digest", "row")
    slot = F.col("before") + F.row_number().over(within) - 1
    return dealt.join(F.broadcast(offsets), ["shard", "range"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", slot.cast("long").alias("slot"))
