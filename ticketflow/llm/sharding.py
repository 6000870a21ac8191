"""Contiguous shards with the smallest possible largest shard.

Groups of equal texts are atomic and stand in the order of their digest. The
smallest capacity at which a greedy fill needs no more than the given number of
shards is found by binary search with that greedy check; the cuts stay within it and are as even as
it allows. No list of all groups is needed for that: sizes
are summed by digest prefix, and only prefixes in which a cut could still lie
are summed again by longer ones, until those hold single groups.

A group of more than an even share makes a shard of its own, as no cut can
lessen it; the capacity is then sought for the rest, over the shards left.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables

#: Production parameters.
SHARDS, OVERHEAD = 40, 16
#: Hex digits of a digest; of the first prefixes, and by how many they grow.
DIGITS, FIRST, STEP = 32, 4, 1


@dataclass
class Block:
    """The groups whose digest begins so: how many, their size, the largest."""

    prefix: str
    groups: int
    size: int
    largest: int


def keyed(docs: DataFrame) -> DataFrame:
    """Per row: id, key of its text, size in bytes with the overhead, crc."""
    text = tables.text_of()
    return docs.select(
        F.col("doc_id").alias("id"),
        F.md5(text).alias("key"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )


def _blocks(groups: DataFrame, digits: int) -> list[Block]:
    prefix = F.substring("key", 1, digits).alias("prefix")
    summed = groups.groupBy(prefix).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("size").alias("most"))
    return [Block(r.prefix, r.n, r.size, r.most) for r in summed.collect()]


def _fill(blocks: list[Block], capacity: int, shards: int) -> list[int] | None:
    """Indexes where a greedy fill begins a new shard, blocks being atomic; None if too many."""
    starts, held = [], 0
    for i, block in enumerate(blocks):
        if block.size > capacity:
            return None
        if held + block.size > capacity:
            starts.append(i)
            held = 0
            if len(starts) >= shards:
                return None
        held += block.size
    return starts


def _even(blocks: list[Block], capacity: int, shards: int) -> list[int]:
    """As _fill, but a shard ends where it is nearest to an even share of what is left, or as soon
    after as the rest still fits: no shard exceeds the capacity, and the last is not left short."""
    upto = [0, *accumulate(b.size for b in blocks)]
    starts, at = [], 0
    for left in range(shards, 1, -1):
        if at == len(blocks):
            break
        share = upto[at] + (upto[-1] - upto[at]) / left
        last = bisect_right(upto, upto[at] + capacity) - 1  # where the greedy fill ends
        end = bisect_right(upto, share) - 1
        end = min(last, end + (end < len(blocks) and upto[end + 1] - share < share - upto[end]))
        end = max(end, at + 1)
        # the later the end, the more surely the rest fits; after the greedy end it does
        at = end + bisect_left(range(end, last), True, key=lambda e: _fill(blocks[e:], capacity, left - 1) is not None)
        if at < len(blocks):
            starts.append(at)
    return starts


def _smallest(blocks: list[Block], shards: int, low: int) -> int:
    high = max(low, sum(b.size for b in blocks))
    while low < high:
        middle = (low + high) // 2
        if _fill(blocks, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _undecided(blocks: list[Block], low: int, high: int, shards: int) -> set[str]:
    """Blocks of several groups in which a shard may end, for some capacity in [low, high].

    The end of a fill never moves back when its start or the capacity grows. So its earliest
    place follows from the earliest start and `low`, less the largest group of the block that is
    reached, and its latest from the latest start and `high`.
    """
    ends = list(accumulate(b.size for b in blocks))
    found, early, late = set(), 0, 0
    for _ in range(shards - 1):
        i, j = bisect_right(ends, early + low), bisect_right(ends, late + high)
        if i >= len(blocks):
            break
        first = ends[i] - blocks[i].size
        early = first if blocks[i].groups == 1 else max(first, early + low - blocks[i].largest)
        if j < len(blocks):
            late = ends[j] - blocks[j].size if blocks[j].groups == 1 else late + high
        else:
            late = ends[-1]
        found |= {b.prefix for b in blocks[i : j + 1] if b.groups > 1}
    return found


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity for groups(key, size), and the prefix at which each later shard begins.

    The driver holds one figure per prefix: 65,536 first, then those in which a cut may lie.
    """
    blocks = sorted(_blocks(groups, FIRST), key=lambda b: b.prefix)
    if not blocks:
        return 0, []
    low = max(-(-sum(b.size for b in blocks) // shards), max(b.largest for b in blocks))
    digits = FIRST
    while True:
        high = _smallest(blocks, shards, low)
        opened = _undecided(blocks, low, high, shards) if high > low else set()
        if not opened:
            return high, [blocks[i].prefix for i in _even(blocks, high, shards)]
        digits = min(DIGITS, digits + STEP)
        finer = _blocks(_within(groups, opened), digits)
        blocks = sorted([b for b in blocks if b.prefix not in opened] + finer, key=lambda b: b.prefix)


def _within(groups: DataFrame, prefixes: set[str]) -> DataFrame:
    kept = groups.filter(F.lit(False))
    for n in sorted({len(p) for p in prefixes}):
        these = [p for p in prefixes if len(p) == n]
        kept = kept.unionByName(groups.filter(F.substring("key", 1, n).isin(these)))
    return kept


def cut_points(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """Keys of groups with a shard of their own, and where each later shard of the rest begins."""
    left = groups.agg(F.sum("size")).first()[0] or 0
    alone = []
    for row in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        open_ = shards - len(alone)
        if open_ < 2 or row["size"] * open_ <= left:
            break
        alone.append(row.key)
        left -= row["size"]
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    return alone, capacity_and_cuts(rest, shards - len(alone))[1]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of docs: id, key, size, crc, shard, slot.

    Null text counts as empty; equal texts share a shard; slots of a shard run from 0 without gaps,
    repeated rows each having one. Fewer groups than shards leave shards empty,
    and an empty table gives an empty result. Only doc_id and text are read.
    """
    rows = tables.stored_runs(keyed(docs), "keyed")
    groups = tables.stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    alone, cuts = cut_points(groups, shards)
    # the number of cuts at or below the key: cuts are prefixes, and a prefix sorts before its keys
    shard = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(shards - 1 - i)).otherwise(shard)
    numbered = tables.ranked(rows.withColumn("shard", shard), "shard", ["id", "key"], "slot")
    return numbered.select("id", "key", "size", "crc", "shard", "slot")
