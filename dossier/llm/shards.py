"""Operator 7: shards of near-equal bytes by best-fit-decreasing bin packing.

Indivisible groups (equal texts) go from the largest to the smallest into the
open bin with the tightest room, found in a balanced tree.  The driver packs a
list of bounded length: every group that is large against a shard by itself,
and the others in bundles by their digest.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from ..functions.storage import written
from .common import digest, ranked

#: A group of more than 1 / GRAIN of a shard is packed by itself: at most GRAIN per shard, and as many bundles.
GRAIN = 256

#: With many shards the grain is coarser, so that the driver packs about twice this many items at most.
ITEMS = 1 << 17

#: Sub-buckets over which the rows of a shard are numbered.
RANK_BUCKETS = 256


class Rooms:
    """Open bins by remaining room: a treap, balanced by random priorities."""

    def __init__(self) -> None:
        self.root = None
        self.random = random.Random(7)

    def _split(self, node, key):
        """Entries below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(low, [(room, bin_), self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room for ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, rest)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, bins opened as needed; an item over capacity has a bin of its own.

    None if more than ``most`` bins would be needed.
    """
    rooms, bins, opened = Rooms(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            if opened == most:
                return None
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        bins[i] = found[1]
        rooms.add(found[0] - sizes[i], found[1])
    return bins


def equal_bins(sizes: list[int], count: int) -> list[int]:
    """``count`` bins of near-equal size: the smallest capacity that best fit decreasing packs into them.

    An item larger than the mean of the bins that are left takes a bin alone.
    """
    bins, order = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total, alone = sum(sizes), 0
    while alone < len(order) and alone < count - 1 and sizes[order[alone]] * (count - alone) > total:
        bins[order[alone]] = alone
        total -= sizes[order[alone]]
        alone += 1
    rest, left = [sizes[i] for i in order[alone:]], count - alone
    if not rest:
        return bins
    low, high = max(-(-total // left), rest[0]), max(-(-total // left), rest[0]) * 2
    while best_fit_decreasing(rest, high, left) is None:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(rest, middle, left) is None:
            low = middle + 1
        else:
            high = middle
    for i, b in zip(order[alone:], best_fit_decreasing(rest, high, left)):
        bins[i] = alone + b
    return bins


def _bounded_items(groups: DataFrame, capacity: int, grain: int, bundles: int) -> tuple[list, list]:
    """Large groups (digest, bytes) and bundles of the others (bundle, bytes); both bounded."""
    # Groups over capacity / grain: fewer than grain times the number of shards.
    large = groups.filter(F.col("bytes") * grain > capacity).select("digest", "bytes").collect()
    small = groups.filter(F.col("bytes") * grain <= capacity)
    small = small.groupBy(_bundle(bundles).alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    return [tuple(r) for r in large], [tuple(r) for r in small]


def _bundle(bundles: int):
    return F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")


def shard_documents(documents: DataFrame, shards: int | None = 16, capacity: int | None = None, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row's place; equal texts share a shard.

    With ``shards`` the bytes are near equal; a group of equal texts larger than
    an equal share has a shard alone.  With ``capacity`` instead, as few shards
    of that many bytes as best fit decreasing needs; a larger group has one of
    its own.  Size is the UTF-8 bytes of the text plus 1.  ``slot`` numbers the
    rows of a shard from 0 without gap.

    A null text is empty and shares the group of empty texts.  Rows that repeat
    or tie have slots of their own.  A null key is ordered first.  An empty
    table gives no row.  Other columns are not read.

    Group sizes are partial sums by digest; the rows are never gathered by text.
    The lists that the driver packs and broadcasts have at most
    2 x GRAIN x shards entries, and about 2 x ITEMS with more shards than that.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = written(documents.select(
        F.col(f"`{key}`").alias("id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"),
        F.unhex(digest(f"`{text}`")).alias("digest")), "shard-sizes")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    wanted = shards or max(1, -(-total // capacity))
    room, grain = capacity or max(1, -(-total // wanted)), max(2, min(GRAIN, ITEMS // wanted))
    large, small = _bounded_items(groups, room, grain, grain * wanted)
    sizes = [b for _, b in (*large, *small)]
    bins = equal_bins(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    spark = documents.sparkSession
    by_digest = spark.createDataFrame([(bytes(d), b) for (d, _), b in zip(large, bins)], "digest binary, large_shard int")
    by_bundle = spark.createDataFrame([(x, b) for (x, _), b in zip(small, bins[len(large):])], "bundle int, small_shard int")
    placed = (
        rows.withColumn("bundle", _bundle(grain * wanted))
        .join(F.broadcast(by_digest), "digest", "left").join(F.broadcast(by_bundle), "bundle", "left")
        .select("id", "size", "crc", F.coalesce("large_shard", "small_shard").alias("shard"))
    )
    numbered = ranked(written(placed, "shard-rows"), "shard", ["id", "crc"], RANK_BUCKETS, "slot")
    return numbered.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long"))
