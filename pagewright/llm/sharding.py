"""Contiguous shards of minimal largest size, over groups in a fixed order.

Groups are equal texts; their order is that of a 64-bit hash of the text (texts that
share a hash form one group). The smallest feasible capacity is found by binary search
with a greedy check. The driver never holds all groups: it holds ordered key ranges
("nodes") with their bytes. Treating a range as divisible gives a lower bound of the
capacity, treating it as atomic an upper one; ranges where a cut can fall between both
are split by reading their groups' sums again, until the bounds meet. Each round keeps
at most ``2**NODE_BITS`` new nodes, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import drop_table, write_table

SHARDS = 24
OVERHEAD = 8
FIRST_BITS, NODE_BITS = 16, 18
SLOT_BUCKETS = 1024


class Nodes:
    """Ordered key ranges: first key, width in bits below, number of groups, bytes."""

    def __init__(self, lo, bits, n, size):
        order = np.argsort(lo, kind="stable")
        self.lo, self.bits, self.n, self.size = (np.asarray(x)[order] for x in (lo, bits, n, size))
        self.ends = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.atomic = self.n <= 1

    def reach(self, start: int, capacity: int, fluid: bool) -> int:
        """The furthest position that one shard from ``start`` can end at."""
        to = start + capacity
        if to >= self.ends[-1]:
            return int(self.ends[-1])
        j = int(np.searchsorted(self.ends, to, "right")) - 1
        return to if fluid and not self.atomic[j] else max(start, int(self.ends[j]))

    def greedy(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        cuts = [0]
        for _ in range(shards):
            cuts.append(self.reach(cuts[-1], capacity, fluid))
        return cuts

    def smallest(self, shards: int, fluid: bool) -> int:
        """The smallest capacity under which the greedy check places all bytes."""
        lo, hi = 0, int(self.ends[-1])
        while lo < hi:
            mid = (lo + hi) // 2
            if self.greedy(mid, shards, fluid)[-1] >= self.ends[-1]:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def replaced(self, at: np.ndarray, lo, bits, n, size) -> Nodes:
        keep = ~at
        return Nodes(np.concatenate([self.lo[keep], lo]), np.concatenate([self.bits[keep], bits]), np.concatenate([self.n[keep], n]), np.concatenate([self.size[keep], size]))


def _bucketed(groups: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """Sums of the groups by the first ``bits`` bits of the key, in at most the asked number of rows."""
    node = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
    rows = groups.groupBy(node.alias("node")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).toPandas()
    return rows["node"].to_numpy(np.int64) << (64 - bits if bits < 64 else 0), np.full(len(rows), bits), rows["n"].to_numpy(np.int64), rows["bytes"].to_numpy(np.int64)


def plan_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, node_bits: int = NODE_BITS) -> tuple[int, list[int]]:
    """The smallest capacity and the first keys of shards 1 and on; ``groups`` has key and bytes."""
    nodes = Nodes(*_bucketed(groups, first_bits))
    if not len(nodes.lo):
        return 0, []
    while True:
        low, high = nodes.smallest(shards, True), nodes.smallest(shards, False)
        if low == high:
            break
        at = np.zeros(len(nodes.lo), bool)
        for a, b in zip(nodes.greedy(low, shards, False)[1:], nodes.greedy(high, shards, True)[1:], strict=True):
            at |= (nodes.ends[1:] > a) & (nodes.ends[:-1] <= b)
        at &= ~nodes.atomic
        if not at.any():
            break
        total = int(nodes.n[at].sum())
        bits = 64
        if total > 2**node_bits:  # as fine as the bound on new nodes allows
            width = float((2.0 ** -nodes.bits[at].astype(float)).sum())
            bits = max(int(nodes.bits[at].max()) + 1, min(64, int(np.floor(node_bits - np.log2(width)))))
        # neighbouring nodes make one range; there are no more ranges than cuts
        picked = np.flatnonzero(at)
        runs = np.split(picked, np.flatnonzero(np.diff(picked) > 1) + 1)
        where = F.lit(False)
        for run in runs:
            where = where | F.col("key").between(int(nodes.lo[run[0]]), int(nodes.lo[run[-1]]) + 2 ** (64 - int(nodes.bits[run[-1]])) - 1)
        nodes = nodes.replaced(at, *_bucketed(groups.where(where), bits))
    return high, _cut_keys(nodes, shards, high)


def _cut_keys(nodes: Nodes, shards: int, capacity: int) -> list[int]:
    """Cuts under the capacity, each as near to an equal share of the rest as that allows."""
    ends, total = nodes.ends, int(nodes.ends[-1])
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(int(ends[np.searchsorted(ends, earliest[-1] - capacity, "left")]) if earliest[-1] > capacity else 0)
    at, keys = 0, []
    for k in range(1, shards):
        least, most = max(at, earliest[shards - k]), nodes.reach(at, capacity, False)
        ideal = at + (total - at) / (shards - k + 1)
        j = int(np.searchsorted(ends, ideal, "left"))
        near = min((int(ends[i]) for i in (j - 1, j) if 0 <= i < len(ends)), key=lambda e: abs(e - ideal))
        at = min(max(near, least), most)
        j = int(np.searchsorted(ends, at, "left"))
        if j < len(nodes.lo):
            keys.append(int(nodes.lo[j]))
    return keys


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, slot_buckets: int = SLOT_BUCKETS, first_bits: int = FIRST_BITS, node_bits: int = NODE_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row.

    Equal texts share a shard. A group as large as an equal share of what is left takes a
    shard of its own, largest first; the others are cut contiguously in key order. Null
    text has no bytes and goes with empty text. Null ids and repeated rows are placed like
    any other row; empty input gives no rows, few groups leave shards empty. Slots follow
    (a hash bucket of the row, doc_id) and are gapless; rows equal in doc_id and text may
    swap slots. Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = write_table(docs.select("doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-rows")
    groups = write_table(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    left, total, own = shards, groups.agg(F.sum("bytes")).first()[0] or 0, []
    for g in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if left < 2 or g["bytes"] * left < total:
            break
        own.append(g["key"])
        left, total = left - 1, total - g["bytes"]
    _, keys = plan_cuts(groups.where(~F.col("key").isin(own)) if own else groups, left, first_bits, node_bits)
    drop_table(groups)
    shard: Column = F.lit(len(own))
    for k in keys:
        shard = shard + (F.col("key") >= k).cast("int")
    for i, k in enumerate(own):
        shard = F.when(F.col("key") == k, F.lit(i)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(slot_buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards * slot_buckets rows at most
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
