"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are sorted by size, largest first, and each enters the bin with the least remaining capacity
that still takes it, found in a balanced tree. Groups of one size are alike, so the packing works on
the table of distinct sizes (size, number of groups): with B bytes in all there are at most sqrt(2 B)
of them, whatever the number of groups. A run of equal groups enters a bin at once, so the plan is a
short list of intervals of ranks. The groups get their ranks by a distributed sort. Where even that
table is too long for the driver, `precision` rounds sizes up to so many significant bits.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import global_rank, materialise, table


class Treap:
    """A balanced search tree of distinct keys with successor search."""

    def __init__(self):
        self.root: list | None = None  # node: [key, priority, left, right]
        self.random = random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, [key, self.random.random(), None, None]), right)

    def pop_from(self, key):
        """Remove and return the smallest key that is at least `key`, or None."""
        left, right = self._split(self.root, key)
        if right is None:
            self.root = left
            return None
        node, above = right, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            right = node[3]
        else:
            above[2] = node[3]
        self.root = self._join(left, right)
        return node[0]


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int]] | None:
    """Pack groups into bins of a fixed capacity.

    sizes: (size, number of groups), largest size first. Returns (number of consecutive groups, bin)
    in rank order. Without `bins`, a bin is opened when no open one has room, and a group above the
    capacity gets a bin of its own; with `bins`, the result is None where the groups do not fit.
    """
    tree, opened, plan = Treap(), 0, []
    for b in range(bins or 0):
        tree.add((capacity, b))
        opened += 1
    for size, left in sizes:
        while left:
            found = tree.pop_from((size, -1))
            if found is None:
                if bins is not None:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            room, b = found
            n = min(left, room // size) if size else left
            tree.add((room - n * size, b))
            plan.append((n, b))
            left -= n
    return plan


def pack_evenly(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int]]:
    """Pack groups into a fixed number of bins at the least capacity for which best fit works.

    A group larger than an even share of what is left takes a bin for itself first, so that one huge
    group does not leave the others' bins uneven.
    """
    sizes, plan, free = list(sizes), [], bins
    total = sum(s * n for s, n in sizes)
    while sizes and free > 1 and sizes[0][0] * free > total:
        size, n = sizes[0]
        plan.append((1, bins - free))
        free, total = free - 1, total - size
        sizes = ([(size, n - 1)] if n > 1 else []) + sizes[1:]
    if not sizes:
        return plan
    low = max(-(-total // free), sizes[0][0])
    high = low + sizes[0][0]
    while best_fit_decreasing(sizes, high, free) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(sizes, mid, free) is None:
            low = mid + 1
        else:
            high = mid
    return plan + [(n, bins - free + b) for n, b in best_fit_decreasing(sizes, high, free)]


def size_class(precision: int | None) -> str:
    """SQL of the size that a group is packed by: its bytes, or these rounded up to so many significant bits."""
    if precision is None:
        return "bytes"
    shift = f"greatest(cast(floor(log2(greatest(bytes, 1))) as int) - {precision}, 0)"
    return f"shiftleft(shiftright(bytes + shiftleft(1L, {shift}) - 1, {shift}), {shift})"


def shard(docs: DataFrame, shards: int = 16, precision: int | None = None) -> DataFrame:
    """Put all rows into `shards` shards of nearly equal bytes; rows with equal texts stay together.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null counts as no bytes), text_crc32, shard
    and slot (gapless from 0 in each shard, in order of group and doc_id). Null and empty texts are
    one group. docs: doc_id long, text string; other columns are ignored; repeated rows each get a
    slot of their own. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialise(rows, "sized")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("class", F.expr(size_class(precision)))
    groups = global_rank(groups, [F.desc("class"), F.asc("digest")], "rank", "ranked-groups")
    sizes = groups.groupBy("class").count().orderBy(F.desc("class")).toArrow()  # bounded: see above
    classes = list(zip(sizes["class"].to_pylist(), sizes["count"].to_pylist(), strict=True))
    plan = pack_evenly(classes, shards) if classes else []
    ends, into = np.cumsum([n for n, _ in plan]), np.array([b for _, b in plan], np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(ends, b["rank"].to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([b["digest"], b["rank"], pa.array(into[at])], names=["digest", "rank", "shard"])

    placed = groups.select("digest", "rank").mapInArrow(place, "digest binary, rank long, shard int")
    out = global_rank(rows.join(placed, "digest").drop("digest"), ["shard", "rank", "doc_id"], "position", "placed")
    first = out.groupBy("shard").agg(F.min("position").alias("first"))
    return out.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
