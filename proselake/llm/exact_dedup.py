"""Exact deduplication with a minimal perfect hash over historical digests.

History is the set of all digests met so far, each with its winner locator (the row that stays, and
its length) and the size of its group. It is a table of shards by digest; a shard is a minimal
perfect hash (hash and displace: keys fall into small buckets, and each bucket gets the first seed
that sends its keys to free slots) with one slot per digest. A slot holds the full digest, so a lookup
compares all bytes and no stranger passes.

A delivery of rows is combined by digest before anything is exchanged, so a hot digest is one row a
task. Its digests are looked up in their shard: members change the locator of their slot, the others
are groups of their own and join the next history. Without a history the table itself comes in two
deliveries, the first of which is the history of the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise, table

BLANKS = r"[\x20\x09-\x0D]"
SHARD_DDL = "shard int, shards int, seeds binary, digests binary, keep_ids binary, keep_chars binary, sizes binary"
ENTRY_DDL = "digest binary, keep_id long, group_size long"
KEYS_PER_BUCKET = 4
DIGESTS_PER_SHARD = 1 << 10
#: The length that stands for a group whose rows all lack an id; any other row wins.
NO_ID = -1


def normalised(text):
    """The text without blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    x = x + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of 32-byte digests (n x 32): one picks the bucket, one the slot."""
    words = np.ascontiguousarray(digests).view("<u8")
    return words[:, 1], words[:, 2]


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per bucket and the slot of each digest; slots are 0 to n - 1, each taken once."""
    n = len(digests)
    pick, place = _halves(digests)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    of = (pick % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    starts = np.r_[0, np.cumsum(sizes)]
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    step = 64
    for b in np.argsort(-sizes, kind="stable"):
        keys = order[starts[b] : starts[b + 1]]
        if not len(keys):
            break
        at, width = 0, step
        while True:  # try seeds a block at a time; larger blocks as free slots get rare
            tried = np.arange(at, at + width, dtype=np.uint64)
            to = (_mix(place[keys][None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[to].any(axis=1)
            if len(keys) > 1:
                s = np.sort(to, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slots[keys] = at + k, to[k]
                taken[to[k]] = True
                break
            at, width = at + width, min(width * 4, 1 << 16)
    return seeds, slots


def lookup(seeds: np.ndarray, slot_digests: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 where the slot holds other bytes."""
    n = len(slot_digests)
    if not n:
        return np.full(len(digests), -1, np.int64)
    pick, place = _halves(digests)
    seed = seeds[(pick % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64)
    slot = (_mix(place, seed) % np.uint64(n)).astype(np.int64)
    return np.where((slot_digests[slot] == digests).all(axis=1), slot, -1)


def _bytes32(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def group_digests(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_chars, group_size) of distinct digests. Copies are combined before the shuffle."""
    chars = F.when(F.col("doc_id").isNull(), NO_ID).otherwise(F.col("n_chars"))
    best = F.max(F.struct(chars.alias("chars"), (-F.col("doc_id")).alias("low")))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("digest", F.coalesce(-F.col("best.low"), F.lit(0)).alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size")


def _pack(shard: int, shards: int, digests: np.ndarray, ids: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> pa.Table:
    seeds, slots = build_mph(digests)
    order = np.argsort(slots)
    cols = [x[order].astype("<i8").tobytes() for x in (ids, chars, sizes)]
    return pa.table({"shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "seeds": [seeds.tobytes()], "digests": [digests[order].tobytes()], "keep_ids": [cols[0]], "keep_chars": [cols[1]], "sizes": [cols[2]]})


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), *(np.frombuffer(row[c], "<i8") for c in ("keep_ids", "keep_chars", "sizes"))


def _merge(shards: int):
    """For applyInArrow over one shard: groups of a delivery against the shard of the history; the next shard."""

    def f(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        digests = _bytes32(left["digest"])
        ids, chars, sizes = (left[c].to_numpy() for c in ("keep_id", "keep_chars", "group_size"))
        if len(right):
            held = right.slice(0, 1).to_pylist()[0]
            known, *rest = _unpack(held)
            old_ids, old_chars, old_sizes = (x.copy() for x in rest)
            slot = lookup(np.frombuffer(held["seeds"], np.uint32), known, digests)
            hit = slot >= 0
            at = slot[hit]
            old_sizes[at] += sizes[hit]
            better = (chars[hit] > old_chars[at]) | ((chars[hit] == old_chars[at]) & (ids[hit] < old_ids[at]))
            old_ids[at[better]], old_chars[at[better]] = ids[hit][better], chars[hit][better]
            digests = np.concatenate([known, digests[~hit]])
            ids, chars, sizes = (np.concatenate([x, y[~hit]]) for x, y in ((old_ids, ids), (old_chars, chars), (old_sizes, sizes)))
        return _pack(key[0].as_py(), shards, digests, ids, chars, sizes)

    return f


def shard_of(digest, shards: int):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def learn(rows: DataFrame, history: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """The history (one row a shard) after a delivery of rows (doc_id, digest, n_chars)."""
    spark = rows.sparkSession
    groups = group_digests(rows)
    if history is None:
        history = spark.createDataFrame([], SHARD_DDL)
    else:
        shards = shards or (history.first() or {"shards": None})["shards"]
    shards = shards or max(1, -(-rows.count() // DIGESTS_PER_SHARD))
    grown = groups.withColumn("shard", shard_of(F.col("digest"), shards)).groupBy("shard").cogroup(history.groupBy("shard")).applyInArrow(_merge(shards), SHARD_DDL)
    return materialise(grown, "digest-history")


def entries(history: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every digest; keep_id is null where no row of the group has an id."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                digests, ids, chars, sizes = _unpack(b.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(ids, mask=chars == NO_ID), pa.array(sizes)], names=["digest", "keep_id", "group_size"])

    return history.mapInArrow(f, ENTRY_DDL)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The fate of every row: doc_id, keep_id, group_size, kept, digest, n_chars.

    Texts are equal when identical without their blanks (space, tab to carriage return); null counts
    as empty. Of equal texts the row with the most code points in the original text stays, then the
    smallest doc_id. docs: doc_id long, text string; other columns are ignored. A null doc_id loses
    against any other and its row is never kept where its group has another; the rows of a group
    without any id all stay. Rows that repeat the winning doc_id are all kept = (doc_id = keep_id), so
    drop repeated ids before if that matters. An empty table gives an empty table.

    With a history (of `learn`), its rows count too: they win or lose by the same rule, keep_id may
    be one of theirs, and group_size includes them. Rows whose digest occurs once are not looked up
    again; the others meet their entry in a join that splits hot digests at run time.
    """
    rows = materialise(digests_of(docs), "digests")
    if history is None:
        shards = max(1, -(-rows.count() // DIGESTS_PER_SHARD))
        early = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
        history = learn(rows.filter(early), None, shards)
        history = learn(rows.filter(~early), history, shards)
    else:
        history = learn(rows, history)
    repeated = entries(history).filter("group_size > 1")
    out = rows.join(repeated, "digest", "left")
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "digest", "n_chars")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for it."""
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
