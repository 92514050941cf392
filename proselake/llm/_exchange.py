"""Exchange of (document, fingerprint) pairs by fingerprint, packed in blocks.

A block is one row (bucket, hs, docs): fingerprints whose bucket is `h % buckets`, with their
documents. Before anything is shuffled, `Packer` combines what one task has seen: of equal
fingerprints only one entry, that of the smallest document, leaves the task. So a fingerprint that
a third of all documents hold costs one entry a flush, not one a document, and no bucket grows with it.
What a task can already answer for the others it answers itself. Answers are blocks too, their
bucket is `doc_id % buckets`, so that a document's answers come together in one row.

Where a false equality would cost words, entries carry 32 bits of a second, independent fingerprint
and are equal only if both are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import mix

BLOCK_DDL = "bucket int, answer boolean, hs binary, docs binary, others binary"
BLOCK = pa.schema([("bucket", pa.int32()), ("answer", pa.bool_()), ("hs", pa.binary()), ("docs", pa.binary()), ("others", pa.binary())])
TOLD_DDL = "doc_id long, told binary"
TOLD = pa.schema([("doc_id", pa.int64()), ("told", pa.binary())])
FLUSH = 1 << 20
SEEN = np.uint64(1 << 63)
LOW = np.uint64((1 << 32) - 1)
BODY = np.uint64((1 << 63) - 1)


def pack_docs(docs: np.ndarray) -> bytes:
    return pa.compress(np.diff(docs, prepend=np.int64(0)).tobytes(), codec="zstd", asbytes=True)


def unpack_docs(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(blob, n * 8, codec="zstd", asbytes=True), np.int64))


def distinct_pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (h, doc), sorted by h, then doc."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def distinct_wide(h: np.ndarray, other: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, other, doc), sorted in this order."""
    order = np.lexsort((doc, other, h))
    h, other, doc = h[order], other[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1]) | (doc[1:] != doc[:-1])
    return h[new], other[new], doc[new]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(x)])


def wide_runs(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs in which both are equal."""
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])]) if len(h) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(h)])


def blocks_of(h: np.ndarray, doc: np.ndarray, buckets: int, answer: bool, other: np.ndarray | None = None) -> pa.RecordBatch:
    """Pairs as one row a bucket, in order of the document."""
    bucket = (doc % buckets if answer else (h & BODY) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((doc, bucket))
    h, doc, bucket = h[order], doc[order], bucket[order]
    start, size = runs(bucket)
    cut = [slice(a, a + n) for a, n in zip(start, size, strict=True)]
    others = pa.nulls(len(cut), pa.binary()) if other is None else pa.array([other[order][x].astype(np.uint32).tobytes() for x in cut], pa.binary())
    cols = [pa.array(bucket[start]), pa.array([answer] * len(cut), pa.bool_()), pa.array([h[x].tobytes() for x in cut], pa.binary()), pa.array([pack_docs(doc[x]) for x in cut], pa.binary()), others]
    return pa.RecordBatch.from_arrays(cols, schema=BLOCK)


def counted(doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Answers that hold, for each document, how often it is in `doc`."""
    ids, n = np.unique(doc, return_counts=True)
    return blocks_of(n.astype(np.uint64), ids, buckets, answer=True)


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hs = [np.frombuffer(b, np.uint64) for b in table["hs"].to_pylist()]
    docs = [unpack_docs(b, len(x)) for b, x in zip(table["docs"].to_pylist(), hs, strict=True)]
    return np.concatenate(hs), np.concatenate(docs)


def unpack_wide(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, doc = unpack(table)
    return h, np.concatenate([np.frombuffer(b, np.uint32) for b in table["others"].to_pylist()]).astype(np.uint64), doc


class Packer:
    """Gathers pairs and flushes them as blocks and local replies.

    later_only: a reply goes to documents above the smallest one with the fingerprint;
    otherwise to every document whose fingerprint another document has too.
    counts: replies are numbers of fingerprints. Then each pair is answered once: here, or by its
    bucket if it left the task; the top bit of a fingerprint says that the task has seen it shared.
    With second fingerprints, add() gets them in every call.
    """

    def __init__(self, buckets: int, later_only: bool, counts: bool = False):
        self.buckets, self.later_only, self.counts = buckets, later_only, counts
        self.h: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.other: list[np.ndarray] = []
        self.n = 0

    def add(self, h: np.ndarray, doc: np.ndarray, other: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.h.append(h & BODY if self.counts else h)
        self.doc.append(doc)
        if other is not None:
            self.other.append(other & LOW)
        self.n += len(h)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        if self.other:
            h, other, doc = distinct_wide(np.concatenate(self.h), np.concatenate(self.other), np.concatenate(self.doc))
            start, size = wide_runs(h, other)
        else:
            (h, doc), other = distinct_pairs(np.concatenate(self.h), np.concatenate(self.doc)), None
            start, size = runs(h)
        self.h, self.doc, self.other, self.n = [], [], [], 0
        told = np.repeat(size > 1, size)
        if self.later_only or self.counts:
            told[start] = False
        if told.any():
            yield counted(doc[told], self.buckets) if self.counts else blocks_of(h[told], doc[told], self.buckets, answer=True)
        if self.counts:
            h[start[size > 1]] |= SEEN
        yield blocks_of(h[start], doc[start], self.buckets, answer=False, other=None if other is None else other[start])


def meet(buckets: int, later_only: bool):
    """For applyInArrow over one bucket: answers to the documents whose entries met others; earlier answers pass through."""

    def f(table: pa.Table) -> pa.Table:
        done = table.filter(table["answer"])
        table = table.filter(pc.invert(table["answer"]))
        if not len(table):
            return done
        if table["others"].null_count:
            h, doc = distinct_pairs(*unpack(table))
            start, size = runs(h)
        else:
            h, other, doc = distinct_wide(*unpack_wide(table))
            start, size = wide_runs(h, other)
        told = np.repeat(size > 1, size)
        if later_only:
            told[start] = False
        return pa.concat_tables([done, pa.Table.from_batches([blocks_of(h[told], doc[told], buckets, answer=True)], BLOCK)])

    return f


def meet_counts(buckets: int):
    """As meet, with numbers for answers."""

    def f(table: pa.Table) -> pa.Table:
        done = table.filter(table["answer"])
        table = table.filter(pc.invert(table["answer"]))
        if not len(table):
            return done
        h, doc = unpack(table)
        order = np.lexsort((doc, h & BODY))
        h, doc = h[order], doc[order]
        start, size = runs(h & BODY)
        shared = (doc[start] != doc[start + size - 1]) | np.logical_or.reduceat(h >= SEEN, start)
        return pa.concat_tables([done, pa.Table.from_batches([counted(doc[np.repeat(shared, size)], buckets)], BLOCK)])

    return f


def gather_counts(table: pa.Table) -> pa.Table:
    """For applyInArrow over one bucket of answers: one row per document."""
    n, doc = unpack(table)
    ids, at = np.unique(doc, return_inverse=True)
    return pa.table({"doc_id": ids, "shared": np.bincount(at, n.astype(np.float64), len(ids)).astype(np.int64)})


def shared_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """One row per document that has any: doc_id and the number of its fingerprints that others have too."""
    met = blocks.groupBy("bucket").applyInArrow(meet_counts(buckets), BLOCK_DDL)
    return met.groupBy("bucket").applyInArrow(gather_counts, "doc_id long, shared long")


def gather(table: pa.Table) -> pa.Table:
    """For applyInArrow over one bucket of answers: one row per document."""
    doc, h = distinct_pairs(*reversed(unpack(table)))
    start, size = runs(doc)
    blobs = [h[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    return pa.Table.from_arrays([pa.array(doc[start]), pa.array(blobs, pa.binary())], schema=TOLD)


def replies(blocks: DataFrame, buckets: int, later_only: bool) -> DataFrame:
    """One row per document that has any: doc_id and told, its distinct fingerprints."""
    met = blocks.groupBy("bucket").applyInArrow(meet(buckets, later_only), BLOCK_DDL)
    return met.groupBy("bucket").applyInArrow(gather, TOLD_DDL)


def member(text: np.ndarray, h: np.ndarray, told: list[bytes | None]) -> np.ndarray:
    """Which (text, h) the blobs in told[text] hold."""
    key = [(i, np.frombuffer(x, np.uint64)) for i, x in enumerate(told) if x]
    if not key or not len(h):
        return np.zeros(len(h), bool)
    salt = mix(np.arange(1, len(told) + 1, dtype=np.uint64))
    have = np.concatenate([x ^ salt[i] for i, x in key])
    return np.isin(h ^ salt[text], have)
