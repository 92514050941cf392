"""Token ids in training order: fixed-stride binary shards.

Every document's ids end with an end token and are cut into sequences of a fixed length, the last
one filled up with end tokens. A keyed Feistel permutation over the next power of four, walked along
its cycle until it falls below the number of sequences, gives every sequence its own global slot, so
the training order needs no sort by random keys and can be computed from (rank, key) alone. A shard
holds a range of slots; a sequence lies at byte (slot - first slot) * stride of its shard's payload,
so a reader can start at any slot.

A sequence's rank is its place in the input in order of file and row, so it does not depend on how
files are split over tasks. Each task counts the sequences of the stretches of rows that it reads;
only one count per stretch travels to the driver. Range partitions then hold consecutive shards.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import runs
from ._store import keyed_text, materialise, partitions, table
from ._words import mix

SEQUENCE = 256
SLOTS_PER_SHARD = 1 << 15
FLUSH_BYTES = 48 << 20
ROUNDS = 4
SHARD_DDL = "shard long, first_slot long, n_slots long, stride int, payload binary, doc_ids binary, seqs binary, n_tokens binary"


def slots_of(rank: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each rank: a permutation of 0 to total - 1."""
    half = max(1, ((max(total - 1, 1)).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = rank.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= total]
    return out.astype(np.int64)


def rank_codec(path: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """A coder for a .tiktoken rank file, made once in each process."""

    def make():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(coder.encode_ordinary(text), np.uint16)

    return make


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and where the row stands: file and row. What is not read from files is written first."""
    try:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return _placed(materialise(keyed_text(docs), "sequence-input"))


def write_shards(docs: DataFrame, codec: Callable, end: int, key: int, length: int = SEQUENCE, slots_per_shard: int = SLOTS_PER_SHARD, done: DataFrame | None = None) -> DataFrame:
    """Write all sequences of all documents; returns the table of shards, one row each, read back from the shared folder.

    codec() makes a function from text to uint16 ids; end is the id that closes and fills up. Null and
    empty texts are one sequence of end tokens. docs: doc_id long, text string; other columns are
    ignored; repeated rows are written repeatedly; a null doc_id is written as -2**63. An empty table
    gives no shards. Shards that `done` (a table of shards of the same docs, key and sizes) already
    holds are not written again but returned with the others, so a broken run can be taken up.
    """
    no_id = -(2**63)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, first, before, at = codec(), None, 0, -1, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                ids = [np.append(coder(t or ""), np.uint16(end)) for t in b["text"].to_pylist()]
                n = [-(-len(x) // length) for x in ids]
                files, firsts, starts = [], [], []
                for f, row, k in zip(b["file"].to_pylist(), b["row"].to_pylist(), n, strict=True):
                    if f != file or row < before:  # a new stretch of rows
                        file, first, at = f, row, 0
                    files.append(file)
                    firsts.append(first)
                    starts.append(at)
                    before, at = row, at + k
                yield pa.RecordBatch.from_arrays([b["doc_id"].fill_null(no_id), pa.array(files), pa.array(firsts), pa.array(starts), pa.array(n, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], names=["doc_id", "file", "first", "start", "n", "ids"])

    coded = materialise(_placed(docs).mapInArrow(code, "doc_id long, file string, first long, start long, n long, ids binary"), "coded")
    sizes = coded.groupBy("file", "first").agg(F.max(F.col("start") + F.col("n")).alias("n")).orderBy("file", "first").collect()  # one row per stretch, at most a few a task
    offsets, total = {}, 0
    for row in sizes:
        offsets[row["file"], row["first"]] = total
        total += row["n"]
    written = {r["shard"] for r in done.select("shard").collect()} if done is not None else set()  # one number per shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs_, firsts, starts, ns = (batch[c].to_numpy() for c in ("doc_id", "first", "start", "n"))
            files = batch["file"].to_pylist()
            for i, blob in enumerate(batch["ids"].to_pylist()):
                n, ids = int(ns[i]), np.frombuffer(blob, "<u2")
                block = np.full(n * length, end, "<u2")
                block[: len(ids)] = ids
                fill = np.full(n, length, np.int32)
                fill[-1] = len(ids) - (n - 1) * length
                held.append((offsets[files[i], int(firsts[i])] + starts[i] + np.arange(n), np.full(n, docs_[i]), np.arange(n), fill, block.reshape(n, length)))
                size += block.nbytes
                if size >= FLUSH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        rank, doc, seq, fill, block = (np.concatenate(x) for x in zip(*held, strict=True))
        slot = slots_of(rank, total, key)
        order = np.argsort(slot)
        if written:
            order = order[~np.isin(slot[order] // slots_per_shard, list(written))]
        slot, doc, seq, fill, block = slot[order], doc[order], seq[order], fill[order], block[order]
        to = slot // slots_per_shard
        at, size = runs(to)
        cut = [slice(a, a + n) for a, n in zip(at, size, strict=True)]
        pack = lambda x: pa.array([pa.compress(np.ascontiguousarray(x[c]).tobytes(), codec="zstd", asbytes=True) for c in cut], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array(size), pack(slot.astype("<i8")), pack(doc.astype("<i8")), pack(seq.astype("<i4")), pack(fill.astype("<i4")), pack(block)], names=["shard", "n", "slots", "docs", "seqs", "fills", "block"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # in order of the shard
            at, size = runs(batch["shard"].to_numpy())
            for a, n in zip(at.tolist(), size.tolist(), strict=True):
                if held and held[0]["shard"][0] != batch["shard"][a]:
                    yield record(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, n))
        if held:
            yield record(pa.Table.from_batches(held))

    def record(t: pa.Table) -> pa.RecordBatch:
        n = t["n"].to_numpy()
        open_ = lambda c, kind, width=1: np.concatenate([np.frombuffer(pa.decompress(b, int(k) * width * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) for b, k in zip(t[c].to_pylist(), n, strict=True)])
        slot = open_("slots", "<i8")
        order = np.argsort(slot)
        block = open_("block", "<u2", length).reshape(-1, length)[order]
        shard = t["shard"][0].as_py()
        cols = [open_(c, k)[order].tobytes() for c, k in (("docs", "<i8"), ("seqs", "<i4"), ("fills", "<i4"))]
        row = [pa.array([shard]), pa.array([shard * slots_per_shard]), pa.array([len(slot)]), pa.array([2 * length], pa.int32()), *(pa.array([x], pa.binary()) for x in (block.tobytes(), *cols))]
        return pa.RecordBatch.from_arrays(row, names=["shard", "first_slot", "n_slots", "stride", "payload", "doc_ids", "seqs", "n_tokens"])

    dealt = coded.mapInArrow(deal, "shard long, n long, slots binary, docs binary, seqs binary, fills binary, block binary")
    shards = max(1, -(-total // slots_per_shard))
    ranges = min(shards, partitions(docs.sparkSession))
    dealt = dealt.repartitionById(ranges, F.expr(f"cast(shard * {ranges} div {shards} as int)")).sortWithinPartitions("shard")
    new = materialise(dealt.mapInArrow(assemble, SHARD_DDL), "shards")
    return new if done is None else done.select(*new.columns).unionByName(new)


def read_slots(shards: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """Sequences in training order from slot `first` on: slot, shard, byte_offset, doc_id, seq, n_tokens, ids (binary, uint16 little-endian).

    Only the shards in the range are read, and of these only the records in it are unpacked.
    """
    wanted = shards.filter(F.col("first_slot") + F.col("n_slots") > first)
    if count is not None:
        wanted = wanted.filter(F.col("first_slot") < first + count)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                a = max(first - r["first_slot"], 0)
                b = r["n_slots"] if count is None else min(r["n_slots"], first + count - r["first_slot"])
                stride, doc, seq, n = r["stride"], np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["seqs"], "<i4"), np.frombuffer(r["n_tokens"], "<i4")
                for lo in range(a, b, 4096):
                    at = np.arange(lo, min(lo + 4096, b))
                    ids = [r["payload"][i * stride : (i + 1) * stride] for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(r["first_slot"] + at), pa.array([r["shard"]] * len(at)), pa.array(at * stride), pa.array(doc[at]), pa.array(seq[at]), pa.array(n[at]), pa.array(ids, pa.binary())], names=["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "ids"])

    return wanted.mapInArrow(f, "slot long, shard long, byte_offset long, doc_id long, seq int, n_tokens int, ids binary")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    """All sequences of all documents as they stand in the shards, with a checksum of their record."""
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), rank_codec(public_tokenizers.path("byte_bpe_50k.tiktoken")), end=50256, key=20240611)
    return read_slots(shards).select("slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", F.crc32("ids").alias("record_crc32"))
