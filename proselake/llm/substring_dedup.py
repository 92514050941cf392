"""Substring deduplication by recompression.

Words are named by fingerprints. Round 1 collapses runs of one word and then names pairs: a bit of
a word's name makes it a left or a right word, and each left word followed by a right one becomes
one symbol, named by its two parts. Round 2 names pairs of those symbols in the same way. Names
depend on content alone, so equal substrings get equal interior symbols in every document, with no
table of names to keep. A symbol over the words [s, e) is fixed by the words [s-1, e+1): the words
beside it end its runs, and whether they are left or right words is their own matter.

Spark exchanges the round-2 symbols. A window of 13 words that holds a symbol, with the two words
beside it, that no other document has cannot be a repeat; the windows left are verified by an
exchange of two independent keyed fingerprints of the windows themselves (96 bits). A window that holds no such symbol (periodic
text, for one) is verified too, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import BLOCK_DDL, Packer, member, replies
from ._store import keyed_text, partitions, table
from ._words import _COEF, Slice, mix, new_secret, slices

OUT_DDL = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,count:long>>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", SPANS)])


def _pairs(name: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, side: np.ndarray, salt: int):
    """One round of pair naming: the new sequence and which of its symbols are new."""
    joins = np.zeros(len(name), bool)
    joins[:-1] = side[:-1] & ~side[1:] & (text[:-1] == text[1:])
    eaten = np.zeros(len(name), bool)
    eaten[1:] = joins[:-1]
    at = np.flatnonzero(joins)
    name, end = name.copy(), end.copy()
    name[at] = mix(name[at] * _COEF[salt] + name[at + 1] * _COEF[salt + 1])
    end[at] = end[at + 1]
    keep = ~eaten
    return name[keep], begin[keep], end[keep], text[keep], joins[keep]


def symbols(s: Slice, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Round-2 symbols that some window can hold with the words beside them: name, first word, end, text."""
    text = s.text_of
    if not len(text):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    new = np.r_[True, (s.word[1:] != s.word[:-1]) | (text[1:] != text[:-1])]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(text)]
    word = s.word[begin]
    n = (end - begin).astype(np.uint64)
    name = np.where(n > 1, mix(word + n * _COEF[42]), word)
    name, begin, end, text, _ = _pairs(name, begin, end, text[begin], (word >> np.uint64(17)) & np.uint64(1) == 0, 43)
    name, begin, end, text, is_new = _pairs(name, begin, end, text, (name >> np.uint64(23)) & np.uint64(1) == 0, 45)
    use = is_new & (end - begin + 2 <= window) & (begin > s.first[text]) & (end < s.first[text + 1])
    return name[use], begin[use], end[use], text[use]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)


def dedup_substrings(docs: DataFrame, window: int = 13, buckets: int | None = None) -> DataFrame:
    """Remove each word that a repeated window covers.

    A window is `window` consecutive words of one document; it is a repeat where its words also
    start in a document with a smaller doc_id. Windows are judged on the input.

    docs: doc_id long, text string; other columns are ignored. Returns one row per input row:
    doc_id, n_words, n_removed, kept (remaining words joined by one space) and the removed spans as
    word positions. Null or empty texts have no words. Rows with the same doc_id count as one
    document when windows are compared; a row with a null doc_id loses nothing and makes no other
    row lose anything. An empty table gives an empty table.
    """
    docs = keyed_text(docs)
    named = docs.filter("doc_id is not null")
    buckets = buckets or partitions(docs.sparkSession)
    secret = new_secret()

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, later_only=False)
        for batch in batches:
            ids = _ids(batch)
            for s in slices(batch["text"], lower=False, secret=secret):
                name, _, _, text = symbols(s, window)
                yield from packer.add(name, ids[s.lo + text])
        yield from packer.flush()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, later_only=True)
        for batch in batches:
            ids = _ids(batch)
            told = batch["told"].to_pylist()
            for s in slices(batch["text"], lower=False, secret=secret, lanes=2):
                name, begin, end, text = symbols(s, window)
                alone = ~member(text, name, told[s.lo : s.hi])
                begin, end, first = begin[alone], end[alone], s.first[text[alone]]
                h, whole = s.ngrams(window)
                out = np.zeros(len(s.word) + 1, np.int64)
                np.add.at(out, np.maximum(end + 1 - window, first), 1)
                np.add.at(out, begin, -1)
                at = np.flatnonzero(whole & (np.cumsum(out)[: len(h)] == 0))
                yield from packer.add(h[at], ids[s.lo + s.text_of[at]], s.ngrams(window, s.other)[0][at])
        yield from packer.flush()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch["told"].to_pylist()
            for s in slices(batch["text"], lower=False, secret=secret):
                gone = np.zeros(len(s.word), bool)
                if any(told[s.lo : s.hi]):
                    h, whole = s.ngrams(window)
                    at = np.flatnonzero(whole)
                    at = at[member(s.text_of[at], h[at], told[s.lo : s.hi])]
                    cover = np.zeros(len(s.word) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                kept, removed, spans = [], [], []
                raw = s.data.tobytes()
                for i in range(s.hi - s.lo):
                    a, b = s.first[i], s.first[i + 1]
                    g = gone[a:b]
                    words = raw[s.begin[a] : s.end[b - 1]].decode() if b > a else ""
                    words = words.translate(_BLANKS).split(" ") if words else []
                    words = [w for w in words if w]
                    if g.any():
                        words = [w for w, x in zip(words, g.tolist(), strict=True) if not x]
                        edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                        spans.append([{"first": int(x), "count": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    else:
                        spans.append([])
                    kept.append(" ".join(words))
                    removed.append(int(g.sum()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(s.lo, s.hi - s.lo), pa.array(s.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, SPANS)], schema=OUT)

    shared = replies(named.mapInArrow(reveal, BLOCK_DDL), buckets, later_only=False)
    windows = named.join(shared, "doc_id", "left").select("doc_id", "text", "told").mapInArrow(verify, BLOCK_DDL)
    repeats = replies(windows, buckets, later_only=True)
    return named.join(repeats, "doc_id", "left").select("doc_id", "text", "told").unionByName(docs.filter("doc_id is null").withColumn("told", F.lit(None).cast("binary"))).mapInArrow(cut, OUT_DDL)


_BLANKS = {c: " " for c in range(9, 14)}


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words kept of every document; a digest stands for the text."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM rep),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT pos.doc_id, string_agg(ws[pos.p], ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
