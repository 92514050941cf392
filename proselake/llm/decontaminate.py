"""Benchmark decontamination: which documents hold which test items.

Size-partitioned MinHash containment search. An item of n shingles counts as held by a document that
has need = ceil(t*n) of them; then any n - need + 1 of its shingles include one of the document's. So
each item gets a sketch, its smallest hash values, whose length is fixed for its size class (sizes of
one power of two) by the class's largest size. Only sketches meet the shingles of the documents. What
they find are candidates, and these are verified by the exact containment of all shingles. All work
is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import keyed_text, materialise, table

BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Item shingles, and ids of candidates, up to this number are broadcast (about 20 MB); beyond, the join is shuffled.
BROADCAST_ROWS = 200_000


def shingle_array(text, k: int):
    """Fingerprints of all k-word windows; of a shorter text, that of its whole sequence; none of an empty one."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANKS), lambda w: w != "")
    names = F.transform(words, lambda w: F.xxhash64(w))

    def windows(a):
        return F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(k)]))).when(F.size(a) > 0, F.array(F.xxhash64(F.size(a), a))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(names), windows), F.lit(0))  # binds the words once


def item_shingles(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_id, h, n_item, need), one row per distinct shingle of an item."""
    own = items.filter("item_id is not null").select("item_id", F.explode(shingle_array(F.col("text"), k)).alias("h")).distinct()
    sized = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    return own.join(sized, "item_id").withColumn("need", F.floor((F.col("n_item") * percent + 99) / 100))


def sketches(own: DataFrame, percent: int) -> DataFrame:
    """(h, item_id): the smallest hash values of each item, as many as its size class needs."""
    top = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    length = top - F.floor((top * percent + 99) / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit("sketch")), "h"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= length).select("h", "item_id")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(docs: DataFrame, sketch: DataFrame, k: int) -> DataFrame:
    """(doc_id, item_id) of documents that have a shingle of an item's sketch."""
    said = docs.select("doc_id", F.explode(shingle_array(F.col("text"), k)).alias("h"))
    return said.join(_small(sketch), "h").select("doc_id", "item_id").distinct()


def find_contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least `percent` of the item's distinct k-word shingles.

    Columns: doc_id, item_id, n_item (shingles of the item), n_common, containment. Words are split
    at blanks after lower-casing A-Z. A text of fewer than k words is one shingle, its whole
    sequence: such an item is found only in documents that are that sequence. Null or empty texts
    hold nothing and are found nowhere. docs: doc_id, text; items: item_id, text; other columns are
    ignored. Rows that repeat a doc_id or item_id count as one text with the shingles of all (so no
    document is passed over for the size of one of its rows); rows with a null id are left out.
    Empty tables give no pairs. Shingles are compared by 64-bit fingerprints.
    """
    docs = keyed_text(docs).filter("doc_id is not null")
    own = materialise(item_shingles(items, k, percent), "item-shingles")
    found = materialise(candidates(docs, sketches(own, percent), k), "leak-candidates")
    held = docs.join(_small(found.select("doc_id").distinct()), "doc_id", "left_semi")
    said = held.select("doc_id", F.explode(shingle_array(F.col("text"), k)).alias("h"))
    met = said.join(_small(own), "h").join(_small(found), ["doc_id", "item_id"], "left_semi").distinct()
    pairs = met.groupBy("doc_id", "item_id", "n_item", "need").agg(F.count(F.lit(1)).alias("n_common"))
    return pairs.filter("n_common >= need").select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All leaks of the benchmark into the documents."""
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY 1),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, c AS n_common, c / n AS containment FROM c JOIN n ON n.id = item_id WHERE 100 * c >= 80 * n
"""
