"""A usage index as tables that is built once and read by term: sentences, postings, terms, and what stands beside a word.

`build` writes three tables: `sentences` (id, sentence, key, documents, first source, length in tokens), `postings` (term, id, tf)
sorted by term, so that a query reads the row groups of its terms only, and `terms` (term, df). All work is joins and aggregations
on terms and keys; no list of a term's sentences is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import tokens
from proselake.functions.text import sentence_array, strip

K1, B = 1.5, 0.75
#: From so many sentences on, terms in more than half of them are passed over.
COMMON_FROM = 1000
SCALE = 1_000_000
#: Bullets, and what ends a sentence.
BULLETS = r"^(?:(?:[-*·•※]|\([0-9a-z]{1,2}\)|[0-9]{1,2}[.)])\s+|(?:\([가-힣]\)|[가-힣][.)])\s*)"
TERMINAL = r"(?<![0-9])[.!?][\"'”’)\]]*$"


def prose_lines(text: Column) -> Column:
    """Lines outside fences, headings and tables, without bullets. A line inside a fence has an odd number of fence marks before it."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    outside = F.regexp_replace(F.array_join(lines, "\n"), r"(?ms)^\s*(```|~~~).*?(^\s*\1\s*$|\z)", "")
    kept = F.filter(F.split(outside, "\n"), lambda x: (strip(x) != "") & ~x.rlike(r"^\s*(#{1,6}\s|\|)"))
    return F.transform(kept, lambda x: strip(F.regexp_replace(strip(x), BULLETS, "")))


def usable_sentences(text: Column, script: str = "[가-힣A-Za-z]") -> Column:
    """Sentences with a letter of the script and an end mark."""
    return F.filter(F.flatten(F.transform(prose_lines(text), sentence_array)), lambda s: s.rlike(script) & s.rlike(TERMINAL))


def index_sentences(docs: DataFrame, source: str = "doc_id") -> DataFrame:
    """Distinct sentences by key: id, sentence and source of the first document, number of documents. docs: doc_id, text."""
    s = docs.select("doc_id", F.col(source).alias("source"), F.posexplode(usable_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("key", tokens.sentence_key(F.col("sentence")))
    per_doc = s.groupBy("key", "doc_id").agg(F.min(F.struct("pos", "sentence", "source")).alias("f"))
    first = F.min(F.struct("doc_id", F.col("f.pos").alias("pos"), F.col("f.sentence").alias("sentence"), F.col("f.source").alias("source"))).alias("f")
    k = per_doc.groupBy("key").agg(first, F.count(F.lit(1)).alias("documents"))
    return k.select(F.struct(F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos")).alias("id"), "f.sentence", "f.source", "key", "documents", F.size(tokens.index_tokens(F.col("f.sentence"))).alias("length"))


def index_postings(sentences: DataFrame) -> DataFrame:
    """(term, id, tf, length), counted inside the row: a sentence's terms never leave it before."""
    bag = tokens.index_tokens(F.col("sentence"))
    t = sentences.select("id", "length", F.array_sort(bag).alias("bag")).select("id", "length", "bag", F.explode(F.array_distinct("bag")).alias("term"))
    return t.select("term", "id", F.size(F.filter("bag", lambda x: x == F.col("term"))).alias("tf"), "length")


def build(docs: DataFrame, folder: str, source: str = "doc_id") -> None:
    """Write the index to a folder of any store."""
    spark = docs.sparkSession
    index_sentences(docs, source).write.mode("overwrite").parquet(f"{folder}/sentences")
    sentences = spark.read.parquet(f"{folder}/sentences")
    postings = index_postings(sentences)
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    sentences.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.sum("documents").alias("occurrences")).write.mode("overwrite").parquet(f"{folder}/meta")


class Index:
    """The tables of a built index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.sentences, self.postings, self.terms, self.meta = (spark.read.parquet(f"{folder}/{t}") for t in ("sentences", "postings", "terms", "meta"))
        self.spark = spark

    def lookup(self, term: str) -> tuple[str, int] | None:
        row = self.terms.filter(F.col("term") == term).first()
        return (row["term"], row["df"]) if row else None

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best sentences of one query. Its terms are known before the postings are read, so the filter reaches the files."""
        asked = self.spark.range(1).select(F.explode(F.array_distinct(tokens.index_tokens(F.lit(query)))).alias("term")).collect()  # the words of one query
        wanted = [r["term"] for r in asked]
        hits = scores(self.postings.filter(F.col("term").isin(wanted)), self.terms.filter(F.col("term").isin(wanted)), self.meta)
        best = hits.orderBy(F.desc("score"), "id").limit(limit)
        return self.sentences.join(F.broadcast(best), "id").select("id", "score", "sentence", "source", "documents").orderBy(F.desc("score"), "id")


def scores(postings: DataFrame, terms: DataFrame, meta: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, score) by BM25, floored to whole millionths. meta is one row."""
    hit = postings.join(terms, "term").join(F.broadcast(meta.select("n", "mean")), F.lit(True)).filter((F.col("n") < COMMON_FROM) | (F.col("df") * 2 <= F.col("n")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hit.groupBy(*keys, "id").agg(F.floor(F.sum(part) * SCALE + 1e-4).alias("score"))


def neighbours(docs: DataFrame, term: str, top: int = 8) -> DataFrame:
    """What stands before or after a word in most documents: (side, word, documents). The neighbour is the next element of the row's array."""
    w = F.transform(tokens.words(F.col("text")), lambda x: F.lower(tokens.strip_particle(x["core"])))
    d = docs.select("doc_id", w.alias("w")).filter(F.array_contains("w", term))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) == term)
    beside = F.flatten(F.transform(places, lambda i: F.array(F.struct(F.lit("before").alias("side"), F.get("w", i - 1).alias("word")), F.struct(F.lit("after").alias("side"), F.get("w", i + 1).alias("word")))))
    n = d.select("doc_id", F.explode(F.array_distinct(beside)).alias("b")).filter("b.word is not null").groupBy("b.side", "b.word").agg(F.count(F.lit(1)).alias("documents"))
    w_ = Window.partitionBy("side").orderBy(F.desc("documents"), "word")
    return n.withColumn("r", F.row_number().over(w_)).filter(F.col("r") <= top).drop("r")


def chain_documents(docs: DataFrame, longest: int = 4, least: int = 3) -> DataFrame:
    """(chain, documents): runs of 2 to `longest` words that `least` documents or more have."""
    w = docs.select(F.transform(tokens.words(F.col("text")), lambda x: x["core"]).alias("w"))
    grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    chains = F.array_distinct(F.flatten(F.array(*[grams(k) for k in range(2, longest + 1)])))
    return w.select(F.explode(chains).alias("chain")).groupBy("chain").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= least)


def pattern_documents(docs: DataFrame, entries: list, share: float = 0.0) -> DataFrame:
    """(dictionary, pattern, documents, conventional) of each lexicon entry that any document matches; conventional from a share of all documents on."""
    from proselake.operators.lexicon import match_entries

    m = match_entries(docs.select("doc_id", F.col("text").alias("sentence")), entries).select("doc_id", "dictionary", "pattern").distinct()
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    n = m.groupBy("dictionary", "pattern").agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(total), F.lit(True))
    return n.select("dictionary", "pattern", "documents", (F.col("documents") >= share * F.col("total")).alias("conventional"))


def attested(asked: DataFrame, chains: DataFrame, least: int = 3) -> DataFrame:
    """asked (chain) with the number of documents that have it and whether that is enough."""
    n = F.coalesce("documents", F.lit(0))
    return asked.join(chains, "chain", "left").select(*asked.columns, n.alias("documents"), (n >= least).alias("attested"))
