"""Measures of paragraphs, lines and sentences that need no lexicon of a language. A newline ends a paragraph; blank ones do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions.markers import NUMBER, connector_of, ending_of, mood_of
from proselake.functions.text import normal_words, sentence_array, sentences, strip
from proselake.plans.windows import runs

#: Bounds of the sentence-length classes (first, last).
BUCKETS = [(1, 5), (6, 10), (11, 15), (16, 20), (21, 30), (31, 10**9)]


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("int"))


def _blank(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), text, sentences (their number)."""
    lines = docs.select("doc_id", F.posexplode(F.split(_blank(), "\n")).alias("paragraph", "text"))
    return lines.withColumn("sentences", F.size(sentence_array(F.col("text")))).filter("sentences > 0")


def sentence_features(docs: DataFrame) -> DataFrame:
    s, text = sentences(docs), F.col("sentence")
    s = s.withColumn("ending", ending_of(text))
    return s.select("doc_id", "pos", "words", "ending", mood_of(text, F.col("ending")).alias("mood"), connector_of(text).alias("connector"), F.regexp_count(text, F.lit(",")).alias("commas"), F.regexp_count(text, F.lit(NUMBER)).alias("numbers"))


def fragment_runs(docs: DataFrame, longest: int = 2, least: int = 3) -> DataFrame:
    """At least `least` paragraphs in a row of at most `longest` sentences."""
    p = paragraph_rows(docs).select("doc_id", "paragraph", (F.col("sentences") <= longest).alias("short"))
    return runs(p, ["doc_id"], "paragraph", "short", least).filter("short").drop("short")


def fact_lists(docs: DataFrame, least: int = 3, mean: int = 8) -> DataFrame:
    """Paragraphs of short sentences without a question or connector."""
    lines = docs.select("doc_id", F.posexplode(F.split(_blank(), "\n")).alias("paragraph", "text"))
    s = sentences(lines, "paragraph").groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("sentences"), F.sum("words").alias("words"), F.max((F.col("sentence").endswith("?") | connector_of(F.col("sentence")).isNotNull()).cast("int")).alias("joined"))
    return s.filter((F.col("sentences") >= least) & (F.col("words") <= mean * F.col("sentences")) & (F.col("joined") == 0)).drop("joined")


def flow_valleys(docs: DataFrame, least: int = 2) -> DataFrame:
    """Paragraphs that share no word with the one before, both of `least` sentences or more."""
    p = paragraph_rows(docs).select("doc_id", "paragraph", "sentences", F.array_distinct(normal_words(F.col("text"))).alias("w"))
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    p = p.withColumn("v", F.lag("w").over(w)).withColumn("before", F.lag("sentences").over(w))
    return p.filter((F.col("before") >= least) & (F.col("sentences") >= least) & (F.size(F.array_intersect("w", "v")) == 0)).select("doc_id", "paragraph")


def wrapped_lines(docs: DataFrame) -> DataFrame:
    """Pairs of adjacent lines with text, and those whose first one lacks an end mark; no rows are exploded."""
    lines = F.col("l")
    d = docs.select("doc_id", F.transform(F.split(_blank(), "\n"), strip).alias("l"))
    d = d.withColumn("pairs", F.filter("l", lambda x, i: (x != "") & (F.get(lines, i + 1) != "")))
    return d.select("doc_id", F.size("pairs").alias("pairs"), F.size(F.filter("pairs", lambda x: ~F.right(x, F.lit(1)).isin(".", "?", "!"))).alias("wrapped"))


def dash_lines(docs: DataFrame) -> DataFrame:
    """Lines (from 1) with an en or em dash."""
    lines = docs.filter(F.col("text").rlike("[–—]")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.filter(F.col("l").rlike("[–—]")).select("doc_id", (F.col("line") + 1).alias("line"))


def rhythm(docs: DataFrame) -> DataFrame:
    """Sentences of each length class per language; empty classes give 0."""
    return sentences(docs, "lang").groupBy("lang").agg(*[_count(F.col("words").between(a, b)).alias(f"from_{a}") for a, b in BUCKETS])


def share_at_least(docs: DataFrame, value: int = 20) -> DataFrame:
    """Sentences of `value` words or more, in thousandths, per language."""
    return sentences(docs, "lang").groupBy("lang").agg(F.expr(f"sum(int(words >= {value})) * 1000 div count(1)").alias("permille"))


def density(docs: DataFrame) -> DataFrame:
    """Commas, numbers and questions per 1,000 words of each document with words."""
    s, text = sentences(docs), F.col("sentence")
    s = s.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum(F.regexp_count(text, F.lit(","))).alias("commas"), F.sum(F.regexp_count(text, F.lit(NUMBER))).alias("numbers"), _count(text.endswith("?")).alias("questions"))
    return s.filter("words > 0").select("doc_id", "words", *[F.expr(f"{c} * 1000 div words").alias(c) for c in ("commas", "numbers", "questions")])


def vocabulary(docs: DataFrame) -> DataFrame:
    """Tokens and distinct words of each document."""
    w = normal_words(_blank())
    return docs.select("doc_id", F.size(w).alias("tokens"), F.size(F.array_distinct(w)).alias("types"))


def top_words(docs: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent words of each document; ties by word."""
    n = docs.select("doc_id", F.explode(normal_words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= top)


def length_deltas(docs: DataFrame) -> DataFrame:
    """Differences in words between neighbouring sentences: number, sum and largest."""
    d = F.abs(F.col("words") - F.lag("words").over(Window.partitionBy("doc_id").orderBy("pos")))
    return sentences(docs).withColumn("d", d).filter("d is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("d").alias("total"), F.max("d").alias("largest"))


def phrase_dominance(docs: DataFrame, pattern: str = r"\bthe\b", share: float = 0.08, sentences_least: int = 8) -> DataFrame:
    """Documents where more than `share` of at least `sentences_least` sentences, two or more, match a pattern."""
    s = sentences(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), _count(F.lower("sentence").rlike(pattern)).alias("hits"))
    return s.filter((F.col("sentences") >= sentences_least) & (F.col("hits") >= 2) & (F.col("hits") > share * F.col("sentences")))


def stable_ids(docs: DataFrame) -> DataFrame:
    """Ids from the content: 16 hex digits of the SHA-256 of source and text."""
    return docs.select("doc_id", F.substring(F.sha2(F.concat_ws("\n", "source", "text"), 256), 1, 16).alias("stable_id"))


def added_findings(docs: DataFrame, before: int = 40, after: int = 30) -> DataFrame:
    """Multiset difference of long-sentence signatures under a stricter limit and a looser one."""
    s = sentences(docs, "lang").select("lang", "words")
    return s.filter(F.col("words") > after).exceptAll(s.filter(F.col("words") > before)).groupBy("lang", "words").agg(F.count(F.lit(1)).alias("n"))


def risk_coverage(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Errors among all predictions at or above each confidence; confidences are whole thousandths, so the running sum sees 1,001 rows at most."""
    p = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    wrong = (F.col("quality") != (F.col("n_chars") >= 1500).cast("int")).cast("int")
    p = p.select(F.expr("least(abs(n_chars - 1500), 1500) * 1000 div 1500").alias("confidence"), wrong.alias("wrong"))
    p = p.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("wrong"))
    w = Window.orderBy(F.desc("confidence"))
    return p.select("confidence", F.sum("n").over(w).alias("covered"), F.sum("wrong").over(w).alias("wrong"))


def strict_consensus(labels: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """Three ratings of a document: more than half of those given decide, if there are `least` or more."""
    p = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    p = p.select("doc_id", F.array_compact(F.array(F.col("quality").cast("int"), (F.col("n_chars") >= 1500).cast("int"), 1 - F.col("toxic").cast("int"))).alias("r"))
    p = p.select("doc_id", F.size("r").alias("answered"), F.size(F.filter("r", lambda x: x == 1)).alias("yes"))
    verdict = F.when(F.col("answered") < least, "none").when(2 * F.col("yes") > F.col("answered"), "yes").when(2 * F.col("yes") < F.col("answered"), "no").otherwise("none")
    return p.withColumn("verdict", verdict)
