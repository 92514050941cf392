"""Measures and rules over the sentences of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions.markers import HEDGES, count_of
from proselake.functions.tokens import sentence_key
from proselake.functions.text import normal_words, numerals, sentences, strip
from proselake.plans.windows import first_occurrence, percentiles, runs

LONG = 30
CAP = 200
#: A small English lexicon in file order (pattern, why).
LEXICON = [("of the", "chain"), ("in the", "chain"), ("the", "article"), ("license", "legal"), ("copyright", "legal")]


def sentence_stats(docs: DataFrame) -> DataFrame:
    return sentences(docs, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.sum("words").alias("words"), F.sum((F.col("words") > LONG).cast("int")).alias("long_sentences"))


def long_sentences(docs: DataFrame) -> DataFrame:
    return sentences(docs).filter(F.col("words") > LONG).select("doc_id", "pos", "words")


def length_histogram(docs: DataFrame) -> DataFrame:
    return sentences(docs, "lang").groupBy("lang", F.least("words", F.lit(CAP)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def length_percentiles(docs: DataFrame) -> DataFrame:
    return percentiles(length_histogram(docs), ["lang"], "value", "n", (50, 90, 95, 99))


def outside_profile(docs: DataFrame) -> DataFrame:
    """Sentences longer than the 99th percentile of their language; the profile has one row per language."""
    profile = length_percentiles(docs).select("lang", "p99")
    return sentences(docs, "lang").join(profile, "lang").filter(F.least("words", F.lit(CAP)) > F.col("p99")).select("doc_id", "pos", "words", "p99")


def sentence_values(docs: DataFrame) -> DataFrame:
    """doc_id, pos, lang, measure and value: length in words, commas, words that no earlier sentence has, hedges."""
    s = sentences(docs, "lang").join(new_topics(docs), ["doc_id", "pos"], "left")
    commas = F.length("sentence") - F.length(F.replace("sentence", F.lit(","), F.lit("")))
    values = {"length": F.col("words"), "commas": commas, "newTopics": F.coalesce("new_words", F.lit(0)), "hedges": count_of(F.col("sentence"), HEDGES)}
    return s.select("doc_id", "pos", "lang", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("long").alias("value")) for k, v in values.items()])).alias("m")).select("doc_id", "pos", "lang", "m.*")


def outside_profile_measures(docs: DataFrame) -> DataFrame:
    """Sentences that exceed the 99th percentile of their language in any measure, with the measure; a percentile of 0 disables it.

    Histograms end at CAP, values are compared as they are.
    """
    values = sentence_values(docs)
    hist = values.groupBy("lang", "measure", F.least("value", F.lit(CAP)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    profile = percentiles(hist, ["lang", "measure"], "value", "n", (99,)).filter("p99 > 0").withColumnsRenamed({"lang": "l", "measure": "m"})
    over = F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")) & (F.col("value") > F.col("p99"))
    return values.join(F.broadcast(profile), over).select("doc_id", "pos", "measure", "value", "p99")


def initial_word_runs(docs: DataFrame) -> DataFrame:
    s = sentences(docs).withColumn("word", F.lower(F.regexp_extract("sentence", r"^([A-Za-z]+)", 1)))
    return runs(s, ["doc_id"], "pos", "word", 2).filter("word <> ''")


def ending_runs(docs: DataFrame) -> DataFrame:
    s = sentences(docs).withColumn("ending", F.substring(F.regexp_replace("sentence", r"[^A-Za-z]+$", ""), -1, 1))
    return runs(s, ["doc_id"], "pos", "ending", 3).filter("ending <> ''")


def ending_transitions(docs: DataFrame) -> DataFrame:
    s = sentences(docs, "lang").withColumn("ending", F.substring("sentence", -1, 1))
    s = s.withColumn("after", F.lead("ending").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("after is not null")
    return s.groupBy("lang", F.col("ending").alias("before"), "after").agg(F.count(F.lit(1)).alias("n"))


def sentence_words(docs: DataFrame) -> DataFrame:
    return sentences(docs).select("doc_id", "pos", F.explode(F.array_distinct(normal_words(F.col("sentence")))).alias("word"))


def new_topics(docs: DataFrame) -> DataFrame:
    """Words per sentence that no earlier sentence of the document has."""
    return first_occurrence(sentence_words(docs), ["doc_id"], "word", "pos").groupBy("doc_id", F.col("first_pos").alias("pos")).agg(F.count(F.lit(1)).alias("new_words"))


def topic_overlap(docs: DataFrame) -> DataFrame:
    """Shared and united words of each sentence and the one before."""
    s = sentences(docs).select("doc_id", "pos", F.array_distinct(normal_words(F.col("sentence"))).alias("w"))
    s = s.withColumn("prev", F.lag("w").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("prev is not null")
    return s.select("doc_id", "pos", F.size(F.array_intersect("w", "prev")).alias("shared"), F.size(F.array_union("w", "prev")).alias("united"))


def phrase_repeats(docs: DataFrame, k: int = 4, least: int = 3) -> DataFrame:
    """Phrases of k words that one document has at least `least` times: counted on the document's sorted phrases, so nothing is exchanged."""
    w = docs.select("doc_id", normal_words(F.col("text")).alias("w")).filter(F.size("w") >= k)
    sorted_ = F.sort_array(F.expr(f"transform(sequence(0, size(w) - {k}), i -> array_join(slice(w, i + 1, {k}), ' '))"))

    def often(p: Column) -> Column:
        """In sorted order a phrase stands `least` times if the element least - 1 places on is the same."""
        phrases = F.array_distinct(F.filter(p, lambda x, i: x == F.get(p, i + (least - 1))))
        return F.transform(phrases, lambda x: F.struct(x.alias("phrase"), F.size(F.filter(p, lambda y: y == x)).cast("long").alias("n")))

    found = F.get(F.transform(F.array(sorted_), often), F.lit(0))  # binds the sorted phrases once
    return w.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.phrase", "f.n")


def number_orphans(docs: DataFrame) -> DataFrame:
    """Numerals that only one sentence of a document has, with its position."""
    n = sentences(docs).select("doc_id", "pos", F.explode(numerals(F.col("sentence"))).alias("numeral"))
    return n.groupBy("doc_id", "numeral").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos")).filter("c = 1").drop("c")


def lexicon_matches(docs: DataFrame) -> DataFrame:
    """Non-overlapping matches of each entry per sentence; the entries stand in the plan, so no join is needed."""
    s = sentences(docs)
    lower = F.lower("sentence")
    hits = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"), F.regexp_count(lower, F.lit(rf"\b{p}\b")).alias("n")) for i, (p, _) in enumerate(LEXICON)])
    return s.select("doc_id", "pos", F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h")).select("doc_id", "pos", "h.ord", "h.pattern", "h.n")


def first_match(docs: DataFrame) -> DataFrame:
    """The first entry in file order of each sentence."""
    return lexicon_matches(docs).groupBy("doc_id", "pos").agg(F.min("ord").alias("ord"))


def override_match(docs: DataFrame) -> DataFrame:
    """The last entry in file order of each sentence."""
    return lexicon_matches(docs).groupBy("doc_id", "pos").agg(F.max("ord").alias("ord"))


def lexicon_spans(docs: DataFrame) -> DataFrame:
    """Each match of each entry: start and end (from 0, in characters of the lower-cased sentence) and the entry's number."""
    lower = F.lower("sentence")
    rows = sentences(docs).select("doc_id", "pos", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.split(lower, rf"\b{p}\b", -1).alias("gaps"), F.regexp_extract_all(lower, F.lit(rf"\b{p}\b"), F.lit(0)).alias("hits")) for i, (p, _) in enumerate(LEXICON)])).alias("m"))
    rows = rows.select("doc_id", "pos", "m.*").filter(F.size("hits") > 0).select("*", F.posexplode("hits").alias("i", "hit"))
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    start = length(F.slice("gaps", F.lit(1), F.col("i") + 1)) + length(F.slice("hits", F.lit(1), F.col("i")))
    return rows.select("doc_id", "pos", start.alias("start_at"), (start + F.length("hit")).alias("end_at"), "ord")


def earliest_match(docs: DataFrame) -> DataFrame:
    """The match of each sentence that starts first; of several at one start the first entry in file order."""
    return lexicon_spans(docs).groupBy("doc_id", "pos").agg(F.min(F.struct("start_at", "ord", "end_at")).alias("m")).select("doc_id", "pos", "m.start_at", "m.end_at", "m.ord")


def override_spans(docs: DataFrame) -> DataFrame:
    """Every matched span once, with the last entry in file order that matches it."""
    return lexicon_spans(docs).groupBy("doc_id", "pos", "start_at", "end_at").agg(F.max("ord").alias("ord"))


def dedupe_fold(docs: DataFrame) -> DataFrame:
    """Distinct sentences with blanks and runs of digits folded, the number of documents and the first document."""
    s = sentences(docs).withColumn("folded", sentence_key(F.col("sentence")))
    return s.groupBy("folded").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


def ngram_documents(docs: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    w = docs.select("doc_id", normal_words(F.col("text")).alias("w")).filter(F.size("w") >= k)
    p = w.select("doc_id", F.explode(F.array_distinct(F.expr(f"transform(sequence(0, size(w) - {k}), i -> array_join(slice(w, i + 1, {k}), ' '))"))).alias("chain"))
    return p.groupBy("chain").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= least)


def collocations(docs: DataFrame, term: str = "the", top: int = 20) -> DataFrame:
    """The words that most documents have right after `term`; ties by word. Neighbours are found in the document's array; only they are exchanged."""
    w = docs.filter(F.contains(F.lower("text"), F.lit(term))).select("doc_id", normal_words(F.col("text")).alias("w"))
    after = F.filter(F.transform("w", lambda x, i: F.when(x == term, F.get("w", i + 1))), lambda x: x.isNotNull())
    n = w.select("doc_id", F.explode(after).alias("after")).groupBy("after", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("after").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n")).orderBy(F.desc("documents"), "after").limit(top)


#: Query terms up to this number are broadcast; beyond, the join is shuffled.
BROADCAST_TERMS = 1_000_000


def bm25(docs: DataFrame, queries: DataFrame, top: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The best documents for each query text by BM25; scores are floored to whole millionths, ties by doc_id.

    Terms that no query asks for are dropped before anything is exchanged; a document's length stays on its rows.
    """
    asked = queries.select("item_id", F.explode(F.array_distinct(normal_words(F.col("text")))).alias("term"))
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    words = docs.select("doc_id", normal_words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("len", F.size("w"))
    total = words.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    tf = words.select("doc_id", "len", F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    hit = asked.join(tf, "term").join(df, "term").join(F.broadcast(total), F.lit(True))
    score = hit.groupBy("item_id", "doc_id").agg(F.floor(F.sum(part) * 1000000 + 1e-4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return score.withColumn("rank", rank).filter(F.col("rank") <= top)


def paragraphs(docs: DataFrame) -> DataFrame:
    """Lines as paragraphs: sentences, words, longest sentence."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "text")).filter(strip(F.col("text")) != "")
    s = sentences(lines, "paragraph")
    return s.groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("sentences"), F.sum("words").alias("words"), F.max("words").alias("longest"))
