"""Scalar text functions as Column expressions, and sentences as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0b]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def sentence_array(text: Column) -> Column:
    """Sentences end at [.?!]+ before a blank, but not after a single letter (an abbreviation)."""
    marked = F.coalesce(text, F.lit(""))
    for _ in range(2):  # neighbours such as U.S. share a boundary character
        marked = F.regexp_replace(marked, r"(^|[^A-Za-z])([A-Za-z])([.?!]+)", "$1$2$3\u0002")
    parts = F.split(F.regexp_replace(marked, rf"([.?!]+){WS}+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit("\u0002"), F.lit("")))), lambda s: s != "")


def placed_sentences(text: Column) -> Column:
    """Sentences as struct(quote, newlines): newlines is the number of line breaks of the text before the sentence."""
    marked = F.coalesce(text, F.lit(""))
    for _ in range(2):
        marked = F.regexp_replace(marked, r"(^|[^A-Za-z])([A-Za-z])([.?!]+)", "$1$2$3\u0002")
    parts = F.split(F.regexp_replace(marked, rf"([.?!]+)(?={WS})", "$1\u0001"), "\u0001")
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    lead = lambda s: breaks(F.regexp_extract(s, f"^({WS}*)", 1))
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, s: n + breaks(s))
    placed = F.transform(parts, lambda s, i: F.struct(strip(F.replace(s, F.lit("\u0002"), F.lit(""))).alias("quote"), (before(i) + lead(s)).cast("int").alias("newlines")))
    return F.filter(placed, lambda s: s["quote"] != "")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in `keep`, pos (from 0), sentence, words (their number)."""
    out = docs.select("doc_id", *keep, F.posexplode(sentence_array(F.col("text"))).alias("pos", "sentence"))
    return out.withColumn("words", F.size(word_array(F.col("sentence"))))


def normal_words(text: Column) -> Column:
    """Lower-case words of ASCII letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"))


def numerals(text: Column) -> Column:
    """Distinct numerals without thousands commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)")), lambda x: F.replace(x, F.lit(","), F.lit(""))))
