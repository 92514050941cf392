"""Comparison and evaluation: baselines, bands, outlines, agreement, calibration, budgets, event runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions.text import normal_words, numerals, sentences
from proselake.operators.prose import long_sentences, number_orphans
from proselake.plans.windows import first_occurrence, runs

SPLIT = 1500


def _quoted(docs: DataFrame, most: int) -> DataFrame:
    """Findings of sentences of more than `most` words with the quote that baselines hold: blanks are single."""
    s = sentences(docs).filter(F.col("words") > most)
    return s.select("doc_id", "pos", "words", F.trim(F.regexp_replace("sentence", r"\s+", " ")).alias("quote"))


def baseline_keep(docs: DataFrame, most: int = 30, locked: int = 40) -> DataFrame:
    """Findings whose quote the baseline (what a limit of `locked` words reports) does not hold for the document."""
    return _quoted(docs, most).join(_quoted(docs, locked).select("doc_id", "quote").distinct(), ["doc_id", "quote"], "left_anti").select("doc_id", "pos", "words")


def baseline_prune(docs: DataFrame, most: int = 30, locked: int = 25) -> DataFrame:
    """Per document, entries of a baseline that a limit of `locked` words made: those still found and those that go."""
    baseline = _quoted(docs, locked).select("doc_id", "quote").distinct()
    found = _quoted(docs, most).select("doc_id", "quote").distinct().withColumn("still", F.lit(1))
    return baseline.join(found, ["doc_id", "quote"], "left").groupBy("doc_id").agg(F.count("still").alias("kept"), (F.count(F.lit(1)) - F.count("still")).alias("pruned"))


def band_join(docs: DataFrame) -> DataFrame:
    """Long sentences with an orphan numeral at most one sentence away: an equi-join on shifted positions, not a range join."""
    near = number_orphans(docs).select("doc_id", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos")).distinct()
    return long_sentences(docs).join(near, ["doc_id", "pos"], "left_semi")


def disabled_ranges(events: DataFrame, length: int = 400) -> DataFrame:
    """Events outside the ranges that their user's errors open: an error switches off itself and the ids up to `length` after it."""
    last = F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.withColumn("last", last).filter("last is null or event_id > last + %d" % length).select("event_id", "user_id")


def turn_dice(conversations: DataFrame) -> DataFrame:
    """Words that consecutive turns share as multisets, and their total number."""
    w = conversations.select("conv_id", "turn", F.explode(normal_words(F.col("text"))).alias("word")).groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("n"))
    size = w.groupBy("conv_id", "turn").agg(F.sum("n").alias("size"))
    prev = w.select("conv_id", (F.col("turn") + 1).alias("turn"), "word", F.col("n").alias("m"))
    both = w.join(prev, ["conv_id", "turn", "word"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("common"))
    before = size.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("size").alias("before"))
    return size.join(before, ["conv_id", "turn"]).join(both, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("common", F.lit(0)).alias("common"), (F.col("size") + F.col("before")).alias("total"))


def surface_diff(conversations: DataFrame) -> DataFrame:
    """Numerals that each turn drops from and adds to the turn before."""
    c = conversations.select("conv_id", "turn", numerals(F.col("text")).alias("now"))
    c = c.withColumn("was", F.lag("now").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("was is not null")
    return c.select("conv_id", "turn", F.size(F.array_except("was", "now")).alias("lost"), F.size(F.array_except("now", "was")).alias("gained"))


def outline_compare(conversations: DataFrame) -> DataFrame:
    """The role and opening words of each turn against the turn two places before, by conversation and place."""
    opening = F.concat_ws(" ", "role", F.substring(F.lower("text"), 1, 12))
    a = conversations.select("conv_id", (F.col("turn") + 2).alias("turn"), opening.alias("old"))
    b = conversations.select("conv_id", "turn", opening.alias("new"))
    j = a.join(b, ["conv_id", "turn"], "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return j.groupBy("conv_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _predicted(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return labels.join(docs.select("doc_id", "n_chars", "lang", "source"), "doc_id").withColumn("pred", (F.col("n_chars") >= SPLIT).cast("int"))


def confusion(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Cells of the confusion matrix, precision and recall in permille per class."""
    p = _predicted(labels, docs)
    both = p.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "quality", "pred")
    hit = lambda c: F.sum(c.cast("int"))
    k = F.col("class")
    out = both.groupBy("class").agg(hit((F.col("quality") == k) & (F.col("pred") == k)).alias("tp"), hit((F.col("quality") != k) & (F.col("pred") == k)).alias("fp"), hit((F.col("quality") == k) & (F.col("pred") != k)).alias("fn"))
    return out.withColumn("f1_permille", F.floor(F.col("tp") * 2000 / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))))


def agreement(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Nominal alpha of two raters (quality and prediction), floored to millionths."""
    p = _predicted(labels, docs)
    t = p.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") != F.col("pred")).cast("int")).alias("d"), F.sum(F.col("quality") + F.col("pred")).alias("ones"))
    zeros = 2 * F.col("n") - F.col("ones")
    expected = F.col("ones") * zeros / (2.0 * F.col("n") - 1)
    return t.select("n", "d", F.floor((1 - F.col("d") / expected) * 1000000 + 1e-6).alias("alpha_millionths"))


def calibration(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Ten bins of a score from n_chars: rows, positives, sum of the score in permille."""
    p = _predicted(labels, docs).withColumn("permille", F.least(F.col("n_chars"), F.lit(2999)) * 1000 / 3000)
    p = p.withColumn("permille", F.floor("permille"))
    return p.groupBy(F.floor(F.col("permille") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("positives"), F.sum("permille").alias("score_sum"), F.sum((F.col("permille") - 1000 * F.col("quality")) * (F.col("permille") - 1000 * F.col("quality"))).alias("brier_sum"))


def share_rollup(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels by language and source with subtotals."""
    p = _predicted(labels, docs)
    return p.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.grouping_id().cast("long").alias("level"))


def apportion(customer: DataFrame, nation: DataFrame, budget: int = 1000) -> DataFrame:
    """Seats per nation by largest remainder; ties by name. Nations are few, so one sort of them is fine."""
    c = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    c = c.withColumn("base", F.expr(f"n * {budget} div total")).withColumn("rest", F.expr(f"(n * {budget}) % total"))
    left = F.lit(budget) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "n_name"))
    return c.withColumn("seats", F.col("base") + (rank <= left).cast("int")).select("n_name", "n", "seats")


def event_runs(events: DataFrame) -> DataFrame:
    return runs(events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 3)


def first_seen(events: DataFrame) -> DataFrame:
    return first_occurrence(events, ["user_id"], "event_type", "event_id")
