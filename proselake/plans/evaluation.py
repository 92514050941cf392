"""Queries over evaluation statistics, document profiles and keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions import spans, tokens
from proselake.functions.text import numerals, sentences
from proselake.operators import profiles, statistics
from proselake.plans.catalogue import _D, NUMS, PRED, SW, S, _L
from proselake.plans.measures import PARA


def _predicted(labels: DataFrame, docs: DataFrame) -> DataFrame:
    p = labels.join(docs.select("doc_id", "n_chars", "lang"), "doc_id")
    return p.withColumn("pred", (F.col("n_chars") >= 1500).cast("int"))


def _micro(x: Column) -> Column:
    return F.floor(x * 1000000 + 1e-6).cast("long")


def class_scores(labels: DataFrame, docs: DataFrame) -> DataFrame:
    p = _predicted(labels, docs).select(F.col("quality").cast("string").alias("gold"), F.col("pred").cast("string").alias("predicted"))
    return statistics.classification(p).select("class", "tp", "fp", "fn", *[_micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def macro_scores(labels: DataFrame, docs: DataFrame) -> DataFrame:
    m = statistics.macro(_predicted(labels, docs).select(F.col("quality").alias("gold"), F.col("pred").alias("predicted")))
    return m.select("cases", "answered", *[_micro(F.col(c)).alias(c) for c in ("coverage", "accuracy", "macro_f1")])


def _ratings(labels: DataFrame, docs: DataFrame) -> DataFrame:
    p = _predicted(labels, docs)
    return p.select(F.col("doc_id").alias("unit"), F.explode(F.array(F.col("quality").cast("string"), F.col("pred").cast("string"), (1 - F.col("toxic")).cast("string"))).alias("value"))


def alpha_of_three(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return statistics.nominal_alpha(_ratings(labels, docs)).select("pairs", *[_micro(F.col(c)).alias(c) for c in ("observed", "expected", "alpha")])


def consensus_of_three(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return statistics.consensus(_ratings(labels, docs), ["0", "1"], 2)


def _confident(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return _predicted(labels, docs).select((F.least("n_chars", F.lit(3000)) / 3000.0).alias("c"), F.col("quality").alias("ok"))


def calibration_errors(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return statistics.calibration_error(_confident(labels, docs), "c", "ok").select(_micro(F.col("ece")).alias("ece"), _micro(F.col("brier")).alias("brier"))


def risk_curve(labels: DataFrame, docs: DataFrame) -> DataFrame:
    r = statistics.risk_coverage(_confident(labels, docs), "c", "ok")
    return r.select(_micro(F.col("confidence")).alias("confidence"), "covered", _micro(F.col("risk")).alias("risk"))


def preference_shares(labels: DataFrame, docs: DataFrame) -> DataFrame:
    p = _predicted(labels, docs).withColumn("choice", F.when(F.col("toxic") == 1, "tie").when(F.col("quality") == 1, "a").otherwise("b"))
    return statistics.preferences(p, "choice", "lang").select("lang", "n", _micro(F.col("share")).alias("share"))


def label_counts(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return statistics.results_summary(_predicted(labels, docs), "quality", "toxic", "lang")


def balanced(docs: DataFrame) -> DataFrame:
    return statistics.balanced_sides(docs.select("doc_id"), "doc_id", 7).select("doc_id", F.col("left").cast("int").alias("is_left"))


def digest_sides(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", statistics.left_side(F.col("doc_id"), 7).cast("int").alias("is_left"))


def even_sample(docs: DataFrame) -> DataFrame:
    return statistics.evenly(docs.select("doc_id", "lang"), ["doc_id"], 50, "lang")


def size_percentiles(docs: DataFrame) -> DataFrame:
    return statistics.percentile_rank(docs.select("lang", F.col("n_chars").cast("long").alias("n_chars")), ["lang"], "n_chars")


def rates(docs: DataFrame) -> DataFrame:
    return profiles.document_rates(docs).select("doc_id", "sentences", "questions", "longSentences")


def sentence_profile(docs: DataFrame) -> DataFrame:
    return profiles.profile(docs, "lang").filter("feature in ('words', 'chars', 'commas', 'newWords')")


def duplicate_sentences(docs: DataFrame) -> DataFrame:
    return profiles.duplicate_share(docs)


def sentence_keys(docs: DataFrame) -> DataFrame:
    s = sentences(docs).select("doc_id", tokens.key_hash(F.col("sentence")).alias("key"))
    return s.groupBy("key").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


def canonical_numbers(docs: DataFrame) -> DataFrame:
    n = docs.select("doc_id", F.explode(F.array_distinct(F.transform(numerals(F.col("text")), spans.canonical_number))).alias("number"))
    return n.groupBy("number").agg(F.count(F.lit(1)).alias("documents"))


def size_changes(docs: DataFrame) -> DataFrame:
    n = lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return profiles.profile_changes(n(docs.filter("n_chars < 1500")), n(docs.filter("n_chars >= 1500")), ["lang"], ["n", "chars"])


_M = "floor(({}) * 1000000 + 1e-6)::BIGINT"
_R = PRED + ", r AS (SELECT doc_id AS unit, unnest([quality::VARCHAR, pred::VARCHAR, (1 - toxic)::VARCHAR]) AS value FROM p), n AS (SELECT unit, value, count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY ALL)"
_CELLS = PRED + ", k AS (SELECT unnest([0, 1]) AS class), t AS (SELECT class, sum((quality = class AND pred = class)::INT)::BIGINT AS tp, sum((quality <> class AND pred = class)::INT)::BIGINT AS fp, sum((quality = class AND pred <> class)::INT)::BIGINT AS fn FROM p, k GROUP BY 1)"
_CONF = PRED + ", c AS (SELECT least(n_chars, 3000) / 3000.0::DOUBLE AS c, quality AS ok FROM p)"
_SHA7 = "sha256('7:' || doc_id::VARCHAR)"
_KEY = r"regexp_replace(trim(regexp_replace(sentence, '\s+', ' ', 'g')), '[0-9]+', '0', 'g')"
_NUMBER = r"regexp_replace(CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\.$', '') ELSE x END, '^0+([0-9])', '\1')"
_FEATURES = {"words": "words", "chars": "length(sentence)", "commas": "len(sentence) - len(replace(sentence, ',', ''))", "newWords": "coalesce(k, 0)"}

#: name -> (function of tables, tables, SQL)
EVALUATION = {
    "class_scores": (class_scores, _L, _CELLS + f" SELECT class::VARCHAR AS class, tp, fp, fn, {_M.format('tp / (tp + fp)')} AS precision, {_M.format('tp / (tp + fn)')} AS recall, {_M.format('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM t"),
    "macro_scores": (macro_scores, _L, _CELLS + f", f AS (SELECT avg(2 * tp / (2 * tp + fp + fn)) AS f1 FROM t) SELECT count(*) AS cases, count(pred) AS answered, 1000000::BIGINT AS coverage, {_M.format('sum((quality = pred)::INT) / count(*)')} AS accuracy, {_M.format('min(f1)')} AS macro_f1 FROM p, f"),
    "alpha_of_three_raters": (alpha_of_three, _L, _R + ", m AS (SELECT *, sum(n) OVER (PARTITION BY unit) AS m FROM n), v AS (SELECT value, sum(n)::BIGINT AS total, sum(n * (m - n) / (m - 1)) AS off FROM m WHERE m >= 2 GROUP BY 1), t AS (SELECT sum(total)::BIGINT AS pairs, sum(off) AS off, sum(total * total)::DOUBLE AS square FROM v), a AS (SELECT pairs, off / pairs AS observed, (pairs::DOUBLE * pairs - square) / (pairs::DOUBLE * (pairs - 1)) AS expected FROM t)" + f" SELECT pairs, {_M.format('observed')} AS observed, {_M.format('expected')} AS expected, {_M.format('1 - observed / expected')} AS alpha FROM a"),
    "consensus_of_three_raters": (consensus_of_three, _L, _R + ", u AS (SELECT unit, sum(n)::BIGINT AS answered, max({'n': n, 'v': value}) AS top FROM n GROUP BY 1) SELECT unit, answered, CASE WHEN answered >= 2 AND 2 * top.n > answered THEN top.v ELSE 'noConsensus' END AS verdict FROM u"),
    "calibration_errors": (calibration_errors, _L, _CONF + ", b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, abs(avg(c) - avg(ok)) AS gap FROM c GROUP BY 1), e AS (SELECT sum(n * gap) / sum(n) AS ece FROM b)" + f" SELECT {_M.format('min(ece)')} AS ece, {_M.format('avg((c - ok) * (c - ok))')} AS brier FROM c, e"),
    "risk_curve": (risk_curve, _L, _CONF + ", n AS (SELECT c, count(*) AS n, sum(1 - ok) AS w FROM c GROUP BY 1)" + f" SELECT {_M.format('c')} AS confidence, sum(n) OVER o::BIGINT AS covered, {_M.format('(sum(w) OVER o) / (sum(n) OVER o)')} AS risk FROM n WINDOW o AS (ORDER BY c DESC)".replace("sum(n) OVER o::BIGINT", "(sum(n) OVER o)::BIGINT")),
    "preference_shares": (preference_shares, _L, PRED + ", s AS (SELECT lang, CASE WHEN toxic = 1 THEN 0.5::DOUBLE WHEN quality = 1 THEN 1.0 ELSE 0.0 END AS s FROM p)" + f" SELECT lang, count(*) AS n, {_M.format('avg(s)')} AS share FROM s GROUP BY GROUPING SETS ((lang), ())"),
    "label_counts": (label_counts, _L, PRED + ", c AS (SELECT 'quality' AS dimension, quality::VARCHAR AS value FROM p UNION ALL SELECT 'toxic', toxic::VARCHAR FROM p UNION ALL SELECT 'lang', lang FROM p) SELECT dimension, value, count(*) AS n FROM c GROUP BY ALL"),
    "balanced_sides": (balanced, _D, f"SELECT doc_id, (row_number() OVER (ORDER BY {_SHA7}, doc_id) % 2)::INT AS is_left FROM documents"),
    "digest_sides": (digest_sides, _D, f"SELECT doc_id, (right({_SHA7}, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e'))::INT AS is_left FROM documents"),
    "even_sample": (even_sample, _D, "WITH x AS (SELECT doc_id, lang, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WINDOW o AS (PARTITION BY lang ORDER BY doc_id)) SELECT doc_id, lang FROM x WHERE n <= 50 OR i = 0 OR i * 50 // n <> (i - 1) * 50 // n"),
    "size_percentiles": (size_percentiles, _D, "WITH x AS (SELECT lang, n_chars::BIGINT AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, " + ", ".join(f"min(CASE WHEN i >= round_even((n - 1) * {p} / 100.0::DOUBLE, 0) THEN v END) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM x GROUP BY 1"),
    "document_rates": (rates, _D, S + ", c AS (SELECT doc_id, count(*) AS n, sum(ends_with(sentence, '?')::INT) AS q, sum((words > 30)::INT) AS l FROM s GROUP BY 1) SELECT doc_id, coalesce(n, 0)::INT AS sentences, coalesce(floor(q * 1000 / n), 0)::BIGINT AS questions, coalesce(floor(l * 1000 / n), 0)::BIGINT AS \"longSentences\" FROM documents LEFT JOIN c USING (doc_id)"),
    "sentence_profile": (sentence_profile, _D, SW + ", t AS (SELECT doc_id, pos, count(*) AS k FROM (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY 1, 2) GROUP BY 1, 2), f AS (SELECT s.*, k FROM s LEFT JOIN t USING (doc_id, pos)), v AS (" + " UNION ALL ".join(f"SELECT lang AS kind, '{n}' AS feature, least({x}, 200)::BIGINT AS value FROM f" for n, x in _FEATURES.items()) + "), h AS (SELECT kind, feature, value, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY kind, feature ORDER BY value) AS c, sum(n) OVER (PARTITION BY kind, feature) AS t FROM h) SELECT kind, feature, max(t)::BIGINT AS total, " + ", ".join(f"min(CASE WHEN c * 100 >= t * {p} THEN value END) AS p{p}" for p in profiles.POINTS) + " FROM c GROUP BY 1, 2"),
    "document_rhythm": (profiles.rhythm, _D, S + ", c AS (SELECT doc_id, count(*) AS n, sum(words)::DOUBLE AS t, sum(words * words)::DOUBLE AS q FROM s GROUP BY 1), d AS (SELECT doc_id, n, t / n AS mean, sqrt(greatest(q / n - (t / n) * (t / n), 0.0)) AS sd FROM c) SELECT doc_id, n::INT AS sentences, floor(mean * 1000 + 1e-6)::BIGINT AS mean, floor(sd * 1000 + 1e-6)::BIGINT AS deviation, floor(CASE WHEN sd + mean > 0 THEN (sd - mean) / (sd + mean) ELSE 0 END * 1000 + 1e-6)::BIGINT AS burstiness FROM d"),
    "paragraph_prints": (profiles.paragraph_prints, _D, PARA + ", w AS (SELECT doc_id, paragraph, count(*) AS n, sum(words)::DOUBLE AS t, sum(words * words)::DOUBLE AS q FROM s GROUP BY 1, 2), x AS (SELECT p.doc_id, row_number() OVER o - 1 AS i, n, t, sqrt(greatest(q / n - (t / n) * (t / n), 0.0)) AS sd, list_distinct(regexp_extract_all(lower(p.text), '[a-z]+')) AS b, lag(list_distinct(regexp_extract_all(lower(p.text), '[a-z]+'))) OVER o AS v FROM p JOIN w USING (doc_id, paragraph) WINDOW o AS (PARTITION BY p.doc_id ORDER BY paragraph)) SELECT doc_id, i::INT AS paragraph, n::INT AS sentences, t::BIGINT AS words, floor(t / n * 1000 + 1e-6)::BIGINT AS mean, floor(sd * 1000 + 1e-6)::BIGINT AS deviation, CASE WHEN v IS NOT NULL THEN len(list_intersect(b, v)) END::INT AS shared, len(list_distinct(list_concat(b, v)))::INT AS united FROM x".replace("len(list_distinct(list_concat(b, v)))::INT", "CASE WHEN v IS NOT NULL THEN len(list_distinct(list_concat(b, v))) END::INT")),
    "duplicate_sentences": (duplicate_sentences, _D, S + f", k AS (SELECT {_KEY} AS k FROM s) SELECT count(*) AS sentences, count(DISTINCT k) AS keys, floor((count(*) - count(DISTINCT k)) * 1000 / count(*))::BIGINT AS repeats FROM k"),
    "sentence_keys": (sentence_keys, _D, S + f", k AS (SELECT doc_id, sha256({_KEY}) AS h FROM s) SELECT " + " || ".join(f"substr(h, {1 + 2 * i}, 2)" for i in range(7, -1, -1)) + " AS key, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM k GROUP BY 1"),
    "canonical_numbers": (canonical_numbers, _D, f"WITH n AS (SELECT DISTINCT doc_id, {_NUMBER} AS number FROM (SELECT doc_id, unnest({NUMS.format('text')}) AS x FROM documents)) SELECT number, count(*) AS documents FROM n GROUP BY 1"),
    "size_changes": (size_changes, _D, "WITH x AS (SELECT lang, sum((n_chars >= 1500)::INT) - sum((n_chars < 1500)::INT) AS n, sum(CASE WHEN n_chars >= 1500 THEN n_chars ELSE -n_chars END) AS chars FROM documents GROUP BY 1) SELECT lang, n::BIGINT AS n, chars::BIGINT AS chars FROM x"),
}
