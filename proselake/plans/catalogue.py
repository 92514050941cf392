"""The queries over the driver's tables and, for each, DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from proselake.functions.markers import HEDGES
from proselake.operators import compare, prose

_BLANK = r"[ \t\n\r\f\x0b]"
_MARK = r"regexp_replace({}, '(^|[^A-Za-z])([A-Za-z])([.?!]+)', '\1\2\3' || chr(2), 'g')"


def _sentences(source: str, keys: str) -> str:
    """Named queries s0, s1 and s (keys, pos, sentence, words)."""
    text = _MARK.format(_MARK.format("coalesce(text, '')"))
    return rf"""
s0 AS (SELECT {keys}, string_split(regexp_replace({text}, '([.?!]+){_BLANK}+', '\1' || chr(1), 'g'), chr(1)) AS a FROM {source}),
s1 AS (SELECT {keys}, list_filter(list_transform(a, lambda x: regexp_replace(replace(x, chr(2), ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') AS a FROM s0),
s2 AS (SELECT {keys}, a, unnest(range(len(a))) AS pos FROM s1),
s AS (SELECT {keys}, pos::INT AS pos, a[pos + 1] AS sentence, len(list_filter(regexp_split_to_array(a[pos + 1], '{_BLANK}+'), lambda w: w <> ''))::INT AS words FROM s2)"""


S = "WITH " + _sentences("documents", "doc_id, lang")
HIST = S + ", h AS (SELECT lang, least(words, 200) AS value, count(*) AS n FROM s GROUP BY ALL)"
PCT = HIST + ", c AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY value) AS c, sum(n) OVER (PARTITION BY lang) AS t FROM h), p AS (SELECT lang, " + ", ".join(f"min(CASE WHEN c * 100 >= t * {p} THEN value END) AS p{p}" for p in (50, 90, 95, 99)) + " FROM c GROUP BY lang)"
QUOTED = r", q AS (SELECT doc_id, pos, words, trim(regexp_replace(sentence, '\s+', ' ', 'g')) AS quote FROM s)"
LONG = "SELECT doc_id, pos, words FROM s WHERE words > 30"
WORDS = "regexp_extract_all(lower({}), '[a-z]+')"
NUMS = r"list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')))"
SW = S + f", w AS (SELECT DISTINCT doc_id, pos, unnest({WORDS.format('sentence')}) AS word FROM s)"
ORPHANS = S + f", o AS (SELECT doc_id, numeral, min(pos) AS pos FROM (SELECT doc_id, pos, unnest({NUMS.format('sentence')}) AS numeral FROM s) GROUP BY 1, 2 HAVING count(*) = 1)"
LEX = S + ", l AS (" + " UNION ALL ".join(rf"SELECT doc_id, pos, {i} AS ord, '{p}' AS pattern, len(regexp_extract_all(lower(sentence), '\b{p}\b')) AS n FROM s" for i, (p, _) in enumerate(prose.LEXICON)) + ")"
VALUES = SW + ", t AS (SELECT doc_id, pos, count(*) AS k FROM (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY 1, 2) GROUP BY 1, 2), f AS (SELECT s.*, coalesce(k, 0) AS k FROM s LEFT JOIN t USING (doc_id, pos)), v AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, lang, '{m}' AS measure, ({x})::BIGINT AS value FROM f" for m, x in (("length", "words"), ("commas", "length(sentence) - length(replace(sentence, ',', ''))"), ("newTopics", "k"), ("hedges", " + ".join(f"len(regexp_extract_all(sentence, '{p}'))" for p in HEDGES)))) + ")"
#: A match found by its characters: the entry stands there and no letter, digit or underscore touches it.
SPANS = S + ", n AS (SELECT doc_id, pos, lower(sentence) AS t FROM s), m AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, {i} AS ord, t, {len(p)} AS k, '{p}' AS pattern, unnest(range(length(t))) AS b FROM n WHERE contains(t, '{p}')" for i, (p, _) in enumerate(prose.LEXICON)) + """), g AS (SELECT doc_id, pos, b::INT AS start_at, (b + k)::INT AS end_at, ord FROM m WHERE substr(t, b + 1, k) = pattern AND NOT regexp_matches(substr(t, b + 1 + k, 1), '[a-z0-9_]') AND (b = 0 OR NOT regexp_matches(substr(t, b, 1), '[a-z0-9_]')))"""
GRAMS = "SELECT doc_id, array_to_string(w[i:i + {0} - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {0} + 2)) AS i FROM (SELECT doc_id, " + WORDS.format("text") + " AS w FROM documents))"
RUNS = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY {1}) - row_number() OVER (PARTITION BY {0}, {2} ORDER BY {1}) AS i FROM {3}"
PRED = "WITH p AS (SELECT l.*, d.n_chars, d.lang, d.source, (d.n_chars >= 1500)::INT AS pred FROM labels l JOIN documents d USING (doc_id))"

_D, _C, _E = ("documents",), ("conversations",), ("events",)
_L = ("labels", "documents")

#: name -> (function of tables, tables, SQL)
CATALOGUE: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], str]] = {
    "sentence_stats_by_lang": (prose.sentence_stats, _D, S + " SELECT lang, count(*) AS sentences, sum(words)::BIGINT AS words, sum((words > 30)::INT)::BIGINT AS long_sentences FROM s GROUP BY 1"),
    "long_sentences": (prose.long_sentences, _D, S + " " + LONG),
    "length_histogram": (prose.length_histogram, _D, HIST + " SELECT * FROM h"),
    "length_percentiles": (prose.length_percentiles, _D, PCT + " SELECT * FROM p"),
    "outside_profile": (prose.outside_profile, _D, PCT + " SELECT doc_id, pos, words, p99 FROM s JOIN p USING (lang) WHERE least(words, 200) > p99"),
    "outside_profile_measures": (prose.outside_profile_measures, _D, VALUES + ", h AS (SELECT lang, measure, least(value, 200) AS value, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY value) AS c, sum(n) OVER (PARTITION BY lang, measure) AS t FROM h), p AS (SELECT lang, measure, min(value) AS p99 FROM c WHERE c * 100 >= t * 99 GROUP BY 1, 2) SELECT doc_id, pos, v.measure, v.value, p99 FROM v JOIN p ON v.lang IS NOT DISTINCT FROM p.lang AND v.measure = p.measure WHERE p99 > 0 AND v.value > p99"),
    "initial_word_runs": (prose.initial_word_runs, _D, S + ", x AS (SELECT doc_id, pos, lower(regexp_extract(sentence, '^([A-Za-z]+)', 1)) AS word FROM s), r AS (" + RUNS.format("doc_id", "pos", "word", "x") + ") SELECT doc_id, word, min(pos) AS first_pos, count(*) AS run_length FROM r WHERE word <> '' GROUP BY doc_id, word, i HAVING count(*) >= 2"),
    "ending_char_runs": (prose.ending_runs, _D, S + ", x AS (SELECT doc_id, pos, right(regexp_replace(sentence, '[^A-Za-z]+$', ''), 1) AS ending FROM s), r AS (" + RUNS.format("doc_id", "pos", "ending", "x") + ") SELECT doc_id, ending, min(pos) AS first_pos, count(*) AS run_length FROM r WHERE ending <> '' GROUP BY doc_id, ending, i HAVING count(*) >= 3"),
    "ending_transitions": (prose.ending_transitions, _D, S + ", x AS (SELECT lang, right(sentence, 1) AS before, lead(right(sentence, 1)) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM s) SELECT lang, before, after, count(*) AS n FROM x WHERE after IS NOT NULL GROUP BY ALL"),
    "new_topics_per_sentence": (prose.new_topics, _D, SW + " SELECT doc_id, pos, count(*) AS new_words FROM (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY 1, 2) GROUP BY 1, 2"),
    "topic_overlap_prev": (prose.topic_overlap, _D, S + f", x AS (SELECT doc_id, pos, list_distinct({WORDS.format('sentence')}) AS w FROM s), y AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM x) SELECT doc_id, pos, len(list_intersect(w, v))::INT AS shared, len(list_distinct(list_concat(w, v)))::INT AS united FROM y WHERE v IS NOT NULL"),
    "phrase_share": (prose.phrase_repeats, _D, "SELECT doc_id, g AS phrase, count(*) AS n FROM (" + GRAMS.format(4) + ") GROUP BY 1, 2 HAVING count(*) >= 3"),
    "number_orphan_candidates": (prose.number_orphans, _D, ORPHANS + " SELECT doc_id, numeral, pos FROM o"),
    "lexicon_matches": (prose.lexicon_matches, _D, LEX + " SELECT doc_id, pos, ord, pattern, n::INT AS n FROM l WHERE n > 0"),
    "first_match": (prose.first_match, _D, LEX + " SELECT doc_id, pos, min(ord) AS ord FROM l WHERE n > 0 GROUP BY 1, 2"),
    "override_match": (prose.override_match, _D, LEX + " SELECT doc_id, pos, max(ord) AS ord FROM l WHERE n > 0 GROUP BY 1, 2"),
    "earliest_match": (prose.earliest_match, _D, SPANS + ' SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY start_at, ord) = 1'),
    "override_spans": (prose.override_spans, _D, SPANS + ' SELECT doc_id, pos, start_at, end_at, max(ord) AS ord FROM g GROUP BY ALL'),
    "sentence_dedupe_fold": (prose.dedupe_fold, _D, S + " SELECT regexp_replace(trim(regexp_replace(sentence, '\\s+', ' ', 'g')), '[0-9]+', '0', 'g') AS folded, count(*) AS n, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM s GROUP BY 1"),
    "ngram_doc_counts": (prose.ngram_documents, _D, "SELECT g AS chain, count(DISTINCT doc_id) AS documents FROM (" + GRAMS.format(3) + ") GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3"),
    "collocations_topk": (prose.collocations, _D, f"WITH x AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)) SELECT w[i + 1] AS after, count(DISTINCT doc_id) AS documents, count(*) AS n FROM x WHERE w[i] = 'the' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "bm25_topk": (prose.bm25, ("documents", "benchmark"), f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
t AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark),
h AS (SELECT item_id, doc_id, floor(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (1.5::DOUBLE + 1) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(w) / mean))) * 1000000 + 1e-4)::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (doc_id), t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h) SELECT * FROM r WHERE rank <= 5"""),
    "paragraph_aggregates": (prose.paragraphs, _D, rf"WITH l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS b FROM documents), l1 AS (SELECT doc_id, b, unnest(range(len(b))) AS paragraph FROM l0), l AS (SELECT doc_id, paragraph::INT AS paragraph, b[paragraph + 1] AS text FROM l1), " + _sentences("l", "doc_id, paragraph") + " SELECT doc_id, paragraph, count(*) AS sentences, sum(words)::BIGINT AS words, max(words) AS longest FROM s GROUP BY 1, 2"),
    "baseline_keep": (compare.baseline_keep, _D, S + QUOTED + " SELECT doc_id, pos, words FROM q ANTI JOIN (SELECT DISTINCT doc_id, quote FROM q WHERE words > 40) b USING (doc_id, quote) WHERE words > 30"),
    "baseline_prune": (compare.baseline_prune, _D, S + QUOTED + ", b AS (SELECT doc_id, quote, max(words > 30) AS still FROM q WHERE words > 25 GROUP BY 1, 2) SELECT doc_id, sum(still::INT)::BIGINT AS kept, sum((NOT still)::INT)::BIGINT AS pruned FROM b GROUP BY 1"),
    "coverage_band_join": (compare.band_join, _D, ORPHANS + " SELECT doc_id, pos, words FROM s WHERE words > 30 AND EXISTS (SELECT 1 FROM o WHERE o.doc_id = s.doc_id AND o.pos BETWEEN s.pos - 1 AND s.pos + 1)"),
    "disabled_range_filter": (compare.disabled_ranges, _E, "SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND e.event_id BETWEEN x.event_id AND x.event_id + 400)"),
    "line_multiset_dice": (compare.turn_dice, _C, f"""
WITH w AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest({WORDS.format('text')}) AS word FROM conversations) GROUP BY ALL),
z AS (SELECT conv_id, turn, sum(n) AS size FROM w GROUP BY ALL),
b AS (SELECT a.conv_id, a.turn, sum(least(a.n, p.n)) AS common FROM w a JOIN w p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND a.word = p.word GROUP BY ALL)
SELECT z.conv_id, z.turn, coalesce(common, 0)::BIGINT AS common, (z.size + y.size)::BIGINT AS total FROM z JOIN z y ON y.conv_id = z.conv_id AND y.turn = z.turn - 1 LEFT JOIN b ON b.conv_id = z.conv_id AND b.turn = z.turn"""),
    "surface_diff_turns": (compare.surface_diff, _C, f"WITH c AS (SELECT conv_id, turn, {NUMS.format('text')} AS now FROM conversations), x AS (SELECT *, lag(now) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM c) SELECT conv_id, turn, len(list_filter(was, lambda v: NOT list_contains(now, v)))::INT AS lost, len(list_filter(now, lambda v: NOT list_contains(was, v)))::INT AS gained FROM x WHERE was IS NOT NULL"),
    "outline_compare": (compare.outline_compare, _C, "WITH o AS (SELECT conv_id, turn, concat_ws(' ', role, substr(lower(text), 1, 12)) AS t FROM conversations) SELECT conv_id, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' WHEN a.t = b.t THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM (SELECT conv_id, turn + 2 AS turn, t FROM o) a FULL JOIN o b USING (conv_id, turn) GROUP BY ALL"),
    "confusion_macro_f1": (compare.confusion, _L, PRED + ", k AS (SELECT unnest([0, 1]) AS class), t AS (SELECT class, sum((quality = class AND pred = class)::INT)::BIGINT AS tp, sum((quality <> class AND pred = class)::INT)::BIGINT AS fp, sum((quality = class AND pred <> class)::INT)::BIGINT AS fn FROM p, k GROUP BY 1) SELECT *, floor(tp * 2000 / nullif(2 * tp + fp + fn, 0))::BIGINT AS f1_permille FROM t"),
    "krippendorff_alpha": (compare.agreement, _L, PRED + ", t AS (SELECT count(*) AS n, sum((quality <> pred)::INT)::BIGINT AS d, sum(quality + pred)::BIGINT AS ones FROM p) SELECT n, d, floor((1 - d / (ones * (2 * n - ones) / (2.0::DOUBLE * n - 1))) * 1000000 + 1e-6)::BIGINT AS alpha_millionths FROM t"),
    "calibration_bins_brier": (compare.calibration, _L, PRED + ", q AS (SELECT quality, floor(least(n_chars, 2999) * 1000 / 3000)::BIGINT AS m FROM p) SELECT (m // 100)::BIGINT AS bin, count(*) AS n, sum(quality)::BIGINT AS positives, sum(m)::BIGINT AS score_sum, sum((m - 1000 * quality) * (m - 1000 * quality))::BIGINT AS brier_sum FROM q GROUP BY 1"),
    "share_by_genre_rollup": (compare.share_rollup, _L, PRED + " SELECT lang, source, count(*) AS n, sum(quality)::BIGINT AS good, (2 * grouping(lang) + grouping(source))::BIGINT AS level FROM p GROUP BY ROLLUP (lang, source)"),
    "apportion_budget": (compare.apportion, ("customer", "nation"), "WITH c AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS t FROM c), b AS (SELECT *, n * 1000 // t AS base, n * 1000 % t AS rest FROM t) SELECT n_name, n, (base + (row_number() OVER (ORDER BY rest DESC, n_name) <= 1000 - sum(base) OVER ())::INT)::BIGINT AS seats FROM b"),
    "user_event_runs": (compare.event_runs, _E, "WITH r AS (" + RUNS.format("user_id", "event_id", "event_type", "events") + ") SELECT user_id, event_type, min(event_id) AS first_pos, count(*) AS run_length FROM r GROUP BY user_id, event_type, i HAVING count(*) >= 3"),
    "first_seen_values": (compare.first_seen, _E, "SELECT user_id, event_type, min(event_id) AS first_pos FROM events GROUP BY 1, 2"),
}
