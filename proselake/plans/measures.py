"""Queries over the measures of proselake.operators.measures and their SQL."""

from __future__ import annotations

from proselake.functions.markers import ENDINGS, NO_ENDING, NUMBER, OPENER, TRAILING
from proselake.operators import measures as m
from proselake.plans.catalogue import _BLANK, PRED, RUNS, WORDS, S, _D, _L, _sentences

_LINES = "l1 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS b FROM documents), l2 AS (SELECT doc_id, b, unnest(range(len(b))) AS i FROM l1), l AS (SELECT doc_id, i::INT AS paragraph, b[i + 1] AS text FROM l2), "
PARA = "WITH " + _LINES + _sentences("l", "doc_id, paragraph, text") + ", p AS (SELECT doc_id, paragraph, text, len(a) AS sentences FROM s1 WHERE len(a) > 0)"
_T = TRAILING.replace("'", "''")
_ENDING = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(sentence, '{_T}', ''), '{p}') THEN '{k}'" for k, p in ENDINGS) + f" ELSE '{NO_ENDING}' END"
_COMMAS = "len(sentence) - len(replace(sentence, ',', ''))"
_NUMBERS = f"len(regexp_extract_all(sentence, '{NUMBER}'))"

MEASURES = {
    "sentence_features": (m.sentence_features, _D, S + f", e AS (SELECT *, {_ENDING} AS ending FROM s) SELECT doc_id, pos, words, ending, CASE WHEN ends_with(sentence, '?') OR ending = '의문' THEN '의문' WHEN ending = '명령' THEN '명령' ELSE '평서' END AS mood, nullif(regexp_extract(sentence, '{OPENER}', 1), '') AS connector, ({_COMMAS})::INT AS commas, ({_NUMBERS})::INT AS numbers FROM e"),
    "fragment_runs": (m.fragment_runs, _D, PARA + ", x AS (SELECT doc_id, paragraph, sentences <= 2 AS short FROM p), r AS (" + RUNS.format("doc_id", "paragraph", "short", "x") + ") SELECT doc_id, min(paragraph) AS first_pos, count(*) AS run_length FROM r WHERE short GROUP BY doc_id, i HAVING count(*) >= 3"),
    "fact_list_paragraphs": (m.fact_lists, _D, PARA + f" SELECT doc_id, paragraph, count(*) AS sentences, sum(words)::BIGINT AS words FROM s GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(words) <= 8 * count(*) AND NOT bool_or(ends_with(sentence, '?') OR regexp_matches(sentence, '{OPENER}'))"),
    "flow_valleys": (m.flow_valleys, _D, PARA + f", x AS (SELECT doc_id, paragraph, sentences, {WORDS.format('text')} AS w FROM p), y AS (SELECT *, lag(w) OVER o AS v, lag(sentences) OVER o AS before FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY paragraph)) SELECT doc_id, paragraph FROM y WHERE before >= 2 AND sentences >= 2 AND len(list_intersect(w, v)) = 0"),
    "wrapped_lines": (m.wrapped_lines, _D, f"WITH a AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS l FROM documents), b AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' AND l[i + 1] <> '') AS q FROM a) SELECT doc_id, len(q)::INT AS pairs, len(list_filter(q, lambda x: right(x, 1) NOT IN ('.', '?', '!')))::INT AS wrapped FROM b"),
    "dash_lines": (m.dash_lines, _D, "WITH " + _LINES.rstrip(", ") + " SELECT doc_id, paragraph + 1 AS line FROM l WHERE regexp_matches(text, '[–—]')"),
    "rhythm_buckets": (m.rhythm, _D, S + " SELECT lang, " + ", ".join(f"sum((words BETWEEN {a} AND {b})::INT)::BIGINT AS from_{a}" for a, b in m.BUCKETS) + " FROM s GROUP BY 1"),
    "share_at_or_above": (m.share_at_least, _D, S + " SELECT lang, (sum((words >= 20)::INT)::BIGINT * 1000 // count(*))::BIGINT AS permille FROM s GROUP BY 1"),
    "document_density": (m.density, _D, S + f", d AS (SELECT doc_id, sum(words)::BIGINT AS words, sum({_COMMAS})::BIGINT AS commas, sum({_NUMBERS})::BIGINT AS numbers, sum(ends_with(sentence, '?')::INT)::BIGINT AS questions FROM s GROUP BY 1) SELECT doc_id, words, " + ", ".join(f"({c} * 1000 // words)::BIGINT AS {c}" for c in ("commas", "numbers", "questions")) + " FROM d WHERE words > 0"),
    "document_vocabulary": (m.vocabulary, _D, f"WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents) SELECT doc_id, len(w)::INT AS tokens, len(list_distinct(w))::INT AS types FROM w"),
    "top_words": (m.top_words, _D, f"WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM w) SELECT * FROM r WHERE rank <= 8"),
    "ending_mix": (lambda docs: m.sentence_features(docs).groupBy("ending", "mood").count().withColumnRenamed("count", "n"), _D, S + f", e AS (SELECT *, {_ENDING} AS ending FROM s) SELECT ending, CASE WHEN ends_with(sentence, '?') OR ending = '의문' THEN '의문' WHEN ending = '명령' THEN '명령' ELSE '평서' END AS mood, count(*) AS n FROM e GROUP BY ALL"),
    "length_deltas": (m.length_deltas, _D, S + ", x AS (SELECT doc_id, abs(words - lag(words) OVER (PARTITION BY doc_id ORDER BY pos)) AS d FROM s) SELECT doc_id, count(*) AS pairs, sum(d)::BIGINT AS total, max(d) AS largest FROM x WHERE d IS NOT NULL GROUP BY 1"),
    "phrase_dominance": (m.phrase_dominance, _D, S + r" SELECT doc_id, count(*) AS sentences, sum(regexp_matches(lower(sentence), '\bthe\b')::INT)::BIGINT AS hits FROM s GROUP BY 1 HAVING count(*) >= 8 AND hits >= 2 AND hits > 0.08::DOUBLE * count(*)"),
    "stable_ids": (m.stable_ids, _D, "SELECT doc_id, left(sha256(concat_ws(chr(10), source, text)), 16) AS stable_id FROM documents"),
    "added_findings": (m.added_findings, _D, S + " SELECT lang, words, count(*) AS n FROM (SELECT lang, words FROM s WHERE words > 30 EXCEPT ALL SELECT lang, words FROM s WHERE words > 40) GROUP BY ALL"),
    "risk_coverage": (m.risk_coverage, _L, PRED + ", c AS (SELECT (least(abs(n_chars - 1500), 1500) * 1000 // 1500)::BIGINT AS confidence, count(*) AS n, sum((quality <> pred)::INT) AS w FROM p GROUP BY 1) SELECT confidence, (sum(n) OVER o)::BIGINT AS covered, (sum(w) OVER o)::BIGINT AS wrong FROM c WINDOW o AS (ORDER BY confidence DESC)"),
    "strict_consensus": (m.strict_consensus, _L, PRED + ", r AS (SELECT doc_id, list_filter([quality::INT, pred, 1 - toxic::INT], lambda x: x IS NOT NULL) AS r FROM p), v AS (SELECT doc_id, len(r)::INT AS answered, len(list_filter(r, lambda x: x = 1))::INT AS yes FROM r) SELECT *, CASE WHEN answered < 2 THEN 'none' WHEN 2 * yes > answered THEN 'yes' WHEN 2 * yes < answered THEN 'no' ELSE 'none' END AS verdict FROM v"),
}
