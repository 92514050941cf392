"""Edits between two drafts: protected surface, contracts, aligned sentences, patches, fixes, and what can be learnt from them."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselake.functions.spans import changed_span, occurrences, overlaps_any
from proselake.functions.text import placed_sentences, sentence_array
from proselake.operators.lexicon import refit

#: What an edit must not change, as (kind, pattern); the first group is the value.
ATOMS = [("url", r"(https?://[^\s)>\]]+)"), ("link", r"\]\(([^)\s]+)\)"), ("code", r"`([^`\n]+)`"), ("number", r"(?<![0-9A-Za-z.])([0-9][0-9,]*(?:\.[0-9]+)?)")]
LONGEST_OPERATION = 32


def surface(text: Column) -> Column:
    """Distinct atoms of each kind; numbers without commas."""
    values = lambda kind, p: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)), (lambda x: F.replace(x, F.lit(","), F.lit(""))) if kind == "number" else (lambda x: x)))
    return F.struct(*[values(kind, p).alias(kind) for kind, p in ATOMS])


def surface_diff(before: Column, after: Column) -> Column:
    """Array of struct(kind, lost, gained) for the kinds that differ."""
    a, b = surface(before), surface(after)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_except(a[k], b[k]).alias("lost"), F.array_except(b[k], a[k]).alias("gained")) for k, _ in ATOMS])
    return F.filter(rows, lambda r: (F.size(r["lost"]) > 0) | (F.size(r["gained"]) > 0))


def protected_atoms(text: str, terms: tuple[str, ...] = ()) -> Counter:
    """Atoms as a multiset of (kind, value), terms among them."""
    text = unicodedata.normalize("NFC", text)
    out = Counter((kind, m[1].replace(",", "") if kind == "number" else m[1]) for kind, p in ATOMS for m in re.finditer(p, text))
    return out + Counter(("term", t) for t in terms for _ in occurrences(text, t))


def protected_spans(text: str, terms: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    return sorted([m.span(1) for _, p in ATOMS for m in re.finditer(p, text)] + [s for t in terms for s in occurrences(text, t)])


def fact_lines(text: str) -> list[str]:
    """Lines that together hold all atoms: always the one with most that are missing yet, the earlier of equals."""
    lines = [(x, set(protected_atoms(x))) for x in text.split("\n")]
    missing, out = set().union(*(a for _, a in lines)), []
    while missing:
        line, atoms = max(lines, key=lambda x: len(x[1] & missing))
        out.append(line)
        missing -= atoms
    return out


@dataclass(frozen=True)
class Contract:
    """What a new draft has to keep: atoms, headings in order, lines of facts."""

    atoms: frozenset[tuple[str, str]]
    headings: tuple[str, ...]
    facts: tuple[str, ...]


def headings_of(text: str, level: int = 2) -> tuple[str, ...]:
    outside = re.sub(r"(?ms)^ {0,3}(```|~~~).*?(?:^ {0,3}\1|\Z)", "", text)
    return tuple(m[2].strip().rstrip("#").strip() for m in re.finditer(r"(?m)^ {0,3}(#{1,6})\s+(.*)$", outside) if len(m[1]) == level)


def contract_from(text: str, level: int = 2) -> Contract:
    return Contract(frozenset(protected_atoms(text)), headings_of(text, level), tuple(fact_lines(text)))


def check(text: str, contract: Contract, level: int = 2) -> list[tuple[str, str, str]]:
    """Violations (kind, was, now): lost and added atoms, headings that differ by place, lines of facts whose atoms are incomplete."""
    atoms, headings = set(protected_atoms(text)), headings_of(text, level)
    out = [("lost", f"{k}:{v}", "") for k, v in sorted(contract.atoms - atoms)] + [("added", "", f"{k}:{v}") for k, v in sorted(atoms - contract.atoms)]
    for i in range(max(len(headings), len(contract.headings))):
        was, now = (contract.headings[i : i + 1] or ("",))[0], (headings[i : i + 1] or ("",))[0]
        if was != now:
            out.append(("heading", was, now))
    return out + [("fact", line, "") for line in contract.facts if set(protected_atoms(line)) - atoms]


CHECK_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "was", "now")]))


@F.pandas_udf(CHECK_TYPE)
def violations(before: pd.Series, after: pd.Series) -> pd.Series:
    """What the later text violates of the contract that the earlier one makes."""
    return pd.Series([[dict(zip(("kind", "was", "now"), v, strict=True)) for v in check(b or "", contract_from(a or ""))] for a, b in zip(before, after, strict=True)])


def outline_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Headings (doc_id, level, title, in order of line) of two drafts by place: doc_id, place, was, now, status."""
    placed = lambda d, name: d.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).select("doc_id", "place", F.struct("level", "title").alias(name))
    j = placed(before, "was").join(placed(after, "now"), ["doc_id", "place"], "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return j.withColumn("status", status)


def align(before: list[str], after: list[str]) -> list[tuple[str, list[str]]]:
    """Sentences that were rewritten: replaced blocks of equal length pair by pair, and one sentence replaced by several."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if kind == "replace" and b - a == d - c:
            out += [(x, [y]) for x, y in zip(before[a:b], after[c:d], strict=True)]
        elif kind == "replace" and b - a == 1:
            out.append((before[a], after[c:d]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("was", T.StringType()), T.StructField("now", T.ArrayType(T.StringType()))])))
def aligned(before: pd.Series, after: pd.Series) -> pd.Series:
    """align over columns of sentence arrays."""
    return pd.Series([[{"was": x, "now": y} for x, y in align(list(a), list(b))] for a, b in zip(before, after, strict=True)])


def changed_pairs(drafts: DataFrame) -> DataFrame:
    """drafts: doc_id, before, after (texts). One row per rewritten sentence: doc_id, was, now (array)."""
    pairs = aligned(sentence_array(F.col("before")), sentence_array(F.col("after")))
    return drafts.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")


def learnt_examples(drafts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rewritten sentences whose finding (doc_id, rule, quote) is gone: doc_id, rule, was, now."""
    p = changed_pairs(drafts).withColumn("now", F.array_join("now", " "))
    had = p.join(before.select("doc_id", "rule", F.col("quote").alias("was")).distinct(), ["doc_id", "was"])
    return had.join(after.select("doc_id", "rule", F.col("quote").alias("now")).distinct(), ["doc_id", "rule", "now"], "left_anti").select("doc_id", "rule", "was", "now")


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """The span widened to whole words."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    while inside(start):
        start -= 1
    while inside(end):
        end += 1
    return start, end


def operation_from(before: str, after: str, terms: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """The substitution that an approved edit shows, if it is small and safe: it occurs once, changes no atom, and keeps the sentence's skeleton."""
    was, now = changed_span(before, after)
    if before == after or max(len(was), len(now)) > LONGEST_OPERATION:
        return None
    at = next((i for i in range(min(len(before), len(after))) if before[i] != after[i]), min(len(before), len(after)))
    start, end = word_bounds(before, at, at + len(was))
    old, new = before[start:end], before[start:at] + now + before[at + len(was) : end]
    skeleton = lambda s: re.sub(r"[^\W\d_]+", "w", re.sub(r"[0-9]+", "0", s))
    safe = protected_atoms(before, terms) == protected_atoms(after, terms) and _distance(skeleton(old), skeleton(new)) <= 1
    return (old, new) if old and safe and len(occurrences(before, old)) == 1 and max(len(old), len(new)) <= LONGEST_OPERATION else None


def apply_operation(text: str, old: str, new: str, terms: tuple[str, ...] = ()) -> str | None:
    """The text with the substitution, where exactly one place is a whole word and not protected."""
    guard = protected_spans(text, terms)
    places = [s for s in occurrences(text, old) if word_bounds(text, *s) == s and not overlaps_any(s, guard)]
    if len(places) != 1:
        return None
    a, b = places[0]
    return text[:a] + new + text[b:]


def paragraph_window(text: str, line: int) -> tuple[int, int]:
    """Offsets of the paragraph around a line (from 1)."""
    lines = text.split("\n")
    a = b = min(max(line - 1, 0), len(lines) - 1)
    while a and lines[a - 1].strip():
        a -= 1
    while b + 1 < len(lines) and lines[b + 1].strip():
        b += 1
    start = sum(len(x) + 1 for x in lines[:a])
    return start, start + len("\n".join(lines[a : b + 1]))


def apply_fixes(text: str, fixes: list[tuple[int, str, str]]) -> tuple[str, int, int]:
    """Apply (line, fragment, replacement) where the fragment is unique in its paragraph: the text, applied, skipped. Overlaps are skipped; particles are refitted."""
    places = []
    for line, old, new in fixes:
        a, b = paragraph_window(text, line)
        found = occurrences(text[a:b], old)
        if len(found) == 1 and not overlaps_any((found[0][0] + a, found[0][1] + a), [p[0] for p in places]):
            places.append(((found[0][0] + a, found[0][1] + a), new))
    out = text
    for (a, b), new in sorted(places, reverse=True):
        out = out[:a] + new + refit(new, out[b:])
    return out, len(places), len(fixes) - len(places)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("skipped", T.IntegerType())]))
def fixed(text: pd.Series, fixes: pd.Series) -> pd.DataFrame:
    """apply_fixes over columns; fixes is array<struct<line, fragment, replacement>>."""
    return pd.DataFrame([apply_fixes(t or "", [(f["line"], f["fragment"], f["replacement"]) for f in (fs if fs is not None else [])]) for t, fs in zip(text, fixes, strict=True)], columns=["text", "applied", "skipped"])


def fix_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, applied, skipped after the fixes of findings (doc_id, line, fragment, replacement)."""
    f = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "fragment", "replacement"))).alias("fixes"))
    return docs.join(f, "doc_id", "left").select("doc_id", fixed("text", "fixes").alias("f")).select("doc_id", "f.*")


def verify_patch(text: str, old: str, new: str, findings: object, rule: str) -> tuple[bool, list[str]]:
    """Whether a patch may be taken: it fits exactly once, its rule reports less, nothing else reports more, and atoms stay. findings(text) gives (rule, quote) pairs."""
    if len(occurrences(text, old)) != 1:
        return False, ["the patch does not fit exactly once"]
    after = text.replace(old, new)
    was, now = Counter(r for r, _ in findings(text)), Counter(r for r, _ in findings(after))
    issues = [] if now[rule] < was[rule] else [f"{rule} is not reduced"]
    issues += [f"{r} is new" for r in sorted(now) if r != rule and now[r] > was[r]]
    return not (issues := issues + (["protected text changes"] if protected_atoms(text) != protected_atoms(after) else [])), issues


def edit_issues(text: str, old: str, new: str, lines: list[int], most_chars: int, most_lines: int) -> list[str]:
    """Budget of an edit: its range holds a line with a finding and is short enough."""
    at = text.find(old)
    first = text.count("\n", 0, at) + 1
    last = first + old.count("\n")
    out = [] if any(first <= x <= last for x in lines) else ["no finding lies in the changed lines"]
    out += ["too many characters"] if max(len(old), len(new)) > most_chars else []
    return out + (["too many lines"] if last - first + 1 > most_lines else [])


def raw_sentences(blocks: DataFrame) -> DataFrame:
    """Sentences of prose blocks as they stand in the Markdown, with their line, beside the plain ones of the same block and place."""
    return blocks.filter("kind = 'prose'").select("doc_id", "block_index", "start_line", F.posexplode(placed_sentences(F.col("text"))).alias("place", "s")).select("doc_id", "block_index", "place", (F.col("start_line") + F.col("s.newlines")).alias("line"), F.col("s.quote").alias("raw"))
