"""Lexicons as data: entries with patterns, exceptions and fixes, matched against any table of texts.

An entry's pattern is a regular expression; `{ㄴ}` and `{ㄹ}` stand for all syllables with that final
consonant and `{조사}` for a particle that follows. All entries run in one pass over the texts, behind a
search for a literal that the pattern needs. Entries come from TOML files of a folder that the caller names.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselake.functions.hangul import FINALS, FIRST, fit_particle, is_syllable
from proselake.functions.spans import changed_span, code_spans, inside_any, overlaps_any, plain, quote_spans
from proselake.functions.tokens import PARTICLES

MATCH_DDL = "ord int, dictionary string, pattern string, start_at int, end_at int, matched string, fix string, rewrite string, why string, candidates array<string>, line_offset int, plain string"
#: Rules that report the matches of one lexicon: rule -> (lexicon, severity).
LEXICON_RULES = {
    "calqueFrame": ("calqueFrame", "error"),
    "cliche": ("cliches", "error"),
    "hardWord": ("easyWords", "error"),
    "japaneseLoan": ("japaneseLoan", "error"),
    "redundantPair": ("redundantPair", "error"),
    "translationese": ("translationese", "error"),
    "confusable": ("confusable", "notice"),
    "spacing": ("spacing", "error"),
    "spelling": ("spelling", "error"),
    "draftHistory": ("draftHistory", "notice"),
    "deixis": ("deixis", "error"),
    "screenNarration": ("screenNarration", "error"),
    "screenSentence": ("screenSentence", "error"),
    "screenTone": ("screenTone", "error"),
    "screenWord": ("screenWord", "error"),
}


@dataclass(frozen=True)
class Entry:
    dictionary: str
    pattern: str
    why: str = ""
    source: str = ""
    fix: str | None = None
    to: tuple[tuple[str, str], ...] = ()
    unless: str | None = None
    keep: str | None = None
    candidates: tuple[str, ...] = ()


def expand_classes(pattern: str) -> str:
    """The pattern with its placeholders written out."""
    for letter, final in (("ㄴ", 4), ("ㄹ", 8)):
        pattern = pattern.replace("{%s}" % letter, "[" + "".join(chr(FIRST + FINALS * i + final) for i in range(399)) + "]")
    return pattern.replace("{조사}", f"(?={'|'.join(PARTICLES)})")


def needed_literal(pattern: str) -> str:
    """The longest text that every match of the pattern holds; '' where none can be told."""
    best, run = "", ""
    if "|" in re.sub(r"\(\?[:!=<].*?\)|\[.*?\]|\(.*?\)", "", pattern):
        return ""
    for i, c in enumerate(re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*+]?(\{[^}]*\})?|\[[^\]]*\][?*+]?(\{[^}]*\})?|\\.", "\x00", pattern) + "\x00"):
        if c in "?*{" :
            run = run[:-1]
        if c.isalnum() or c == " ":
            run += c
        else:
            best, run = max(best, run, key=len), ""
    return best


def load_lexicons(folder: str | Path, names: list[str] | None = None, extra: list[dict] | None = None) -> list[Entry]:
    """Entries of the TOML files of a folder (`[[entry]]`) and of lists of patterns in text files; `extra` (with `dictionary`) follows.

    An unknown name is an error."""
    out = []
    for name in names if names is not None else sorted({p.stem for p in Path(folder).glob("*.toml")}):
        toml, text = Path(folder, f"{name}.toml"), Path(folder, f"{name}.txt")
        if toml.exists():
            out += [entry_of(name, raw) for raw in tomllib.loads(toml.read_text(encoding="utf-8")).get("entry", [])]
        elif text.exists():
            out += [Entry(name, line) for line in load_lines(text)]
        else:
            raise ValueError(f"no lexicon is named {name!r}")
    return out + [entry_of(raw["dictionary"], raw) for raw in extra or []]


def load_lines(path: str | Path) -> list[str]:
    """Items of a text file, one a line; `#` begins a comment line."""
    return [x for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")]


def entry_of(dictionary: str, raw: dict | str) -> Entry:
    if isinstance(raw, str):
        return Entry(dictionary, raw)
    to = raw.get("to", [])
    pairs = tuple((x["from"], x["into"]) if isinstance(x, dict) else tuple(x) for x in to) if isinstance(to, list) else ()
    return Entry(dictionary, raw["pattern"], raw.get("why", ""), raw.get("source", ""), raw.get("fix"), pairs, raw.get("unless"), raw.get("keep"), tuple(raw.get("candidates", ())))


def apply_fix(match: re.Match, fix: str) -> str:
    """The fix with `$n` as the match's groups."""
    return re.sub(r"\$(\d)", lambda g: match[int(g[1])] or "", fix)


def refit(text: str, after: str) -> str:
    """What follows a replaced text, with the particle that fits its new end."""
    for closed_or_open in sorted(PARTICLES, key=len, reverse=True):
        if after.startswith(closed_or_open) and text and is_syllable(text[-1]):
            rest = after[len(closed_or_open) :]
            if not rest or not is_syllable(rest[0]):
                return fit_particle(text, closed_or_open) + rest
    return after


def rewrite_by(text: str, rules: tuple[tuple[str, str], ...]) -> str | None:
    """The whole text changed by the first rule that fits, blanks made single; None where nothing changes."""
    for pattern, into in rules:
        if re.search(pattern, text):
            new = re.sub(r"\s+", " ", re.sub(pattern, lambda m: apply_fix(m, into), text)).strip()
            return new if new != text else None
    return None


class Matcher:
    """Compiled entries."""

    def __init__(self, entries: list[Entry]):
        compiled = lambda p: re.compile(expand_classes(p)) if p else None
        self.entries = [(i, e, compiled(e.pattern), compiled(e.unless), compiled(e.keep), needed_literal(expand_classes(e.pattern) if "{" in e.pattern else e.pattern)) for i, e in enumerate(entries)]

    def matches(self, text: str, protected: list[tuple[int, int]] = ()) -> list[tuple]:
        """Rows of MATCH_DDL without the last: by start, then entry."""
        out = []
        for i, e, pattern, unless, keep, literal in self.entries:
            if literal not in text or (unless and unless.search(text)):
                continue
            kept = [m.span() for m in keep.finditer(text)] if keep else []
            for m in pattern.finditer(text):
                if m.end() == m.start() or overlaps_any(m.span(), kept) or inside_any(m.span(), protected):
                    continue
                fix = apply_fix(m, e.fix) if e.fix is not None else None
                out.append((i, e.dictionary, e.pattern, m.start(), m.end(), m[0], fix, rewrite_by(text, e.to), e.why, list(e.candidates), text.count("\n", 0, m.start())))
        return sorted(out, key=lambda r: (r[3], r[0]))


def match_entries(rows: DataFrame, entries: list[Entry], text: str = "sentence", markdown: bool = False) -> DataFrame:
    """The columns of rows but `text`, and one row per match (MATCH_DDL); offsets are code points.

    With `markdown`, inline marks are taken away first, and matches inside inline code or quotations do not count.
    """
    keep = [c for c in rows.columns if c != text]
    ddl = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(entries)
        for d in frames:
            found = []
            for i, t in enumerate(d[text]):
                raw = t or ""
                flat = plain(raw) if markdown else raw
                guard = quote_spans(flat) + code_spans(raw, flat) if markdown else []
                found += [(i, *m, flat) for m in matcher.matches(flat, guard)]
            out = d[keep].iloc[[r[0] for r in found]].reset_index(drop=True)
            for at, name in enumerate(("ord", "dictionary", "pattern", "start_at", "end_at", "matched", "fix", "rewrite", "why", "candidates", "line_offset", "plain"), 1):
                out[name] = pd.Series([r[at] for r in found], dtype=object)
            yield out

    return rows.select(*keep, text).mapInPandas(f, f"{ddl}, {MATCH_DDL}")


def last_per_span(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Of matches of one span the last entry's."""
    w = Window.partitionBy(*keys, "start_at", "end_at").orderBy(F.desc("ord"))
    return matches.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def first_per_text(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first match of each text: by start, then entry."""
    w = Window.partitionBy(*keys).orderBy("start_at", "ord")
    return matches.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


@F.pandas_udf(T.StringType())
def corrected(text: pd.Series, start: pd.Series, end: pd.Series, fix: pd.Series) -> pd.Series:
    """The text with the span replaced and the particle after it refitted; null without a fix."""
    return pd.Series([None if f is None or f != f else t[: int(a)] + f + refit(f, t[int(b) :]) for t, a, b, f in zip(text, start, end, fix, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("was", T.StringType()), T.StructField("now", T.StringType())]))
def changed(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The fragment that differs between two texts."""
    return pd.DataFrame([changed_span(a or "", b or "") for a, b in zip(before, after, strict=True)], columns=["was", "now"])


def lexicon_findings(sentences: DataFrame, entries: list[Entry], rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Findings of the lexicon rules in sentences (doc_id, section_index, block_index, line, pos, place, quote) of Markdown.

    One finding per match: rule, severity, line of the match, the sentence, why, what stands there and the corrected sentence.
    A span that several entries of one lexicon match is reported by the last of them.
    """
    rules = rules or LEXICON_RULES
    by_name = {lexicon: (rule, severity) for rule, (lexicon, severity) in rules.items()}
    used = [replace(e) for e in entries if e.dictionary in by_name]
    found = match_entries(sentences.select("doc_id", "line", "pos", "quote"), used, "quote", markdown=True)
    found = last_per_span(found, ["doc_id", "pos", "dictionary"])
    names = F.create_map(*[F.lit(x) for k, (rule, _) in by_name.items() for x in (k, rule)])
    severities = F.create_map(*[F.lit(x) for k, (_, severity) in by_name.items() for x in (k, severity)])
    return found.select("doc_id", names[F.col("dictionary")].alias("rule"), severities[F.col("dictionary")].alias("severity"), (F.col("line") + F.col("line_offset")).cast("int").alias("line"), F.col("plain").alias("quote"), "why", F.col("matched").alias("fragment"), F.coalesce("rewrite", corrected("plain", "start_at", "end_at", "fix")).alias("fix"), "candidates")
