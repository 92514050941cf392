"""Findings in one pass: configuration, switched-off lines, baselines, reviews and reports."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselake.functions.text import strip
from proselake.operators import document_rules  # noqa: F401  registers its rules
from proselake.operators.lexicon import LEXICON_RULES, Entry, lexicon_findings
from proselake.operators.structure import RULES, blocks_with_language, findings_of, prose_sentences
from proselake.sources.markdown import disabled_ranges

MECHANISMS = ("dictionary", "repeat", "threshold", "contrast", "reader")
#: Scope and mechanism of each rule.
CATALOGUE = {
    "calqueFrame": ("sentence", "dictionary"), "cliche": ("sentence", "dictionary"), "connectorRepeat": ("sentence", "repeat"), "danglingDeixis": ("sentence", "reader"),
    "dash": ("sentence", "dictionary"), "deixis": ("sentence", "reader"), "doubleNegative": ("sentence", "dictionary"), "doublePassive": ("sentence", "dictionary"),
    "draftHistory": ("sentence", "dictionary"), "endingRepeat": ("sentence", "repeat"), "euiChain": ("sentence", "threshold"), "fillerOpener": ("sentence", "dictionary"),
    "hardWord": ("sentence", "dictionary"), "imperativePeriod": ("sentence", "dictionary"), "japaneseLoan": ("sentence", "dictionary"), "longSentence": ("sentence", "threshold"),
    "negationRedefine": ("sentence", "repeat"), "nounPile": ("sentence", "threshold"), "numberOrphan": ("sentence", "reader"), "outsideProfile": ("sentence", "threshold"),
    "phraseRepeat": ("sentence", "repeat"), "redundantPair": ("sentence", "dictionary"), "translationese": ("sentence", "dictionary"), "factListParagraph": ("paragraph", "threshold"),
    "paraFragment": ("paragraph", "repeat"), "blockUnread": ("structure", "threshold"), "bridgeRepeat": ("structure", "repeat"), "emojiBullet": ("structure", "dictionary"),
    "headingSentence": ("structure", "threshold"), "headingSkip": ("structure", "threshold"), "headingUniform": ("structure", "repeat"), "introImage": ("structure", "threshold"),
    "introLong": ("structure", "threshold"), "loneSubheading": ("structure", "contrast"), "moreLater": ("structure", "threshold"), "sectionNoProse": ("structure", "threshold"),
    "countMismatch": ("document", "contrast"), "enoughOnce": ("document", "repeat"), "fieldEcho": ("document", "contrast"), "keywordHeading": ("document", "contrast"),
    "keywordMissing": ("document", "contrast"), "noQuestion": ("document", "threshold"), "promiseRecall": ("document", "reader"), "tableOddCell": ("document", "contrast"),
    "confusable": ("orthography", "dictionary"), "spacing": ("orthography", "dictionary"), "spelling": ("orthography", "dictionary"), "duplicateBlock": ("code", "repeat"),
    "firstResultDistance": ("code", "threshold"), "inputFileSource": ("code", "reader"), "installImport": ("code", "contrast"), "platformApi": ("code", "dictionary"),
    "screenNarration": ("screen", "dictionary"), "screenSentence": ("screen", "dictionary"), "screenTone": ("screen", "dictionary"), "screenWord": ("screen", "dictionary"),
}
COLUMNS = ["doc_id", "rule", "severity", "line", "quote", "why", "scope", "mechanism", "fix", "fragment", "candidates"]


@dataclass(frozen=True)
class Config:
    """What runs: a rule is on unless it is disabled, or the preset switches it off and it is not enforced."""

    disable: frozenset[str] = frozenset()
    enforce: frozenset[str] = frozenset()
    preset: str | None = None
    presets: dict[str, frozenset[str]] = field(default_factory=dict)
    severity: str = "notice"
    control: str = "lint"

    def __post_init__(self):
        unknown = (self.disable | self.enforce) - set(CATALOGUE)
        if unknown:
            raise ValueError(f"unknown rules {sorted(unknown)}; did you mean {[near_names(x) for x in sorted(unknown)]}?")
        if self.preset is not None and self.preset not in self.presets:
            raise ValueError(f"unknown preset {self.preset!r}")

    def enabled(self, rule: str) -> bool:
        off = self.presets.get(self.preset, frozenset()) if self.preset else frozenset()
        return rule not in self.disable and (rule not in off or rule in self.enforce)


def find_config(start: str | Path, name: str) -> Path | None:
    """The nearest file of that name in a folder or above it."""
    start = Path(start).resolve()
    return next((p / name for p in (start, *start.parents) if (p / name).is_file()), None)


def load_config(path: str | Path) -> Config:
    """A TOML file with the fields of Config; other keys are errors."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(raw) - set(Config.__dataclass_fields__):
        raise ValueError(f"unknown keys {sorted(unknown)}")
    sets = {k: frozenset(raw[k]) for k in ("disable", "enforce") if k in raw}
    presets = {"presets": {k: frozenset(v) for k, v in raw["presets"].items()}} if "presets" in raw else {}
    return Config(**(raw | sets | presets))


def near_names(query: str, names: Iterable[str] = tuple(CATALOGUE), most: int = 3) -> list[str]:
    """Names that hold the query or start like it."""
    q = query.lower()
    return ([n for n in sorted(names) if q in n.lower()] or [n for n in sorted(names) if n.lower()[:3] == q[:3]])[:most]


def rule_table(spark) -> DataFrame:
    """(rule, scope, mechanism, built) of all rules."""
    return spark.createDataFrame([(r, s, m, r in RULES or r in LEXICON_RULES) for r, (s, m) in CATALOGUE.items()], "rule string, scope string, mechanism string, built boolean")


def _labelled(found: DataFrame) -> DataFrame:
    scope = F.create_map(*[F.lit(x) for r, (s, _) in CATALOGUE.items() for x in (r, s)])
    mechanism = F.create_map(*[F.lit(x) for r, (_, m) in CATALOGUE.items() for x in (r, m)])
    return found.withColumn("scope", scope[F.col("rule")]).withColumn("mechanism", mechanism[F.col("rule")]).select(*COLUMNS)


def without_disabled(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose line no range (doc_id, rule, first, last) of the rule or of `*` covers. A document's ranges come as one array."""
    packed = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("rule", "first", "last")).alias("__off"))
    covers = lambda r: r["rule"].isin("*") | (r["rule"] == F.col("rule"))
    hit = F.exists("__off", lambda r: covers(r) & F.col("line").between(r["first"], r["last"]))
    return found.join(packed, "doc_id", "left").filter(~F.coalesce(hit, F.lit(False))).drop("__off")


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Errors only, or all."""
    return found.filter("severity = 'error'") if severity == "error" else found


def lint(docs: DataFrame, config: Config | None = None, entries: list[Entry] = ()) -> DataFrame:
    """Findings (COLUMNS) of Markdown texts (doc_id, text).

    The texts are parsed once: blocks are checkpointed where the session names a shared folder and kept in the executors
    otherwise, and every rule reads them. Lines that comments switch off are left out.
    """
    config = config or Config()
    blocks = blocks_with_language(docs)
    blocks = blocks.checkpoint() if docs.sparkSession.sparkContext.getCheckpointDir() else blocks.persist()
    names = [r for r in RULES if config.enabled(r)]
    texts = {name: F.lit(None).cast(kind) for name, kind in (("why", "string"), ("fix", "string"), ("fragment", "string"), ("candidates", "array<string>"))}
    found = findings_of(blocks, names).withColumns(texts)
    rules = {r: x for r, x in LEXICON_RULES.items() if config.enabled(r)}
    if entries and rules:
        found = found.unionByName(lexicon_findings(prose_sentences(blocks), list(entries), rules).select(*found.columns))
    return at_least(without_disabled(_labelled(found), disabled_ranges(blocks, config.control)), config.severity)


def normal_quote(quote: Column) -> Column:
    return F.regexp_replace(strip(quote), r"\s+", " ")


def baseline_of(found: DataFrame) -> DataFrame:
    """Distinct (doc_id, rule, quote), the quote with single blanks."""
    return found.select("doc_id", "rule", normal_quote(F.col("quote")).alias("quote")).distinct()


def prune(baseline: DataFrame, found: DataFrame, scanned: DataFrame) -> DataFrame:
    """Baseline entries that are still found; those of documents that were not scanned stay."""
    still = baseline.join(baseline_of(found), ["doc_id", "rule", "quote"], "left_semi")
    return still.unionByName(baseline.join(scanned.select("doc_id").distinct(), "doc_id", "left_anti").select(*still.columns))


def baseline_json(baseline: DataFrame) -> DataFrame:
    """One sorted JSON line per document."""
    return baseline.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("rule", "quote")))).alias("locked"))


def worst(found: DataFrame) -> DataFrame:
    """The worst finding of each line and scope: errors first, then by name."""
    w = Window.partitionBy("doc_id", "scope", "line").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "rule", "quote")
    return found.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def summary(found: DataFrame) -> DataFrame:
    """Per document: errors, notices and the commonest rule (ties by name)."""
    n = found.groupBy("doc_id", "rule").agg(F.sum((F.col("severity") == "error").cast("long")).alias("e"), F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.sum("e").alias("errors"), F.sum(F.col("n") - F.col("e")).alias("notices"), F.min(F.struct((-F.col("n")).alias("k"), "rule")).getField("rule").alias("commonest"))


def reader_debts(found: DataFrame) -> DataFrame:
    return found.filter("mechanism = 'reader'")


def finding_id(doc: Column, rule: Column, line: Column, quote: Column) -> Column:
    """16 hex digits that name a finding."""
    return F.substring(F.sha2(F.concat_ws("\u0000", doc.cast("string"), rule, line.cast("string"), quote), 256), 1, 16)


def as_json(found: DataFrame) -> DataFrame:
    """One JSON line per finding."""
    return found.select("doc_id", F.to_json(F.struct(*[c for c in found.columns if c != "doc_id"])).alias("json"))


def as_annotations(found: DataFrame, path: Column) -> DataFrame:
    """Workflow annotations: `::level file=,line=::rule: quote`."""
    escaped = F.replace(F.replace(F.replace(F.col("quote"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    level = F.when(F.col("severity") == "error", "error").otherwise("notice")
    return found.select("doc_id", F.format_string("::%s file=%s,line=%d::%s: %s", level, path, F.col("line"), F.col("rule"), escaped).alias("annotation"))


def as_text(found: DataFrame) -> DataFrame:
    """One report per document, by line and rule."""
    row = F.struct("line", "rule", F.format_string("%d: %s [%s] %s", F.col("line"), F.col("severity"), F.col("rule"), F.col("quote")).alias("out"))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["out"]), "\n").alias("report"))


def find_line(text: str, quote: str, head: int = 24, least: int = 6) -> int | None:
    """The first line (from 1) that holds the start of a quote; blanks do not count. Else the first pair of lines that holds it."""
    flat = lambda s: re.sub(r"\s+", "", s)
    want = flat(quote)[:head]
    if len(want) < least:
        return None
    lines = [flat(x) for x in text.split("\n")]
    for i, line in enumerate(lines):
        if want in line:
            return i + 1
    return next((i + 1 for i in range(len(lines) - 1) if want in lines[i] + lines[i + 1]), None)


@F.pandas_udf(T.IntegerType())
def located(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([find_line(t or "", q or "") for t, q in zip(text, quote, strict=True)], dtype="Int32")


def review_coverage(docs: DataFrame, reviews: DataFrame, found: DataFrame, near: int = 1) -> DataFrame:
    """The reviews (doc_id, quote, kind) with their line, and whether a finding lies at most `near` lines away."""
    r = reviews.withColumn("review", F.monotonically_increasing_id()).join(docs.select("doc_id", "text"), "doc_id").withColumn("line", located("text", "quote")).drop("text")
    lines = found.select("doc_id", F.explode(F.sequence(F.col("line") - near, F.col("line") + near)).alias("line"), "severity").groupBy("doc_id", "line").agg(F.max((F.col("severity") == "error").cast("int")).alias("by_error"))
    out = r.join(lines, ["doc_id", "line"], "left")
    return out.select("doc_id", "kind", "quote", "line", F.col("by_error").isNotNull().alias("covered"), F.coalesce(F.col("by_error") == 1, F.lit(False)).alias("by_error"))
