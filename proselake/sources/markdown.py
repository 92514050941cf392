"""Markdown into blocks: a line automaton per document, run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "doc_id long, block_index int, kind string, start_line int, end_line int, level int, text string"
_FENCE = re.compile(r" {0,3}(```+|~~~+)(.*)")
_KINDS = [
    ("code", re.compile(r"( {4}|\t)")),
    ("heading", re.compile(r" {0,3}#{1,6}(\s|$)")),
    ("quote", re.compile(r" {0,3}>")),
    ("image", re.compile(r" {0,3}!\[")),
    ("table", re.compile(r" {0,3}\|")),
    ("list", re.compile(r" {0,3}([-*+]|\d+[.)])\s")),
    ("html", re.compile(r" {0,3}<")),
]


def kind_of(line: str) -> str:
    """A block's kind by its first line; the first kind that fits counts."""
    return next((kind for kind, pattern in _KINDS if pattern.match(line)), "prose")


def front_matter(lines: list[str]) -> tuple[dict[str, str], int]:
    """Key-value lines between two `---` lines at the start, and the first line after them."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            pairs = (re.match(r"([A-Za-z]\w*):\s*(.*)", x) for x in lines[1:i])
            return {m[1]: m[2].strip() for m in pairs if m}, i + 1
    return {}, 0


def blocks_of(text: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, first line, last line, level, text); lines count from 1."""
    lines = text.split("\n")
    _, at = front_matter(lines)
    out: list[tuple[str, int, int, int, str]] = []
    held: list[str] = []

    def close(last: int, kind: str | None = None) -> None:
        if held:
            kind = kind or kind_of(held[0])
            level = len(held[0].strip()) - len(held[0].strip().lstrip("#")) if kind == "heading" else 0
            out.append((kind, last - len(held) + 1, last, level, "\n".join(held)))
            held.clear()

    while at < len(lines):
        line = lines[at]
        if fence := _FENCE.match(line):
            close(at)
            held.append(line)
            while at + 1 < len(lines):
                at += 1
                held.append(lines[at])
                end = _FENCE.match(lines[at])
                if end and end[1].startswith(fence[1]) and not end[2].strip():
                    break
            close(at + 1, "code")
        elif not line.strip():
            close(at)
        elif kind_of(line) == "heading":
            close(at)
            held.append(line)
            close(at + 1)
        else:
            held.append(line)
        at += 1
    close(len(lines))
    return out


def parse_markdown(docs: DataFrame, front: bool = False) -> DataFrame:
    """One row per block. Sections are numbered by add_sections. With `front`, each pair of the front matter is a
    block of kind `front` before the others, its text `key: value`."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            rows = [(i, n, k, a, b, level, t) for i, text in zip(d.doc_id, d.text, strict=True) for n, (k, a, b, level, t) in enumerate(blocks_of(text or ""))]
            if front:
                rows += [(i, -1 - n, "front", 1, 1, 0, f"{k}: {v}") for i, text in zip(d.doc_id, d.text, strict=True) for n, (k, v) in enumerate(front_matter((text or "").split("\n"))[0].items())]
            yield pd.DataFrame(rows, columns=["doc_id", "block_index", "kind", "start_line", "end_line", "level", "text"])

    return docs.select("doc_id", "text").mapInPandas(f, BLOCKS)


def parse_front_matter(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value, first body line) of every front matter."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            rows = [(i, k, v, at + 1) for i, text in zip(d.doc_id, d.text, strict=True) for pairs, at in [front_matter((text or "").split("\n"))] for k, v in pairs.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "key", "value", "body_line"])

    return docs.select("doc_id", "text").mapInPandas(f, "doc_id long, key string, value string, body_line int")


def drop_fences(blocks: DataFrame, languages: list[str]) -> DataFrame:
    """Blocks without the code of these fence languages, numbered anew; line numbers stay."""
    language = F.lower(F.regexp_extract("text", r"^ {0,3}(?:```+|~~~+)[ \t]*([^\s]*)", 1))
    left = blocks.filter((F.col("kind") != "code") | ~language.isin(languages))
    return left.withColumn("block_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index")) - 1).cast("int"))


def disabled_ranges(blocks: DataFrame, prefix: str = "lint") -> DataFrame:
    """(doc_id, rule, first, last) of lines in which comments switch rules off; rule `*` is all, an open range has no end.

    `<!-- PREFIX-disable [rules] -->` holds up to the next `PREFIX-enable` of the same rules or to the end,
    `<!-- PREFIX-disable-next [rules] -->` (or -next-line) for the next block.
    """
    sign = rf"<!--\s*{prefix}-(disable-next-line|disable-next|disable|enable)\b([^>]*?)-->"
    after = Window.partitionBy("doc_id").orderBy("block_index")
    b = blocks.select("doc_id", "block_index", "start_line", "kind", "text", F.lead("start_line").over(after).alias("next_first"), F.lead("end_line").over(after).alias("next_last"))
    c = b.filter("kind = 'html'").withColumn("action", F.regexp_extract("text", sign, 1)).filter("action <> ''")
    names = F.filter(F.split(F.trim(F.regexp_extract("text", sign, 2)), r"[\s,]+"), lambda x: x != "")
    c = c.select("doc_id", "block_index", "start_line", "action", "next_first", "next_last", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("*")))).alias("rule"))
    once = c.filter("action like 'disable-next%' and next_first is not null").select("doc_id", "rule", F.col("next_first").alias("first"), F.col("next_last").alias("last"))
    c = c.filter("action in ('disable', 'enable')")
    # a general enable ends every range
    ends = c.filter("action = 'enable'").select("doc_id", F.col("rule").alias("ended"), F.col("start_line").alias("end"))
    opens = c.filter("action = 'disable'").alias("o").join(ends.alias("e"), (F.col("o.doc_id") == F.col("e.doc_id")) & (F.col("e.end") > F.col("o.start_line")) & ((F.col("ended") == F.col("rule")) | (F.col("ended") == "*")), "left")
    opens = opens.groupBy("o.doc_id", "rule", F.col("start_line").alias("first")).agg(F.coalesce(F.min("end"), F.lit(2**31 - 1)).alias("last"))
    return once.unionByName(opens)


def add_sections(blocks: DataFrame) -> DataFrame:
    """A level-2 heading opens a section; section 0 is the introduction."""
    opens = F.when((F.col("kind") == "heading") & (F.col("level") == 2), 1).otherwise(0)
    return blocks.withColumn("section_index", F.sum(opens).over(Window.partitionBy("doc_id").orderBy("block_index")))
