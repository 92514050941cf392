"""Other sources: texts that a program shows its users, wiki markup, XML dumps and vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LITERAL_DDL = "doc_id long, line int, column int, text string, plain string"
SOURCE_SUFFIXES = ("py", "js", "jsx", "ts", "tsx", "svelte", "vue", "rs", "go", "java", "kt", "swift", "dart")
#: Lines whose texts only developers see.
DEVELOPER = r"\b(?:console\.(?:log|debug|warn|error)|logger\.|logging\.|log\.(?:debug|info|warn|error)|assert|raise|throw new|panic!|eprintln!|print\(f?['\"]DEBUG)"


def closing(text: str, at: int, quote: str) -> int:
    """Where a literal that opens at `at` closes; -1 without an end. Escapes and `${...}` of templates are passed over."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == quote:
            return i
        elif quote == "`" and text.startswith("${", i):
            i = balanced(text, i + 1) + 1 or len(text)
        elif text[i] == "\n" and quote != "`":
            return -1
        else:
            i += 1
    return -1


def balanced(text: str, at: int) -> int:
    """The brace that closes the one at `at`; literals inside do not count."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            end = closing(text, i, c)
            i = end if end > 0 else i
        depth += (c == "{") - (c == "}")
        if not depth:
            return i
        i += 1
    return -1


def source_literals(source: str, script: str = "가-힣") -> list[tuple[int, int, str, str]]:
    """(line, column, text, plain) of literals and of text between tags that hold a letter of the script, in order.

    Comments, style blocks and lines for developers are left out; in plain, expressions and tags are gone.
    """
    letter = re.compile(f"[{script}]")
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    s = re.sub(r"(?s)<style.*?</style>|/\*.*?\*/|<!--.*?-->", blank, source)
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if s.startswith("//", i) and (i == 0 or s[i - 1] != ":") or (c == "#" and (i == 0 or s[i - 1] in " \t\n") and not s.startswith("#!", i)):
            i = s.find("\n", i) if "\n" in s[i:] else len(s)
            continue
        if c in "'\"`" and s.startswith(c * 3, i):
            end = s.find(c * 3, i + 3)
            out.append((i + 3, s[i + 3 : end if end >= 0 else len(s)]))
            i = end + 3 if end >= 0 else len(s)
            continue
        if c in "'\"`" and (end := closing(s, i, c)) > 0:
            out.append((i + 1, s[i + 1 : end]))
            i = end + 1
            continue
        if c == ">" and (m := re.compile(r">([^<>]*)</?[A-Za-z]").match(s, i)) and letter.search(m[1]) and "=>" not in s[max(0, i - 1) : i + 1]:
            body = m[1].strip()
            out.append((i + 1 + m[1].index(body), body))
            i += 1 + len(m[1])
            continue
        i += 1
    lines = source.split("\n")
    found = []
    for at, text in out:
        line = source.count("\n", 0, at)
        flat = plain_literal(text)
        if letter.search(flat) and not re.search(DEVELOPER, lines[line]):
            found.append((line + 1, at - (source.rfind("\n", 0, at) + 1), text, flat))
    return found


def plain_literal(text: str) -> str:
    """Without expressions in braces and tags."""
    out, i = "", 0
    while i < len(text):
        at = i + 1 if text.startswith("${", i) else i
        if text[at : at + 1] == "{" and (end := balanced(text, at)) > 0:
            out, i = out + " ", end + 1
        else:
            out, i = out + text[i], i + 1
    return re.sub(r"\s+", " ", re.sub(r"</?[A-Za-z][^>]*>", " ", out)).strip()


def literal_rows(docs: DataFrame, script: str = "가-힣") -> DataFrame:
    """One row per literal of source texts (doc_id, text)."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            rows = [(i, *x) for i, t in zip(d.doc_id, d.text, strict=True) for x in source_literals(t or "", script)]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "column", "text", "plain"])

    return docs.select("doc_id", "text").mapInPandas(f, LITERAL_DDL)


def write_back(source: str, rows: list[tuple[int, int, str, str]]) -> tuple[str, int]:
    """Replace literals (line, column, old, new) where the old text stands; the text and how many were written."""
    lines, done = source.split("\n"), 0
    for line, column, old, new in sorted(rows, reverse=True):
        if line <= len(lines) and lines[line - 1].startswith(old, column):
            lines[line - 1] = lines[line - 1][:column] + new + lines[line - 1][column + len(old) :]
            done += 1
    return "\n".join(lines), done


def sheet(rows: DataFrame) -> DataFrame:
    """Rows (place, rules, text, fix) as lines of a Markdown table; bars are escaped."""
    cell = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return rows.select("doc_id", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in ("place", "rules", "text", "fix")]), F.lit(" |")).alias("row"))


def split_row(row: str) -> list[str] | None:
    """The cells of a table line, unescaped; None for other lines and rules."""
    if not row.strip().startswith("|"):
        return None
    cells = [c.strip() for c in re.split(r"(?<!\\)(?:\\\\)*\|", row.strip()[1:-1])] if "\\" not in row else _cells(row.strip()[1:-1])
    return None if all(re.fullmatch(":?-{2,}:?", c) for c in cells) else cells


def _cells(row: str) -> list[str]:
    out, cell, i = [], "", 0
    while i < len(row):
        if row[i] == "\\" and i + 1 < len(row) and row[i + 1] in "\\|":
            cell, i = cell + row[i + 1], i + 2
        elif row[i] == "|":
            out, cell, i = [*out, cell.strip()], "", i + 1
        else:
            cell, i = cell + row[i], i + 1
    return [*out, cell.strip()]


def strip_nested(text: str, left: str, right: str, keep: object = lambda inner: "") -> str:
    """Text without nested pairs such as templates; keep(inner) stands in for an outermost one."""
    out, depth, start, i = "", 0, 0, 0
    while i < len(text):
        if text.startswith(left, i):
            start = i + len(left) if not depth else start
            depth, i = depth + 1, i + len(left)
        elif depth and text.startswith(right, i):
            depth, i = depth - 1, i + len(right)
            out += keep(text[start : i - len(right)]) if not depth else ""
        else:
            out += "" if depth else text[i]
            i += 1
    return out


def normalize_wikitext(text: str, files: tuple[str, ...] = ("File", "Image", "파일", "그림"), stop: tuple[str, ...] = ("각주", "같이 보기", "외부 링크", "References", "See also", "External links")) -> str:
    """Wiki markup as Markdown, up to the first heading of notes and links."""
    text = re.sub(r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>", "", text)
    text = strip_nested(strip_nested(text, "{{", "}}"), "{|", "|}")
    text = strip_nested(text, "[[", "]]", lambda x: "" if re.match(rf"\s*(?:{'|'.join(files)}|Category|분류):", x) else x.rsplit("|", 1)[-1])
    text = re.sub(r"'{2,5}|</?[a-z][^>]*>", "", re.sub(r"\[https?://\S+ ([^\]]*)\]", r"\1", text))
    out = []
    for line in text.split("\n"):
        if m := re.match(r"(={2,6})\s*(.*?)\s*=+\s*$", line):
            if m[2] in stop:
                break
            line = "#" * len(m[1]) + " " + m[2]
        out.append(re.sub(r"^[*#]+\s*", "- ", line) if not re.match(r"#{2,6} ", line) else line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def wiki_pages(spark: SparkSession, dump: str, namespaces: tuple[int, ...] = (0,)) -> DataFrame:
    """(source, text) of the pages of an XML dump, without redirects; compressed dumps are read as they are."""
    ddl = "title string, ns int, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(ddl).load(dump)
    pages = pages.filter(F.col("ns").isin(*namespaces) & F.col("redirect").isNull())

    @F.pandas_udf("string")
    def normalized(t: pd.Series) -> pd.Series:
        return t.map(lambda x: normalize_wikitext(x or ""))

    return pages.select(F.col("title").alias("source"), normalized(F.col("revision.text._VALUE")).alias("text"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(lexeme, grades) of a table of lexeme and grade, separated by tabs; digits that tell homonyms apart are dropped."""
    rows = spark.read.option("sep", "\t").schema("lexeme string, grade string").csv(path)
    return rows.select(F.regexp_replace("lexeme", "[0-9]+$", "").alias("lexeme"), "grade").groupBy("lexeme").agg(F.array_sort(F.collect_set("grade")).alias("grades"))


def graded_terms(topics: DataFrame, words: DataFrame, grade: str) -> DataFrame:
    """First places of the topics (doc_id, pos, topic) whose only grade is the given one."""
    hard = words.filter((F.size("grades") == 1) & F.array_contains("grades", grade)).select(F.col("lexeme").alias("topic"))
    return topics.join(hard, "topic", "left_semi").groupBy("doc_id", "topic").agg(F.min("pos").alias("pos"))


def source_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> DataFrame:
    """(source, text) of source files below a folder; hidden folders and node_modules are passed over."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").text(folder, wholetext=True)
    out = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return out.filter(~F.col("source").rlike(r"/(\.[^/]+|node_modules)/"))
