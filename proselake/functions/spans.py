"""Spans inside one text: plain text, inline code, quotes, promises, the part that an edit changes.

Each function works on Python strings, as offsets are code points; `spans_udf` and `plain_text` put them on columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inline marks of Markdown.
INLINE_CODE = r"`([^`\n]*)`"
LINK = r"\[([^\]]*)\]\([^)]*\)"
EMPHASIS = r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"
SINGLE_EMPHASIS = r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])"
#: Pairs of quotation marks and the longest quotation.
QUOTES = ['""', "''", "“”", "‘’", "「」", "『』"]
LONGEST_QUOTE = 80
#: Units of counted promises, numerals that count them.
COUNT_UNITS = ["가지", "방식", "방법", "단계"]
NUMBERS = {"한": 1, "두": 2, "세": 3, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10, "스물": 20, "서른": 30, "마흔": 40, "쉰": 50, "예순": 60, "일흔": 70, "여든": 80, "아흔": 90, "백": 100, "천": 1000}

Span = tuple[int, int]


def plain_text(text: Column) -> Column:
    """Without marks of inline code, links and emphasis; runs of blanks are one, line breaks stay."""
    for pattern, into in ((INLINE_CODE, "$1"), (LINK, "$1"), (EMPHASIS, "$2"), (SINGLE_EMPHASIS, "$1"), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, into)
    return F.trim(text)


def plain(text: str) -> str:
    """The same for one string."""
    for pattern, into in ((INLINE_CODE, r"\1"), (LINK, r"\1"), (EMPHASIS, r"\2"), (SINGLE_EMPHASIS, r"\1"), (r"[ \t]+", " ")):
        text = re.sub(pattern, into, text)
    return text.strip(" ")


def code_spans(raw: str, flat: str) -> list[Span]:
    """Where the contents of inline code stand in the plain text, from left to right."""
    out, at = [], 0
    for m in re.finditer(INLINE_CODE, raw):
        body = re.sub(r"[ \t]+", " ", m[1]).strip()
        found = flat.find(body, at) if body else -1
        if found >= 0:
            at = found + len(body)
            out.append((found, at))
    return out


def quote_spans(text: str) -> list[Span]:
    """Insides of quotations, in order."""
    out = []
    for left, right in QUOTES:
        out += [m.span(1) for m in re.finditer(f"{re.escape(left)}([^{left}{right}\n]{{1,{LONGEST_QUOTE}}}){re.escape(right)}", text)]
    return sorted(out)


def inside_any(span: Span, spans: list[Span]) -> bool:
    return any(a <= span[0] and span[1] <= b for a, b in spans)


def overlaps_any(span: Span, spans: list[Span]) -> bool:
    return any(span[0] < b and a < span[1] for a, b in spans)


def occurrences(text: str, part: str) -> list[Span]:
    """All places of a literal, overlapping ones too."""
    out, at = [], text.find(part) if part else -1
    while at >= 0:
        out.append((at, at + len(part)))
        at = text.find(part, at + 1)
    return out


def spans_within(spans: list[Span], start: int, end: int) -> list[Span]:
    """The parts of spans that lie in [start, end), counted from start."""
    return [(max(a, start) - start, min(b, end) - start) for a, b in spans if a < end and start < b]


def matched_spans(text: str, patterns: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, text) of every match, pattern by pattern."""
    return [(*m.span(), m[0]) for p in patterns for m in re.finditer(p, text)]


def changed_span(before: str, after: str) -> tuple[str, str]:
    """What is left of both texts without their common start and end."""
    top = min(len(before), len(after))
    head = next((i for i in range(top) if before[i] != after[i]), top)
    tail = next((i for i in range(top - head) if before[len(before) - 1 - i] != after[len(after) - 1 - i]), top - head)
    return before[head : len(before) - tail], after[head : len(after) - tail]


def promised_counts(text: str) -> list[tuple[int, str, str]]:
    """(number, unit, text) of counted promises. Digits right before the unit 단계 name a step and promise nothing."""
    words = "|".join(sorted(NUMBERS, key=len, reverse=True))
    found = re.finditer(rf"(?<![가-힣0-9])([0-9]+|{words})(\s?)({'|'.join(COUNT_UNITS)})", text)
    return [(int(m[1]) if m[1].isdigit() else NUMBERS[m[1]], m[3], m[0]) for m in found if not (m[1].isdigit() and not m[2] and m[3] == "단계")]


def tab_width(line: str, stop: int = 4) -> int:
    """Columns of the indentation; a tab goes to the next stop."""
    n = 0
    for c in line:
        if c not in " \t":
            break
        n += stop - n % stop if c == "\t" else 1
    return n


def spans_udf(kind: str) -> object:
    """A vectorised function of a string column: the spans of a kind (quotes or code) as array<struct<first, end>>."""
    find = {"quotes": quote_spans, "code": lambda t: code_spans(t, plain(t))}[kind]

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"first": a, "end": b} for a, b in find(t or "")])

    return f


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("text", T.StringType())])))
def promises_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"number": n, "unit": u, "text": x} for n, u, x in promised_counts(t or "")])


def canonical_number(value: Column) -> Column:
    """A numeral without commas, leading zeros and trailing zeros of its fraction."""
    n = F.replace(value, F.lit(","), F.lit(""))
    n = F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n)
    return F.regexp_replace(n, r"^0+(?=[0-9])", "")
