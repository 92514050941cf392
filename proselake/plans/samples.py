"""Queries over small Markdown and Korean texts, as the driver's tables hold neither. What they must give is stated row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import spans, tokens
from proselake.operators import document_rules, edits, findings, lexicon, profiles, usage
from proselake.operators.lexicon import Entry
from proselake.operators.structure import RULES, blocks_with_language, prose_sentences
from proselake.operators.structure import findings as rule_findings
from proselake.sources import literals, markdown

#: rule -> (text that it catches, lines, text that it spares)
CODE = "```py\na = 1\nb = 2\nc = 3\nd = 4\n```"
CASES = {
    "headingSkip": ("# a\n\n### b\n", [3], "# a\n\n## b\n"),
    "loneSubheading": ("## a\n\n### b\n\nx\n\n## c\n\n### d\n\n### e\n", [3], "## a\n\n### b\n\n### c\n"),
    "headingSentence": ("## 이것은 끝났다\n", [1], "## 왜 그럴까\n"),
    "headingUniform": ("## 만들기\n\n## 지우기\n\n## 고치기\n", [1], "## 만들기\n\n## 지우는 법\n\n## 고친 곳\n"),
    "sectionNoProse": ("## a\n\n```py\nx\n```\n", [1], "## a\n\ntext\n"),
    "introImage": ("![a](b)\n\n![c](d)\n\n## s\n\nx\n", [1], "![a](b)\n\n## s\n\nx\n"),
    "introLong": ("a\n\nb\n\nc\n\nd\n\nEnd. More.\n\n## s\n\n1\n\n2\n\n3\n\n## t\n\n4\n\n5\n", [9], "a\n\nb\n\nc\n\nd\n\n## s\n\n1\n\n2\n\n## t\n\n3\n\n4\n"),
    "blockUnread": ("```py\nx\n```\n\n```text\n42\n```\n", [5], "```py\nx\n```\n\n```text\n42\n```\n\nread\n"),
    "emojiBullet": ("- plain\n- 🚀 go\n- 🚀 on\n", [2], "- plain 🚀\n"),
    "dash": ("a\nb – c\n\n```\nx — y\n```\n", [2, 5], "a-b\n"),
    "firstResultDistance": ("a\n\nb\n\nc\n\nd\n\ne\n\n```py\nx\n```\n", [9], "a\n\nb\n\nc\n\nd\n\n```py\nx\n```\n"),
    "duplicateBlock": (f"{CODE}\n\ntext\n\n{CODE}\n", [10], f"{CODE}\n\n```py\na = 1\nq\nr\ns\n```\n"),
    "connectorRepeat": ("하지만 비가 왔다. 하지만 갔다.\n", [1], "하지만 비가 왔다.\n\n하지만 갔다.\n"),
    "fillerOpener": ("첫 줄이다.\n마지막으로 정리한다.\n", [2], "이것이 마지막으로 남는다.\n"),
    "imperativePeriod": ("여기를 누르세요.\n", [1], "여기를 누르세요\n"),
    "doubleNegative": ("가지 않을 수 없다.\n", [1], "가지 않는다.\n"),
    "enoughOnce": ("여기까지 하면 충분하다. 이 정도면 충분하다.\n", [1], "여기까지 하면 충분하다.\n"),
    "promiseRecall": ("이 값은 뒤에서 다루겠다.\n", [1], "이 값은 뒤에서 다루겠다. 앞에서 말한 값이다.\n"),
    "longSentence": ("가 " * 30 + "간다.\n", [1], "가 " * 29 + "간다.\n"),
    "euiChain": ("회사의 팀의 일이다.\n", [1], "정의 리소스의 값이다.\n"),
    "negationRedefine": ("이 일은 단순한 연습이 아닙니다. 실전입니다.\n", [1], "단순한 도구가 아닙니다. 그래서 어렵습니다.\n"),
    "endingRepeat": ("비가 옵니다. 눈이 옵니다. 해가 뜹니다. 달이 뜹니다.\n", [1], "비가 옵니다. 그래서 눈이 옵니다. 해가 뜹니다. 달이 뜹니다.\n"),
    "factListParagraph": ("비가 온다. 눈이 온다. 해가 뜬다.\n", [1], "비가 온다. 그래서 눈이 온다. 해가 뜬다.\n"),
    "bridgeRepeat": ("## 가\n\n이번에는 간다.\n\n## 나\n\n이제 온다.\n\n## 다\n\n이어서 본다.\n", [3], "## 가\n\n이번에는 간다.\n\n## 나\n\n이제 온다.\n"),
    "paraFragment": ("가다.\n\n나다.\n\n다다.\n", [1], "가다.\n\n나다.\n\n```py\nx\n```\n\n다다.\n"),
    "noQuestion": ("## 가\n\n간다.\n\n## 나\n\n온다.\n", [3], "## 왜?\n\n간다.\n\n## 나\n\n온다.\n"),
    "moreLater": ("## 가\n\n- 짧다\n- " + "가" * 80 + "\n  " + "나" * 80 + "\n", [4], "- " + "가" * 200 + "\n\n## 나\n\n- [짧다](" + "x" * 200 + ")\n"),
    "tableOddCell": ("| a | b |\n|---|---|\n| x | 1초 |\n| y | 2초 |\n| z | 3초 |\n| w | 없음 |\n", [6], "| a | b |\n|---|---|\n| x | 1초 |\n| y | 2초 |\n| z | 없음 |\n| w | 없음 |\n"),
    "numberOrphan": ("값이 453MB에서 700MB로 올랐다.\n", [1], "값은 453MB다.\n\n값이 453MB에서 700MB로 올랐다.\n"),
    "danglingDeixis": ("서버가 느리다. 이것은 어렵다.\n", [1], "서버가 느린가? 이것은 어렵다.\n"),
    "deixis": ("서버가 느리다. 이러한 서버가 많다.\n", [1], "서버가 느리다. 서버가 많다.\n"),
    "nounPile": ("서버 로그 수집 오류 분석 파일을 본다.\n", [1], "서버 로그를 수집 오류로 본다.\n"),
    "doublePassive": ("글이 잘 보여진다.\n", [1], "글이 잘 보인다.\n"),
    "phraseRepeat": ("좋은 것이다. 나쁜 것이다. " + "비가 온다. " * 6 + "\n", [1], "좋은 것이다. " + "비가 온다. " * 7 + "\n"),
    "countMismatch": ("세 가지를 본다.\n\n## 가\n\n끝.\n\n## 나\n\n네 가지를 보았다.\n", [9], "세 가지를 본다.\n\n## 가\n\n네 가지.\n\n## 나\n\n3 가지를 보았다.\n"),
    "keywordMissing": ("---\ntitle: 글\nkeyword: 서버\n---\n처음.\n", [5], "---\ntitle: 서버 글\nkeyword: 서버\n---\n처음.\n"),
    "keywordHeading": ("---\ntitle: 서버 글\nkeyword: 서버\n---\n처음.\n\n## 가\n\n## 나\n\n## 다\n", [5], "---\ntitle: 서버 글\nkeyword: 서버\n---\n처음.\n\n## 가\n\n## 서버\n\n## 다\n"),
    "fieldEcho": ("---\nquestion: 서버 속도\n---\n바다가 푸르다.\n", [1], "---\nquestion: 서버 속도\n---\n서버가 느리다.\n"),
    "inputFileSource": ("```py\ndf = read_csv('a.csv')\n```\n", [2], "`a.csv` 파일을 받는다.\n\n```py\ndf = read_csv('a.csv')\n```\n"),
    "installImport": ("```sh\npip install requests\n```\n\n```py\nimport os\nimport numpy as np\nimport requests\n```\n", [7], "```py\nimport numpy\n```\n"),
    "platformApi": ("```py\nimport winreg\n```\n", [2], "```text\nimport winreg\n```\n"),
}

ENTRIES = [
    Entry("spelling", "됬", fix="됐", why="short form"),
    Entry("easyWords", "리소스", fix="자원", keep="리소스 팩"),
    Entry("easyWords", "자원", fix="재원", unless="자원봉사"),
    Entry("cliches", "시간이 금이다", to=(("시간이 금이다", "시간은 귀하다"),)),
]
LINT = "## 가\n\n이어서 간다. 리소스다.\n\n<!-- lint-disable fillerOpener -->\n\n이어서 온다.\n\n<!-- lint-enable -->\n\n이어서 본다 – 끝.\n\n<!-- lint-disable-next -->\n\n이어서 쓴다.\n"
PAGE = "# t\n\n- one\n- two\n\n| a | b |\n|---|---|\n| c | d |\n\n![pic](x)\n\n## s\n\nprose here. More of it.\n\n```py\ndf = read_csv('a.csv')\ndf.to_csv('b.csv')\n```\n"
DRAFT = "## 가\n\nSee `x` and 1,200 items. Bad line.\n\n## 나\n\nOnly 7 here."
LATER = "## 가\n\nSee `y` and 1200 items. Good line.\n\n## 다\n\nOnly 7 here."
KOREAN = ["서버에서 데이터를 읽고 Spark는 빠르다.", "서버 로그 수집 3 오류 파일을 직접 봅니다.", "왜 그럴까요? abc", ""]
USAGE = [(1, "서버가 느립니다. 데이터를 읽습니다."), (2, "서버가  느립니다. 데이터 12개를 읽습니다."), (3, "데이터 7개를 읽습니다."), (4, None)]
CODE_TEXT = "// 주석 '아니다'\nconst a = '저장했습니다';\nconsole.log('개발용 글');\nreturn <p>이름 <b>{x}</b></p>;\nconst t = `값 ${f('안')} 끝`;\n"


def texts(spark: SparkSession, *rows: str | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")


def blocks(spark: SparkSession, *rows: str) -> DataFrame:
    return blocks_with_language(texts(spark, *rows))


def sentences(spark: SparkSession, *rows: str) -> DataFrame:
    return prose_sentences(blocks(spark, *rows))


def found(spark: SparkSession) -> DataFrame:
    rows = [(1, "dash", "error", 2, "a  b"), (1, "dash", "error", 2, "c"), (1, "deixis", "notice", 2, "x"), (2, "dash", "notice", 1, "q")]
    return spark.createDataFrame(rows, "doc_id long, rule string, severity string, line int, quote string").withColumn("scope", F.lit("sentence")).withColumn("mechanism", F.when(F.col("rule") == "deixis", "reader").otherwise("dictionary"))


def joined(array: str) -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ";")


def _drafts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, DRAFT, LATER)], "doc_id long, before string, after string")


def _outlines(spark: SparkSession) -> DataFrame:
    ddl = "doc_id long, line int, level int, title string"
    return edits.outline_diff(spark.createDataFrame([(1, 1, 2, "a"), (1, 5, 2, "b")], ddl), spark.createDataFrame([(1, 1, 2, "a"), (1, 4, 2, "c"), (1, 9, 2, "d")], ddl))


def _search(spark: SparkSession) -> DataFrame:
    s = usage.index_sentences(spark.createDataFrame(USAGE, "doc_id long, text string"))
    p = usage.index_postings(s)
    meta = s.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = usage.scores(p.filter("term = '서버'"), p.groupBy("term").agg(F.count(F.lit(1)).alias("df")), meta)
    return hits.join(s, "id").select(F.col("id.doc_id").alias("doc_id"), "sentence", "documents", "score")


def _reviews(spark: SparkSession) -> DataFrame:
    docs = texts(spark, "first line here\nsecond part\nof the text\n\nlast")
    asked = spark.createDataFrame([(1, "second  part", "a"), (1, "part of the text", "a"), (1, "nowhere to see", "b")], "doc_id long, quote string, kind string")
    hits = spark.createDataFrame([(1, 3, "error")], "doc_id long, line int, severity string")
    return findings.review_coverage(docs, asked, hits)


_K = lambda spark: texts(spark, *KOREAN)
#: name -> (query, columns with types, rows)
GOLDEN: dict[str, tuple[Callable[[SparkSession], DataFrame], dict[str, str], list[tuple]]] = {
    "sample_plain_text": (lambda s: texts(s, "**bold** `a  b` [link](http://x)  *now*", "x_y_z 2*3*4").select("doc_id", spans.plain_text(F.col("text")).alias("plain")), {"doc_id": "long", "plain": "string"}, [(1, "bold a b link now"), (2, "x_y_z 2*3*4")]),
    "sample_quote_spans": (lambda s: texts(s, 'he “said” "x y" so', "none").select("doc_id", F.explode(spans.spans_udf("quotes")("text")).alias("x")).select("doc_id", "x.first", F.col("x.end").alias("after")), {"doc_id": "long", "first": "long", "after": "long"}, [(1, 4, 8), (1, 11, 14)]),
    "sample_code_spans": (lambda s: texts(s, "use `a  b` and `c`").select("doc_id", F.explode(spans.spans_udf("code")("text")).alias("x")).select("doc_id", "x.first", F.col("x.end").alias("after")), {"doc_id": "long", "first": "long", "after": "long"}, [(1, 4, 7), (1, 12, 13)]),
    "sample_promises": (lambda s: texts(s, "세 가지가 있고 2 단계와 3단계").select(F.explode(spans.promises_udf("text")).alias("x")).select("x.number", "x.unit"), {"number": "long", "unit": "string"}, [(3, "가지"), (2, "단계")]),
    "sample_canonical_numbers": (lambda s: texts(s, "01,230.500", "7", "0.50").select("doc_id", spans.canonical_number(F.col("text")).alias("number")), {"doc_id": "long", "number": "string"}, [(1, "1230.5"), (2, "7"), (3, "0.5")]),
    "sample_words": (lambda s: texts(s, "서울에서, (책을) 3개").select(F.explode(tokens.words(F.col("text"))).alias("w")).select("w.core", F.col("w.ends_clause").cast("int").alias("ends"), F.col("w.opens").cast("int").alias("opens"), F.col("w.particle").cast("int").alias("particle")), {"core": "string", "ends": "long", "opens": "long", "particle": "long"}, [("서울에서", 1, 0, 1), ("책을", 1, 1, 1), ("3개", 0, 0, 0)]),
    "sample_topics": (lambda s: _K(s).withColumn("t", tokens.topics(F.col("text"))).select("doc_id", joined("t").alias("topics")), {"doc_id": "long", "topics": "string"}, [(1, "spark;데이터;서버"), (2, "로그;서버;수집;오류;직접;파일"), (3, "abc"), (4, "")]),
    "sample_noun_runs": (lambda s: _K(s).select("doc_id", tokens.longest_noun_run(F.col("text"), ["직접"]).alias("run")), {"doc_id": "long", "run": "long"}, [(1, 1), (2, 4), (3, 1), (4, 0)]),
    "sample_registers": (lambda s: _K(s).select("doc_id", F.coalesce(tokens.register_of(F.col("text")), F.lit("-")).alias("register")), {"doc_id": "long", "register": "string"}, [(1, "한다"), (2, "합니다"), (3, "해요"), (4, "-")]),
    "sample_document_register": (lambda s: tokens.document_register(s.createDataFrame([(1, "온다."), (1, "갑니다."), (1, "간다."), (2, "가요"), (3, "x")], "doc_id long, sentence string")).select("doc_id", "register"), {"doc_id": "long", "register": "string"}, [(1, "섞임"), (2, "해요"), (3, "없음")]),
    "sample_voices": (lambda s: texts(s, "보여지", "되어지", "나뉘어지", "쉽게 만들다", "만들어지", "보이").withColumn("v", document_rules.voice_of(F.col("text"))).filter("v IS NOT NULL").select("doc_id", "v.kind", "v.base", F.coalesce("v.reduced", F.lit("-")).alias("reduced")), {"doc_id": "long", "kind": "string", "base": "string", "reduced": "string"}, [(1, "피동", "보이", "보이"), (2, "피동", "되", "되"), (3, "피동", "나뉘", "나뉘"), (4, "사동", "쉽", "-")]),
    "sample_index_tokens": (lambda s: texts(s, "데이터를 Read-only").withColumn("t", tokens.index_tokens(F.col("text"))).select(joined("t").alias("tokens")), {"tokens": "string"}, [("데이터;데이;이터;read;only",)]),
    "sample_lexicon": (lambda s: lexicon.match_entries(texts(s, "잘 됬다 리소스를 쓴다", "리소스 팩", "자원봉사 자원").withColumnRenamed("text", "sentence"), ENTRIES).select("doc_id", "ord", "start_at", "end_at", "fix"), {"doc_id": "long", "ord": "long", "start_at": "long", "end_at": "long", "fix": "string"}, [(1, 0, 2, 3, "됐"), (1, 1, 5, 8, "자원")]),
    "sample_lexicon_first": (lambda s: lexicon.first_per_text(lexicon.match_entries(texts(s, "잘 됬다 리소스를 쓴다").withColumnRenamed("text", "sentence"), ENTRIES), ["doc_id"]).select("doc_id", "ord"), {"doc_id": "long", "ord": "long"}, [(1, 0)]),
    "sample_lexicon_override": (lambda s: lexicon.last_per_span(lexicon.match_entries(texts(s, "a big cat").withColumnRenamed("text", "sentence"), [Entry("x", "big"), Entry("x", "big cat"), Entry("x", "big", fix="large")]), ["doc_id"]).select("doc_id", "ord"), {"doc_id": "long", "ord": "long"}, [(1, 1), (1, 2)]),
    "sample_quoted_filtered_matches": (lambda s: lexicon.lexicon_findings(sentences(s, "첫 줄이다.\n둘째는\n리소스를 본다. `리소스`와 “리소스”는 남는다.\n\n시간이 금이다."), ENTRIES).select("rule", "line", "fragment", "fix"), {"rule": "string", "line": "long", "fragment": "string", "fix": "string"}, [("hardWord", 3, "리소스", "둘째는\n자원을 본다."), ("cliche", 5, "시간이 금이다", "시간은 귀하다.")]),
    "sample_lint": (lambda s: findings.lint(texts(s, LINT), entries=ENTRIES).filter("rule in ('fillerOpener', 'hardWord', 'dash')").select("rule", "line", "scope", "mechanism"), {"rule": "string", "line": "long", "scope": "string", "mechanism": "string"}, [("fillerOpener", 3, "sentence", "dictionary"), ("hardWord", 3, "sentence", "dictionary"), ("dash", 11, "sentence", "dictionary"), ("fillerOpener", 11, "sentence", "dictionary")]),
    "sample_configured": (lambda s: findings.lint(texts(s, LINT), findings.Config(disable=frozenset({"dash"}), preset="p", presets={"p": frozenset({"hardWord"})}, severity="error"), ENTRIES).filter("rule in ('fillerOpener', 'hardWord', 'dash')").select("rule", "line"), {"rule": "string", "line": "long"}, [("fillerOpener", 3), ("fillerOpener", 11)]),
    "sample_disabled_ranges": (lambda s: markdown.disabled_ranges(blocks(s, LINT)).select("rule", "first", "last"), {"rule": "string", "first": "long", "last": "long"}, [("fillerOpener", 5, 9), ("*", 15, 15)]),
    "sample_front_matter": (lambda s: markdown.parse_front_matter(texts(s, "---\ntitle: x\nkeyword: y z\n---\nbody", "no")).select("key", "value", "body_line"), {"key": "string", "value": "string", "body_line": "long"}, [("title", "x", 4 + 1), ("keyword", "y z", 5)]),
    "sample_dropped_fences": (lambda s: markdown.drop_fences(blocks(s, PAGE), ["py"]).filter("kind = 'code'").agg(F.count(F.lit(1)).alias("fences")), {"fences": "long"}, [(0,)]),
    "sample_baseline": (lambda s: findings.prune(findings.baseline_of(found(s)), found(s).filter("doc_id = 1 and quote <> 'c'"), texts(s, "a")).select("doc_id", "rule", "quote"), {"doc_id": "long", "rule": "string", "quote": "string"}, [(1, "dash", "a b"), (1, "deixis", "x"), (2, "dash", "q")]),
    "sample_summary": (lambda s: findings.summary(found(s)).select("doc_id", "errors", "notices", "commonest"), {"doc_id": "long", "errors": "long", "notices": "long", "commonest": "string"}, [(1, 2, 1, "dash"), (2, 0, 1, "dash")]),
    "sample_worst": (lambda s: findings.worst(found(s)).select("doc_id", "rule", "quote"), {"doc_id": "long", "rule": "string", "quote": "string"}, [(1, "dash", "a  b"), (2, "dash", "q")]),
    "sample_annotations": (lambda s: findings.as_annotations(found(s).filter("doc_id = 2"), F.lit("a.md")).select("annotation"), {"annotation": "string"}, [("::notice file=a.md,line=1::dash: q",)]),
    "sample_reports": (lambda s: findings.as_text(found(s)).select("doc_id", "report"), {"doc_id": "long", "report": "string"}, [(1, "2: error [dash] a  b\n2: error [dash] c\n2: notice [deixis] x"), (2, "1: notice [dash] q")]),
    "sample_review_coverage": (lambda s: _reviews(s).select("quote", F.coalesce("line", F.lit(0)).alias("line"), F.col("covered").cast("int").alias("covered")), {"quote": "string", "line": "long", "covered": "long"}, [("second  part", 2, 1), ("part of the text", 2, 1), ("nowhere to see", 0, 0)]),
    "sample_fragments": (lambda s: profiles.fragments(blocks(s, PAGE)).select("line", "text"), {"line": "long", "text": "string"}, [(1, "t"), (3, "one"), (4, "two"), (6, "a"), (6, "b"), (8, "c"), (8, "d"), (10, "pic"), (12, "s")]),
    "sample_section_shapes": (lambda s: profiles.section_shapes(blocks(s, PAGE)).select("section_index", "line", "prose", "code", F.col("list").alias("lists"), F.col("table").alias("tables"), F.col("image").alias("images")), {"section_index": "long", "line": "long", "prose": "long", "code": "long", "lists": "long", "tables": "long", "images": "long"}, [(0, 1, 0, 0, 1, 1, 1), (1, 12, 1, 1, 0, 0, 0)]),
    "sample_document_summary": (lambda s: profiles.document_summary(blocks(s, PAGE)).select("sections", "headings", "paragraphs", "code", "images", "tables"), {"sections": "long", "headings": "long", "paragraphs": "long", "code": "long", "images": "long", "tables": "long"}, [(1, 2, 1, 1, 1, 1)]),
    "sample_code_files": (lambda s: document_rules.code_files(blocks(s, PAGE)).select("line", "kind", "name"), {"line": "long", "kind": "string", "name": "string"}, [(17, "read", "a.csv"), (18, "write", "b.csv")]),
    "sample_section_at": (lambda s: document_rules.section_at(s.createDataFrame([(1, 1), (1, 11), (1, 13)], "doc_id long, line int"), blocks(s, PAGE)).select("line", "section_index", "block_index"), {"line": "long", "section_index": "long", "block_index": "long"}, [(1, 0, 0), (11, 0, 3), (13, 1, 4)]),
    "sample_prints": (lambda s: profiles.prints(texts(s, "비가 옵니다. 그래서 집에 갑니다. 왜 그럴까요?")).select("sentences", "words", "questions", F.col("registers.합니다").alias("formal")), {"sentences": "long", "words": "long", "questions": "long", "formal": "long"}, [(3, 7, 1, 2)]),
    "sample_surface": (lambda s: _drafts(s).select(F.explode(edits.surface_diff(F.col("before"), F.col("after"))).alias("x")).select("x.kind", F.array_join("x.lost", ";").alias("lost"), F.array_join("x.gained", ";").alias("gained")), {"kind": "string", "lost": "string", "gained": "string"}, [("code", "x", "y")]),
    "sample_contract": (lambda s: _drafts(s).select(F.explode(edits.violations("before", "after")).alias("v")).select("v.kind", "v.was", "v.now"), {"kind": "string", "was": "string", "now": "string"}, [("lost", "code:x", ""), ("added", "", "code:y"), ("heading", "나", "다"), ("fact", "See `x` and 1,200 items. Bad line.", "")]),
    "sample_outline": (lambda s: _outlines(s).select("place", "status"), {"place": "long", "status": "string"}, [(1, "same"), (2, "changed"), (3, "added")]),
    "sample_changed_sentences": (lambda s: edits.changed_pairs(s.createDataFrame([(1, "One. Bad here. Three.", "One. Good here. Three.")], "doc_id long, before string, after string")).select("was", F.array_join("now", " ").alias("now")), {"was": "string", "now": "string"}, [("Bad here.", "Good here.")]),
    "sample_fixes": (lambda s: edits.fix_documents(texts(s, "a bad day", "bad bad"), s.createDataFrame([(1, 1, "bad", "good"), (2, 1, "bad", "good")], "doc_id long, line int, fragment string, replacement string")).select("doc_id", "text", "applied", "skipped"), {"doc_id": "long", "text": "string", "applied": "long", "skipped": "long"}, [(1, "a good day", 1, 0), (2, "bad bad", 0, 1)]),
    "sample_literals": (lambda s: literals.literal_rows(texts(s, CODE_TEXT)).select("line", "plain"), {"line": "long", "plain": "string"}, [(2, "저장했습니다"), (4, "이름"), (5, "값 끝")]),
    "sample_sheet": (lambda s: literals.sheet(s.createDataFrame([(1, "a:1", "dash", "x|y", None)], "doc_id long, place string, rules string, text string, fix string")).select("row"), {"row": "string"}, [("| a:1 | dash | x\\|y |  |",)]),
    "sample_usage_sentences": (lambda s: usage.index_sentences(s.createDataFrame(USAGE, "doc_id long, text string")).select("sentence", "documents", F.col("id.doc_id").alias("doc_id")), {"sentence": "string", "documents": "long", "doc_id": "long"}, [("서버가 느립니다.", 2, 1), ("데이터를 읽습니다.", 1, 1), ("데이터 12개를 읽습니다.", 2, 2)]),
    "sample_usage_search": (lambda s: _search(s).select("doc_id", "sentence", "documents"), {"doc_id": "long", "sentence": "string", "documents": "long"}, [(1, "서버가 느립니다.", 2)]),
    "sample_neighbours": (lambda s: usage.neighbours(s.createDataFrame(USAGE, "doc_id long, text string"), "서버").select("side", "word", "documents"), {"side": "string", "word": "string", "documents": "long"}, [("after", "느립니다", 2)]),
    "sample_attested": (lambda s: usage.attested(s.createDataFrame([("서버가 느립니다",), ("x y",)], "chain string"), usage.chain_documents(s.createDataFrame(USAGE, "doc_id long, text string"), 3, 2), 2).select("chain", "documents", F.col("attested").cast("int").alias("attested")), {"chain": "string", "documents": "long", "attested": "long"}, [("서버가 느립니다", 2, 1), ("x y", 0, 0)]),
}


def _rule_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        caught, _, spared = CASES[name]
        return rule_findings(texts(spark, caught, spared), [name]).select("doc_id", "rule", F.col("line").cast("long").alias("line"))

    return query


def _golden_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        build, columns, _ = GOLDEN[name]
        return build(spark).select(*[F.col(c).cast(kind).alias(c) for c, kind in columns.items()])

    return query


def _literal(value: object, kind: str) -> str:
    return f"CAST({value} AS BIGINT)" if kind == "long" else "'" + str(value).replace("'", "''") + "'"


def _values(columns: dict[str, str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, columns.values(), strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(f'"{c}"' for c in columns)})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"rule_{name}": _rule_query(name) for name in sorted(RULES)} | {name: _golden_query(name) for name in GOLDEN}


def oracle_sql() -> dict[str, str]:
    rules = {f"rule_{name}": _values({"doc_id": "long", "rule": "string", "line": "long"}, [(1, name, line) for line in CASES[name][1]]) for name in sorted(RULES)}
    return rules | {name: _values(columns, rows) for name, (_, columns, rows) in GOLDEN.items()}
