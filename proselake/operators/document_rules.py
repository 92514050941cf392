"""Rules that compare parts of a document: deixis, counted promises, keywords, files and packages of code, noun piles, repeated phrases."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import markers, tokens
from proselake.functions.hangul import join_syllable, split_syllable
from proselake.functions.spans import promises_udf
from proselake.functions.text import sentence_array
from proselake.operators.structure import rule

#: Words that point at something said before.
DEIXIS = [
    r"(?<![가-힣])이것(?:은|이|을|으로|도|만)?(?![가-힣])",
    "(?<![가-힣])해당 [가-힣]+",
    r"(?:(?<![가-힣A-Za-z0-9])(?<![가-힣A-Za-z0-9]\s)|(?<=[은는을를도만에]\s))위의 [가-힣]+",
    r"(?:(?<![가-힣A-Za-z0-9])(?<![가-힣A-Za-z0-9]\s)|(?<=[은는을를도만에]\s))아래의 [가-힣]+",
    "(?<![가-힣])이러한 [가-힣]+",
    "(?<![가-힣])이처럼",
]
#: Files that hold data, by their suffix; calls that read or write a file named in them.
DATA_FILE = r"^[^*?{}<>$:\s]+\.(?:csv|tsv|json|jsonl|parquet|xlsx?|txt|db|sqlite|png|jpe?g|npy|pkl|xml|yaml|yml)$"
READS = [r"(?:read_[a-z]+|open|load|loadtxt|imread|load_workbook|Path)\(\s*['\"]([^'\"]+)['\"](?!\s*,\s*['\"][wax])", r"(?:^|[|;&]\s*)(?:cat|head|tail|wc|jq)\s+(?:-\S+\s+)*([^\s|;&<>-][^\s|;&<>]*)"]
WRITES = [r"(?:to_[a-z]+|save|savefig|savetxt|dump|write_[a-z]+)\(\s*['\"]([^'\"]+)['\"]", r"open\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"][wax]", r">\s*([^\s|;&<>]+)", r"(?:-o|-O|--output)[ =](\S+)", r"(?:touch|mkdir(?:\s+-p)?)\s+([^\s|;&]+)"]
INSTALL = r"(?:pip3?|uv(?: pip)?|poetry|conda)\s+(?:install|add)\s+([^\n#;|&]+)"
IMPORT = r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_]*)"
#: Packages that are imported under another name; any of a parameter's pairs may be added.
IMPORTED_AS = {"PIL": "pillow", "bs4": "beautifulsoup4", "cv2": "opencv-python", "sklearn": "scikit-learn", "yaml": "pyyaml", "dateutil": "python-dateutil", "docx": "python-docx", "dotenv": "python-dotenv"}


def _pointing(s: DataFrame) -> DataFrame:
    """Sentences that point back without a topic before the pointer, with the sentence before in the document."""
    any_ = "|".join(f"(?:{p})" for p in DEIXIS)
    w = Window.partitionBy("doc_id").orderBy("pos")
    q = s.withColumn("topics", tokens.topics(F.col("quote"))).withColumn("was", F.lag("topics").over(w)).withColumn("said", F.lag("quote").over(w))
    before = F.regexp_extract("quote", f"^(.*?)(?:{any_})", 1)
    return q.filter(F.col("quote").rlike(any_) & (F.size(tokens.topics(before)) == 0)).withColumn("shared", F.size(F.array_intersect("topics", "was")))


@rule("danglingDeixis", "error", "sentences")
def dangling_deixis(s: DataFrame) -> DataFrame:
    """Something is pointed at that the sentence before does not name; questions and exclamations may be pointed at."""
    prompt = F.col("said").rlike(r"[?!]\s*$") | (markers.ending_of(F.col("said")) == markers.QUESTION)
    return _pointing(s).filter((F.coalesce("shared", F.lit(0)) <= 0) & ~F.coalesce(prompt, F.lit(False)))


@rule("deixis", "error", "sentences")
def deixis(s: DataFrame) -> DataFrame:
    """Something is pointed at although the sentence before names it, so its name could stand here."""
    return _pointing(s).filter("shared > 0")


@rule("nounPile", "notice", "sentences")
def noun_pile(s: DataFrame, least: int = 5, non_nouns: tuple[str, ...] = ()) -> DataFrame:
    return s.filter(tokens.longest_noun_run(F.col("quote"), list(non_nouns)) >= least)


def passive_pattern(stems: list[str]) -> str:
    """What a passive stem with a second passive looks like: the stem, contracted where its last vowel allows, before a form of 지다."""
    i, yeo = split_syllable("이")[1], split_syllable("여")[1]
    forms = []
    for stem in stems:
        initial, vowel, final = split_syllable(stem[-1])
        forms.append(stem + "어")
        if vowel == i and not final:
            forms.append(stem[:-1] + join_syllable(initial, yeo))
    ji = split_syllable("지")
    tails = [join_syllable(ji[0], ji[1], f) for f in range(28)] + [join_syllable(ji[0], split_syllable("져")[1], f) for f in (0, 20)]
    return f"(?:{'|'.join(sorted(forms, key=len, reverse=True))})[{''.join(tails)}]"


#: Stems that are passive already; a longer list is a parameter.
PASSIVE_STEMS = ["보이", "쓰이", "놓이", "쌓이", "잊히", "읽히", "닫히", "잡히", "열리", "풀리", "불리", "들리", "나뉘", "담기", "안기", "되"]


def voice_of(surface: Column, stems: tuple[str, ...] = tuple(PASSIVE_STEMS)) -> Column:
    """struct(kind, base, reduced) of a stacked passive (보여지) or an analytic causative (쉽게 만들다); null for other forms.

    A passive is reduced to its first stem; what a causative should become depends on its sense, so `reduced` is null there."""
    i, yeo, ji = split_syllable("이")[1], split_syllable("여")[1], "지"
    links = {}
    for stem in stems:
        initial, vowel, final = split_syllable(stem[-1])
        links[(stem[:-1] + join_syllable(initial, yeo) if vowel == i and not final else stem + "어") + ji] = stem
    base = F.try_element_at(F.create_map(*[F.lit(x) for pair in links.items() for x in pair]), surface)
    caused = F.nullif(F.regexp_extract(surface, r"^([가-힣]+)게\s+만들[가-힣]*$", 1), F.lit(""))
    out = lambda kind, base, reduced: F.struct(F.lit(kind).alias("kind"), base.alias("base"), reduced.cast("string").alias("reduced"))
    return F.when(base.isNotNull(), out("피동", base, base)).when(caused.isNotNull(), out("사동", caused, F.lit(None)))


@rule("doublePassive", "error", "sentences")
def double_passive(s: DataFrame, stems: tuple[str, ...] = tuple(PASSIVE_STEMS)) -> DataFrame:
    return s.filter(F.col("quote").rlike(passive_pattern(list(stems))))


@rule("phraseRepeat", "notice", "sentences")
def phrase_repeat(s: DataFrame, patterns: tuple[tuple[str, float], ...] = ((r"것입니다[.!]?$|것이다[.!]?$", 0.08),), least: int = 8) -> DataFrame:
    """A pattern in more than its share of at least `least` sentences with an ending, twice or more; the first of them."""
    ended = markers.ending_of(F.col("quote")) != markers.NO_ENDING
    out = None
    for pattern, share in patterns:
        hit = F.col("quote").rlike(pattern)
        d = s.filter(ended).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("k"), F.min(F.when(hit, F.struct("pos", "line", "quote"))).alias("f"))
        d = d.filter((F.col("n") >= least) & (F.col("k") >= 2) & (F.col("k") > share * F.col("n"))).select("doc_id", "f.line", "f.quote")
        out = d if out is None else out.unionByName(d)
    return out


def outside(s: DataFrame, limits: DataFrame) -> DataFrame:
    """Sentences beyond a profile: limits has rows (feature: words, commas, hedges; p99), 0 disables. Returns doc_id, line, quote, feature."""
    q = F.col("quote")
    values = {"words": F.size(tokens.word_array(q)), "commas": F.regexp_count(q, F.lit(",")), "hedges": markers.count_of(q, markers.HEDGES)}
    v = s.select("doc_id", "line", "quote", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), x.alias("value")) for k, x in values.items()])).alias("m")).select("doc_id", "line", "quote", "m.*")
    return v.join(F.broadcast(limits.filter("p99 > 0")), "feature").filter("value > p99").select("doc_id", "line", "quote", "feature")


@rule("countMismatch", "error", "blocks")
def count_mismatch(blocks: DataFrame, short: int = 60) -> DataFrame:
    """The end counts something otherwise than the beginning promised: introduction and last section, or first and last paragraph of a short text without sections."""
    whole = Window.partitionBy("doc_id")
    b = blocks.filter("kind <> 'front'").withColumn("top", F.max("section_index").over(whole)).withColumn("lines", F.max("end_line").over(whole))
    p = b.filter("kind = 'prose'").withColumn("first_block", F.min("block_index").over(whole)).withColumn("last_block", F.max("block_index").over(whole))
    sections, flat = F.col("top") > 0, (F.col("top") == 0) & (F.col("lines") <= short)
    opening = (sections & (F.col("section_index") == 0)) | (flat & (F.col("block_index") == F.col("first_block")))
    closing = (sections & (F.col("section_index") == F.col("top"))) | (flat & (F.col("block_index") == F.col("last_block")))
    c = p.filter(opening | closing).select("doc_id", "block_index", "start_line", opening.alias("opening"), F.explode(sentence_array(F.col("text"))).alias("quote"))
    c = c.withColumn("c", F.explode(promises_udf("quote"))).select("doc_id", "start_line", "opening", "quote", "c.number", "c.unit")
    first = c.filter("opening").groupBy("doc_id", "unit").agg(F.min_by("number", "start_line").alias("promised"))
    odd = c.filter("not opening").join(first, ["doc_id", "unit"]).filter("number <> promised")
    return odd.groupBy("doc_id", "unit").agg(F.min(F.struct("start_line", "quote")).alias("f")).select("doc_id", F.col("f.start_line").alias("line"), "f.quote")


def _fields(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'front'").select("doc_id", F.substring_index("text", ": ", 1).alias("key"), F.expr("substring(text, instr(text, ': ') + 2)").alias("value"))


def _opening(blocks: DataFrame) -> DataFrame:
    """Per document the title, the first paragraph and its line, the level-2 headings."""
    heading = F.trim(F.regexp_replace("text", r"^ {0,3}#+|#+\s*$", ""))
    d = blocks.groupBy("doc_id").agg(
        F.max(F.when((F.col("kind") == "front") & F.col("text").startswith("title: "), F.expr("substring(text, 8)"))).alias("title"),
        F.min(F.when(F.col("kind") == "prose", F.struct("block_index", "start_line", "text"))).alias("p"),
        F.collect_list(F.when((F.col("kind") == "heading") & (F.col("level") == 2), heading)).alias("headings"),
        F.min(F.when((F.col("kind") == "heading") & (F.col("level") == 1), heading)).alias("h1"),
    )
    return d.withColumn("said", F.lower(F.concat_ws(" ", "title", "h1", "p.text")))


@rule("keywordMissing", "error", "blocks")
def keyword_missing(blocks: DataFrame, key: str = "keyword") -> DataFrame:
    """The keyword of the front matter stands neither in the title nor in the first paragraph."""
    k = _fields(blocks).filter((F.col("key") == key) & (F.col("value") != ""))
    return k.join(_opening(blocks), "doc_id").filter(~F.contains("said", F.lower("value"))).select("doc_id", F.coalesce("p.start_line", F.lit(1)).alias("line"), F.col("value").alias("quote"))


@rule("keywordHeading", "notice", "blocks")
def keyword_heading(blocks: DataFrame, key: str = "keyword", least: int = 3) -> DataFrame:
    """A word of the keyword that the opening has and none of three or more headings."""
    k = _fields(blocks).filter(F.col("key") == key).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("value"), r"[\s,]+"))).alias("word")).filter(F.length("word") >= 2)
    j = k.join(_opening(blocks), "doc_id").filter(F.size("headings") >= least).filter(F.contains("said", F.col("word")) & ~F.contains(F.lower(F.array_join("headings", " ")), F.col("word")))
    return j.select("doc_id", F.coalesce("p.start_line", F.lit(1)).alias("line"), F.col("word").alias("quote"))


@rule("fieldEcho", "notice", "blocks")
def field_echo(blocks: DataFrame, opening: tuple[str, ...] = ("question",), closing: tuple[str, ...] = ("answer",)) -> DataFrame:
    """A field of the front matter that shares no topic with the introduction, or one that shares none with the last two sections."""
    b = blocks.filter("kind = 'prose'").withColumn("top", F.max("section_index").over(Window.partitionBy("doc_id")))
    said = b.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list(F.when(F.col("section_index") == 0, F.col("text")))).alias("intro"), F.concat_ws(" ", F.collect_list(F.when((F.col("top") > 0) & (F.col("section_index") >= F.greatest(F.col("top") - 1, F.lit(1))), F.col("text")))).alias("end"))
    f = _fields(blocks).withColumn("where", F.when(F.col("key").isin(*opening), "intro").when(F.col("key").isin(*closing), "end")).filter("where is not null")
    t = tokens.topics(F.col("value"))
    j = f.join(said, "doc_id").withColumn("there", F.when(F.col("where") == "intro", F.col("intro")).otherwise(F.col("end"))).filter("there <> ''")
    return j.filter((F.size(t) > 0) & ~F.arrays_overlap(t, tokens.topics(F.col("there")))).select("doc_id", F.lit(1).alias("line"), F.col("value").alias("quote"))


def _named(text: Column, patterns: list[str]) -> Column:
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])), lambda x: x.rlike(DATA_FILE)))


def code_files(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_index, line, code, kind, name): data files that lines of code read or write."""
    lines = blocks.filter("kind = 'code' and text rlike '^ {0,3}(```|~~~)'").select("doc_id", "block_index", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "code")).filter("i > 0")
    acts = F.concat(F.transform(_named(F.col("code"), READS), lambda n: F.struct(F.lit("read").alias("kind"), n.alias("name"))), F.transform(_named(F.col("code"), WRITES), lambda n: F.struct(F.lit("write").alias("kind"), n.alias("name"))))
    return lines.select("doc_id", "block_index", (F.col("start_line") + F.col("i")).alias("line"), "code", F.explode(acts).alias("a")).select("doc_id", "block_index", "line", "code", "a.*")


@rule("inputFileSource", "error", "blocks")
def input_file_source(blocks: DataFrame) -> DataFrame:
    """Code reads a file that no earlier line writes and no earlier prose names; the first such line of each file."""
    f = code_files(blocks)
    reads = f.filter("kind = 'read'").groupBy("doc_id", "name").agg(F.min(F.struct("line", "code")).alias("f"))
    made = f.filter("kind = 'write'").groupBy("doc_id", "name").agg(F.min("line").alias("made"))
    prose = blocks.filter("kind in ('prose', 'list')").select("doc_id", F.col("start_line").alias("told"), "text")
    told = reads.join(prose, "doc_id").filter((F.col("told") < F.col("f.line")) & F.contains("text", F.substring_index("name", "/", -1))).select("doc_id", "name").distinct()
    left = reads.join(made, ["doc_id", "name"], "left").filter("made is null or made >= f.line").join(told, ["doc_id", "name"], "left_anti")
    return left.select("doc_id", "f.line", F.trim("f.code").alias("quote"))


@rule("installImport", "error", "blocks")
def install_import(blocks: DataFrame) -> DataFrame:
    """In a document that installs packages: an import that is neither installed, nor of the standard library, nor a file of its own."""
    code = blocks.filter("kind = 'code'")
    clean = lambda x: F.lower(F.replace(F.regexp_replace(x, r"[\[<>=!~].*$", ""), F.lit("_"), F.lit("-")))
    installed = code.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(INSTALL), F.lit(1))).alias("l")).select("doc_id", F.explode(F.split("l", r"\s+")).alias("x")).filter("x <> '' and not startswith(x, '-')").select("doc_id", clean(F.col("x")).alias("package")).distinct()
    own = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\.py\b"), F.lit(1))).alias("module")).distinct()
    lines = code.select("doc_id", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    name = F.regexp_extract("l", IMPORT, 1)
    imports = lines.select("doc_id", (F.col("start_line") + F.col("i")).alias("line"), F.trim("l").alias("quote"), name.alias("module")).filter("module <> ''").filter(~F.col("module").isin(*sorted(sys.stdlib_module_names)))
    alias = F.create_map(*[F.lit(x) for pair in IMPORTED_AS.items() for x in pair])
    imports = imports.withColumn("package", clean(F.coalesce(alias[F.col("module")], F.col("module")))).join(own, ["doc_id", "module"], "left_anti")
    missing = imports.join(installed.select("doc_id").distinct(), "doc_id", "left_semi").join(installed, ["doc_id", "package"], "left_anti")
    return missing.groupBy("doc_id", "module").agg(F.min(F.struct("line", "quote")).alias("f")).select("doc_id", "f.line", "f.quote")


def section_at(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """lines (doc_id, line) with section_index and block_index of the last block that starts at or before the line: an as-of lookup by union and window."""
    marks = blocks.filter("kind <> 'front'").select("doc_id", F.col("start_line").alias("line"), F.lit(0).alias("t"), "section_index", "block_index")
    asked = lines.select("doc_id", "line").distinct().select("doc_id", "line", F.lit(1).alias("t"), F.lit(None).cast("long").alias("section_index"), F.lit(None).cast("int").alias("block_index"))
    w = Window.partitionBy("doc_id").orderBy("line", "t").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).select("doc_id", "line", "t", F.last("section_index", True).over(w).alias("section_index"), F.last("block_index", True).over(w).alias("block_index"))
    return both.filter("t = 1").drop("t")
