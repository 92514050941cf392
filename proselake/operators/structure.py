"""Rules over Markdown blocks and Korean sentences. Each returns findings (doc_id, rule, severity, line, quote); windows run within one document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import markers
from proselake.functions.hangul import FIRST, LAST
from proselake.functions.text import placed_sentences, sentence_array, strip, word_array
from proselake.sources.markdown import add_sections, parse_markdown

RULES: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]] = {}
#: Fence languages that hold output, an emoji after a bullet.
OUTPUTS = ["", "text", "output", "console"]
EMOJI_BULLET = r"^\s*(?:[-*+]|[0-9]+[.)])\s+[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B06}]"


def _in_document():
    return Window.partitionBy("doc_id").orderBy("block_index")


def rule(name: str, severity: str, level: str) -> Callable:
    """Register a function of the rows of one level (blocks or sentences) that returns doc_id, line and quote."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        RULES[name] = (severity, level, f)
        return f

    return add


def blocks_with_language(docs: DataFrame) -> DataFrame:
    """Blocks with section_index and, for code, the language of the fence ('' without one)."""
    b = add_sections(parse_markdown(docs, front=True))
    return b.withColumn("language", F.when(F.col("kind") == "code", F.lower(F.regexp_extract("text", r"^ {0,3}(?:```+|~~~+)[ \t]*([^\s]*)", 1))))


def prose_sentences(blocks: DataFrame) -> DataFrame:
    """Sentences of prose blocks: pos counts over the document (block, place in it), line is where the sentence starts."""
    s = blocks.filter("kind = 'prose'").select("doc_id", "section_index", "block_index", "start_line", F.posexplode(placed_sentences(F.col("text"))).alias("place", "s"))
    s = s.select("doc_id", "section_index", "block_index", (F.col("start_line") + F.col("s.newlines")).alias("line"), "place", "s.quote")
    return s.withColumn("pos", F.struct("block_index", "place"))


def findings_of(blocks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Findings of the named rules (all without names) in blocks; only these are planned. Each rule scans the blocks, so write those of a large corpus as a table first."""
    levels = {"blocks": blocks, "sentences": prose_sentences(blocks)}
    out = [f(levels[level]).select("doc_id", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("line").cast("int").alias("line"), "quote") for name, (severity, level, f) in sorted(RULES.items()) if names is None or name in names]
    return reduce(DataFrame.unionByName, out)


def findings(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """findings_of the blocks of Markdown texts."""
    return findings_of(blocks_with_language(docs), names)


def without_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose (doc_id, rule, quote with single blanks) is not locked."""
    key = F.regexp_replace(strip(F.col("quote")), r"\s+", " ")
    return found.withColumn("__k", key).join(baseline.select("doc_id", "rule", F.col("quote").alias("__k")), ["doc_id", "rule", "__k"], "left_anti").drop("__k")


def _title() -> Column:
    return F.trim(F.regexp_replace("text", r"^ {0,3}#+|#+\s*$", ""))


def _headings(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'heading'").withColumn("quote", _title()).withColumn("line", F.col("start_line"))


@rule("headingSkip", "error", "blocks")
def heading_skip(blocks: DataFrame) -> DataFrame:
    """A heading more than one level below the one before; a title in the front matter counts as level 1."""
    titled = F.max(((F.col("kind") == "front") & F.col("text").rlike("^title: .")).cast("int")).over(Window.partitionBy("doc_id"))
    h = blocks.withColumn("titled", titled).filter("kind = 'heading'").withColumn("quote", _title()).withColumn("line", F.col("start_line"))
    return h.withColumn("before", F.coalesce(F.lag("level").over(_in_document()), F.when(F.col("titled") == 1, 1))).filter("level > before + 1")


@rule("headingSentence", "error", "blocks")
def heading_sentence(blocks: DataFrame) -> DataFrame:
    """A heading that ends as a sentence does."""
    ends = F.col("quote").endswith(".") | ~markers.ending_of(F.col("quote")).isin(markers.NO_ENDING, markers.QUESTION)
    return _headings(blocks).filter(ends)


@rule("headingUniform", "notice", "blocks")
def heading_uniform(blocks: DataFrame) -> DataFrame:
    """Three or more level-2 headings in Hangul, three quarters of them with the same last syllable."""
    code = F.ascii(F.right("quote", F.lit(1)))
    h = _headings(blocks).filter("level = 2").filter(code.between(FIRST, LAST)).groupBy("doc_id", F.right("quote", F.lit(1)).alias("last")).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("line", "quote")).alias("h"))
    h = h.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("n").alias("total"), F.sort_array(F.flatten(F.collect_list("h"))).alias("h"))
    return h.filter("total >= 3 and n * 4 >= total * 3").select("doc_id", F.get("h.line", F.lit(0)).alias("line"), F.array_join("h.quote", ", ").alias("quote"))


@rule("sectionNoProse", "error", "blocks")
def section_no_prose(blocks: DataFrame) -> DataFrame:
    """A section with blocks of which none is prose or a list."""
    body = blocks.filter("section_index > 0")
    s = body.groupBy("doc_id", "section_index").agg(F.min("start_line").alias("line"), F.min_by(_title(), "block_index").alias("quote"), F.count(F.lit(1)).alias("n"), F.max(F.col("kind").isin("prose", "list").cast("int")).alias("told"))
    return s.filter("n > 1 and told = 0")


@rule("loneSubheading", "notice", "blocks")
def lone_subheading(blocks: DataFrame) -> DataFrame:
    """The one level-3 heading below a level-2 heading."""
    h = _headings(blocks).filter("section_index > 0 and level in (2, 3)")
    child = F.col("level") == 3
    s = h.groupBy("doc_id", "section_index").agg(F.sum(child.cast("int")).alias("n"), F.min(F.when(child, F.struct("line", "quote"))).alias("f"))
    return s.filter("n = 1").select("doc_id", "f.line", "f.quote")


@rule("introImage", "error", "blocks")
def intro_image(blocks: DataFrame, most: int = 1) -> DataFrame:
    """More images before the first section than allowed."""
    image = (F.col("kind") == "image") & (F.col("section_index") == 0)
    first = F.min(F.when(image, F.struct(F.col("start_line").alias("line"), strip(F.col("text")).alias("quote"))))
    d = blocks.groupBy("doc_id").agg(F.max("section_index").alias("sections"), F.sum(image.cast("int")).alias("n"), first.alias("f"))
    return d.filter((F.col("sections") > 0) & (F.col("n") > most)).select("doc_id", "f.line", "f.quote")


@rule("introLong", "error", "blocks")
def intro_long(blocks: DataFrame, most: int = 4) -> DataFrame:
    """Too many paragraphs before the first of two or more sections, but not over half of all."""
    intro = (F.col("kind") == "prose") & (F.col("section_index") == 0)
    d = blocks.groupBy("doc_id").agg(F.max("section_index").alias("sections"), F.sum((F.col("kind") == "prose").cast("int")).alias("all"), F.sort_array(F.collect_list(F.when(intro, F.struct("start_line", "text")))).alias("p"))
    d = d.filter((F.col("sections") >= 2) & (F.size("p") > most) & (F.size("p") * 2 <= F.col("all")))
    over = F.get("p", F.lit(most))
    return d.select("doc_id", over["start_line"].alias("line"), F.get(sentence_array(over["text"]), F.lit(0)).alias("quote"))


@rule("blockUnread", "notice", "blocks")
def block_unread(blocks: DataFrame) -> DataFrame:
    """Output right after code that no prose follows."""
    b = blocks.withColumn("before", F.lag("language").over(_in_document())).withColumn("after", F.lead("kind").over(_in_document()))
    b = b.filter(F.col("language").isin(OUTPUTS) & ~F.col("before").isin(OUTPUTS) & ~F.col("after").eqNullSafe("prose"))
    return b.select("doc_id", F.col("start_line").alias("line"), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.col("text")).alias("quote"))


@rule("emojiBullet", "error", "blocks")
def emoji_bullet(blocks: DataFrame) -> DataFrame:
    """The first item of a list that starts with an emoji."""
    lines = blocks.filter("kind = 'list'").select("doc_id", "block_index", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "l")).filter(F.col("l").rlike(EMOJI_BULLET))
    return lines.groupBy("doc_id", "block_index").agg(F.min(F.col("start_line") + F.col("i")).alias("line"), F.min_by(strip(F.col("l")), "i").alias("quote"))


@rule("dash", "error", "blocks")
def dash(blocks: DataFrame) -> DataFrame:
    """Every line with an en or em dash, code included."""
    return blocks.filter(F.col("text").rlike("[–—]")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"), "start_line").filter(F.col("l").rlike("[–—]")).select("doc_id", (F.col("start_line") + F.col("i")).alias("line"), strip(F.col("l")).alias("quote"))


@rule("firstResultDistance", "notice", "blocks")
def first_result(blocks: DataFrame, most: int = 4) -> DataFrame:
    """The first paragraph beyond the allowed number before the first code, image or table, with its first sentence."""
    whole = Window.partitionBy("doc_id")
    shown = F.min(F.when(F.col("kind").isin("code", "image", "table"), F.col("block_index"))).over(whole)
    b = blocks.withColumn("first", shown).filter("kind = 'prose' and block_index < first").withColumn("n", F.row_number().over(_in_document()))
    return b.filter(F.col("n") == most + 1).select("doc_id", F.col("start_line").alias("line"), F.get(sentence_array(F.col("text")), F.lit(0)).alias("quote"))


@rule("duplicateBlock", "notice", "blocks")
def duplicate_block(blocks: DataFrame, least: int = 4, percent: int = 90) -> DataFrame:
    """Code whose lines, as a multiset, nearly equal those of an earlier block (Dice); pairs arise from shared lines of one document."""
    lines = blocks.filter("kind = 'code'").select("doc_id", "block_index", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "l")).filter((strip(F.col("l")) != "") & ~F.col("l").rlike(r"^ {0,3}(```|~~~)"))
    n = lines.groupBy("doc_id", "block_index", "start_line", "l").agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("doc_id", "block_index").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    opening = lines.groupBy("doc_id", "block_index").agg(F.min_by(strip(F.col("l")), "i").alias("first_line"))
    n = n.join(size, ["doc_id", "block_index"]).join(opening, ["doc_id", "block_index"])
    old = n.select("doc_id", "l", F.col("block_index").alias("old"), F.col("n").alias("m"), F.col("size").alias("old_size"))
    pairs = n.join(old, ["doc_id", "l"]).filter("old < block_index").groupBy("doc_id", "block_index", "start_line", "first_line", "old", "size", "old_size").agg(F.sum(F.least("n", "m")).alias("common"))
    return pairs.filter(F.col("common") * 200 >= percent * (F.col("size") + F.col("old_size"))).groupBy("doc_id", "block_index").agg(F.min("start_line").alias("line"), F.min("first_line").alias("quote"))


@rule("connectorRepeat", "error", "sentences")
def connector_repeat(s: DataFrame) -> DataFrame:
    """A sentence that opens with the connector of the one before in its paragraph."""
    s = s.withColumn("c", markers.connector_of(F.col("quote")))
    return s.withColumn("before", F.lag("c").over(Window.partitionBy("doc_id", "block_index").orderBy("place"))).filter("c = before")


@rule("fillerOpener", "error", "sentences")
def filler_opener(s: DataFrame) -> DataFrame:
    return s.filter(F.col("quote").rlike(markers.FILLERS))


@rule("imperativePeriod", "error", "sentences")
def imperative_period(s: DataFrame) -> DataFrame:
    return s.filter(F.col("quote").rlike(markers.COMMAND_PERIOD))


@rule("doubleNegative", "error", "sentences")
def double_negative(s: DataFrame) -> DataFrame:
    return s.filter(F.col("quote").rlike(markers.DOUBLE_NEGATIVES))


@rule("enoughOnce", "error", "sentences")
def enough_once(s: DataFrame) -> DataFrame:
    """The second and later sentences that say enough is done."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return s.filter(markers.has_any(F.col("quote"), markers.ENOUGH)).withColumn("n", n).filter("n > 1")


@rule("promiseRecall", "notice", "sentences")
def promise_recall(s: DataFrame) -> DataFrame:
    """The first promise of a document that recalls nothing."""
    promise, recall = markers.has_any(F.col("quote"), markers.PROMISES), markers.has_any(F.col("quote"), markers.RECALLS)
    d = s.groupBy("doc_id").agg(F.min(F.when(promise, F.struct("pos", "line", "quote"))).alias("p"), F.max(recall.cast("int")).alias("recalled"))
    return d.filter("p is not null and recalled = 0").select("doc_id", "p.line", "p.quote")


@rule("longSentence", "notice", "sentences")
def long_sentence(s: DataFrame, most: int = 30) -> DataFrame:
    return s.filter(F.size(word_array(F.col("quote"))) > most)


@rule("euiChain", "error", "sentences")
def genitive_chain(s: DataFrame) -> DataFrame:
    """Three genitives in a sentence, or two side by side."""
    count, adjacent = markers.genitives(F.col("quote"))
    return s.filter((count >= 3) | ((count >= 2) & adjacent))


@rule("negationRedefine", "error", "sentences")
def negation_redefine(s: DataFrame) -> DataFrame:
    """"Not simply X" right before a sentence of the paragraph that ends in the copula."""
    after = F.lead("quote").over(Window.partitionBy("doc_id", "block_index").orderBy("place"))
    return s.withColumn("after", after).filter(F.col("quote").rlike(markers.NEGATION) & F.col("after").rlike(markers.DEFINITION))


@rule("endingRepeat", "notice", "sentences")
def ending_repeat(s: DataFrame, least: int = 4) -> DataFrame:
    """A run of one ending in a section without a cause or a call to the reader; questions, commands and unknown endings break runs."""
    s = s.withColumn("ending", markers.ending_of(F.col("quote"))).withColumn("lively", markers.has_any(F.col("quote"), markers.CAUSES + markers.READER_CALLS))
    section = Window.partitionBy("doc_id", "section_index").orderBy("pos")
    island = F.row_number().over(section) - F.row_number().over(Window.partitionBy("doc_id", "section_index", "ending").orderBy("pos"))
    runs = s.withColumn("island", island).filter(~F.col("ending").isin(markers.NO_ENDING, markers.QUESTION, markers.COMMAND)).groupBy("doc_id", "section_index", "ending", "island")
    runs = runs.agg(F.count(F.lit(1)).alias("n"), F.max("lively").alias("lively"), F.min(F.struct("pos", "line", "quote")).alias("f"))
    return runs.filter((F.col("n") >= least) & ~F.col("lively")).select("doc_id", "f.line", "f.quote")


@rule("factListParagraph", "notice", "sentences")
def fact_list_paragraph(s: DataFrame, least: int = 3, mean: int = 8) -> DataFrame:
    """Short sentences of one paragraph that nothing links."""
    q = F.col("quote")
    linked = markers.has_any(q, markers.CAUSES + markers.READER_CALLS) | markers.connector_of(q).isNotNull() | (markers.mood_of(q, markers.ending_of(q)) == markers.QUESTION)
    p = s.groupBy("doc_id", "block_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(word_array(q))).alias("words"), F.max(linked).alias("linked"), F.min(F.struct("pos", "line", "quote")).alias("f"))
    return p.filter((F.col("n") >= least) & (F.col("words") <= mean * F.col("n")) & ~F.col("linked")).select("doc_id", "f.line", "f.quote")


@rule("bridgeRepeat", "error", "sentences")
def bridge_repeat(s: DataFrame, least: int = 3) -> DataFrame:
    """Sections whose last sentence announces the next one, from `least` of them on."""
    last = s.filter("section_index > 0").groupBy("doc_id", "section_index").agg(F.max(F.struct("pos", "line", "quote")).alias("f"))
    last = last.filter(markers.has_any(F.col("f.quote"), markers.BRIDGES)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"))
    return last.filter(F.col("n") >= least).select("doc_id", "f.line", "f.quote")


@rule("paraFragment", "error", "blocks")
def para_fragment(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Paragraphs of one or two sentences in a row; other blocks and longer paragraphs break the row."""
    section = Window.partitionBy("doc_id", "section_index").orderBy("block_index")
    b = blocks.withColumn("said", sentence_array(F.col("text"))).withColumn("short", (F.col("kind") == "prose") & (F.size("said") <= 2))
    b = b.withColumn("island", F.sum((~F.col("short")).cast("int")).over(section)).filter("short")
    runs = b.groupBy("doc_id", "section_index", "island").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block_index", "start_line", F.get("said", F.lit(0)).alias("quote"))).alias("f"))
    return runs.filter(F.col("n") >= least).select("doc_id", F.col("f.start_line").alias("line"), "f.quote")


@rule("noQuestion", "notice", "blocks")
def no_question(blocks: DataFrame) -> DataFrame:
    """Two or more sections and no question in sentences or headings."""
    said = sentence_array(F.col("text"))
    asked = F.when(F.col("kind") == "prose", F.exists(said, lambda q: markers.mood_of(q, markers.ending_of(q)) == markers.QUESTION)).otherwise((F.col("kind") == "heading") & F.col("text").contains("?"))
    first = F.min(F.when(F.col("kind") == "prose", F.struct("block_index", "start_line", F.get(said, F.lit(0)).alias("quote"))))
    d = blocks.groupBy("doc_id").agg(F.max("section_index").alias("sections"), F.max(asked).alias("asked"), first.alias("f"))
    return d.filter((F.col("sections") >= 2) & ~F.col("asked")).select("doc_id", F.coalesce("f.start_line", F.lit(1)).alias("line"), F.coalesce("f.quote", F.lit("")).alias("quote"))


@rule("moreLater", "notice", "blocks")
def more_later(blocks: DataFrame, most: int = 150) -> DataFrame:
    """The longest list item of the last section, where one is too long; continuation lines count, link targets and marks do not."""
    b = blocks.withColumn("last", F.max("section_index").over(Window.partitionBy("doc_id"))).filter("last > 0 and section_index = last and kind = 'list'")
    items = b.select("doc_id", "block_index", "start_line", F.posexplode(F.split("text", rf"\n(?={markers.BULLET})")).alias("i", "item"))
    above = F.sum(F.size(F.split("item", "\n"))).over(Window.partitionBy("doc_id", "block_index").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    items = items.withColumn("line", (F.col("start_line") + F.coalesce(above, F.lit(0))).cast("int"))
    plain = F.regexp_replace(F.regexp_replace("item", f"^{markers.BULLET}", ""), r"\s*\n\s*", " ")
    items = items.withColumn("quote", strip(F.regexp_replace(F.regexp_replace(plain, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), "[*`]", "")))
    return items.filter(F.length("quote") > most).groupBy("doc_id").agg(F.max_by(F.struct("line", "quote"), F.struct(F.length("quote"), -F.col("line"))).alias("f")).select("doc_id", "f.line", "f.quote")


@rule("tableOddCell", "notice", "blocks")
def table_odd_cell(blocks: DataFrame, least: int = 4) -> DataFrame:
    """The one cell of a table column that is no measure where all others have one unit. The first row and the first column are names."""
    rows = blocks.filter("kind = 'table'").select("doc_id", "block_index", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("l", strip(F.col("l"))).filter(F.col("l").startswith("|"))
    rows = rows.withColumn("cells", F.transform(F.split(F.regexp_replace("l", r"^\|+|\|+$", ""), r"\|", -1), strip)).filter(~F.forall("cells", lambda c: (c == "") | c.rlike(markers.TABLE_RULE)))
    table = Window.partitionBy("doc_id", "block_index")
    rows = rows.withColumn("n", F.row_number().over(table.orderBy("i"))).filter("n > 1").withColumn("width", F.min(F.size("cells")).over(table))
    cells = rows.select("doc_id", "block_index", (F.col("start_line") + F.col("i")).alias("line"), "width", F.posexplode("cells").alias("column", "quote")).filter("column > 0 and column < width and quote not in ('', '-', '--')")
    unit = F.nullif(F.regexp_extract("quote", markers.UNIT, 1), F.lit(""))
    c = cells.withColumn("unit", unit).groupBy("doc_id", "block_index", "column").agg(F.count(F.lit(1)).alias("n"), F.count("unit").alias("measured"), F.min("unit").alias("lo"), F.max("unit").alias("hi"), F.min(F.when(F.col("unit").isNull(), F.struct("line", "quote"))).alias("f"))
    return c.filter((F.col("n") >= least) & (F.col("measured") == F.col("n") - 1) & (F.col("lo") == F.col("hi"))).select("doc_id", "f.line", "f.quote")


@rule("numberOrphan", "notice", "blocks")
def number_orphan(blocks: DataFrame) -> DataFrame:
    """A change "from A to B" whose A appears nowhere before: neither in earlier sentences or blocks nor earlier in the sentence."""
    s = prose_sentences(blocks)
    other = blocks.filter("kind <> 'prose'").select("doc_id", F.struct("block_index", F.lit(-1).alias("place")).alias("pos"), F.explode(markers.numerals_of(F.col("text"))).alias("base"))
    first = s.select("doc_id", "pos", F.explode(markers.numerals_of(F.col("quote"))).alias("base")).unionByName(other).groupBy("doc_id", "base").agg(F.min("pos").alias("first_pos"))
    m = s.select("doc_id", "pos", "line", "quote", F.explode(F.regexp_extract_all("quote", F.lit(markers.FROM_TO), F.lit(0))).alias("change"))
    m = m.select("*", *[F.replace(F.regexp_extract("change", markers.FROM_TO, g), F.lit(","), F.lit("")).alias(name) for g, name in ((1, "base"), (2, "to"))])
    m = m.withColumn("before", F.expr("left(quote, instr(quote, change) - 1)")).filter("base <> to and (contains(base, '.') or length(base) >= 2)")
    m = m.filter(~F.array_contains(markers.numerals_of(F.col("before")), F.col("base")) & ~F.expr("right(before, 12)").rlike(markers.ANCHORS))
    return m.join(first, ["doc_id", "base"], "left").filter("first_pos is null or first_pos >= pos").select("doc_id", "line", "quote").distinct()


@rule("platformApi", "notice", "blocks")
def platform_api(blocks: DataFrame) -> DataFrame:
    """Lines of code, not of output, that run on one system only."""
    code = blocks.filter((F.col("kind") == "code") & ~F.col("language").isin(OUTPUTS)).select("doc_id", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return code.filter(markers.has_any(F.col("l"), [p for p, _, _ in markers.PLATFORM_APIS])).select("doc_id", (F.col("start_line") + F.col("i")).alias("line"), strip(F.col("l")).alias("quote"))
