"""Profiles and audits: what the documents of a kind are like, and where one document stands. All measures of one document are one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import markers, tokens
from proselake.functions.text import normal_words, sentence_array, strip, word_array

CAP = 200
POINTS = (50, 90, 95, 99)
#: Measures of a sentence that profiles hold.
SENTENCE_FEATURES = ("words", "chars", "commas", "numbers", "causes", "calls", "hedges", "newWords", "topicOverlap")
#: Rates of a document, in thousandths of its sentences.
RATES = ("questions", "commands", "connectors", "hedges", "causes", "calls", "longSentences")


def sentence_structs(text: Column) -> Column:
    """Sentences with their measures as an array, in order; nothing leaves the document's row."""
    s = sentence_array(text)
    bag = lambda q: F.array_distinct(normal_words(q))

    def measured(q: Column) -> Column:
        end = markers.ending_of(q)
        return F.struct(
            q.alias("sentence"), F.size(word_array(q)).alias("words"), F.length(q).alias("chars"), F.regexp_count(q, F.lit(",")).alias("commas"), F.regexp_count(q, F.lit(markers.NUMBER)).alias("numbers"),
            markers.count_of(q, markers.CAUSES).alias("causes"), markers.count_of(q, markers.READER_CALLS).alias("calls"), markers.count_of(q, markers.HEDGES).alias("hedges"),
            end.alias("ending"), markers.mood_of(q, end).alias("mood"), markers.connector_of(q).alias("connector"), bag(q).alias("bag"),
        )

    return F.transform(s, measured)


def document_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns kept and `s`, the measured sentences."""
    return docs.select("doc_id", *keep, sentence_structs(F.col("text")).alias("s"))


def sentence_values(docs: DataFrame, kind: str) -> DataFrame:
    """(kind, feature, value) per sentence and feature. New words and overlaps come from arrays of the same row."""
    d = document_rows(docs, kind)
    one = d.select("doc_id", kind, F.posexplode(F.zip_with("s", F.slice("s", F.lit(1), F.size("s")), lambda a, _: a)).alias("i", "x"), F.col("s.bag").alias("bags"))
    before = F.get("bags", F.col("i") - 1)
    known = F.array_distinct(F.flatten(F.slice("bags", F.lit(1), F.col("i"))))
    new = F.size(F.array_except("x.bag", known))
    overlap = F.when(F.col("i") > 0, F.floor(F.lit(100) * tokens.jaccard(F.col("x.bag"), before)))
    values = {f: F.col(f"x.{f}") for f in SENTENCE_FEATURES[:7]} | {"newWords": new, "topicOverlap": overlap}
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), v.cast("long").alias("value")) for f, v in values.items()])
    return one.select(F.col(kind).alias("kind"), F.explode(pairs).alias("m")).select("kind", "m.*").filter("value is not null")


def histograms(values: DataFrame) -> DataFrame:
    """(kind, feature, value, n) with values capped; at most CAP + 1 rows per feature and kind."""
    return values.groupBy("kind", "feature", F.least("value", F.lit(CAP)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def profile(docs: DataFrame, kind: str) -> DataFrame:
    """Per kind and feature: total and percentiles of the sentence measures."""
    w = Window.partitionBy("kind", "feature")
    h = histograms(sentence_values(docs, kind)).withColumn("c", F.sum("n").over(w.orderBy("value"))).withColumn("t", F.sum("n").over(w))
    return h.groupBy("kind", "feature").agg(F.max("t").alias("total"), *[F.min(F.when(F.col("c") * 100 >= F.col("t") * p, F.col("value"))).alias(f"p{p}") for p in POINTS])


def _sum(s: Column, f) -> Column:
    return F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + f(x).cast("long"))


def document_rates(docs: DataFrame, *keep: str, long: int = 30) -> DataFrame:
    """doc_id, sentences and RATES in thousandths of sentences; 0 for documents without any."""
    d = document_rows(docs, *keep)
    is_ = {"questions": lambda x: x["mood"] == markers.QUESTION, "commands": lambda x: x["mood"] == markers.COMMAND, "connectors": lambda x: x["connector"].isNotNull(), "hedges": lambda x: x["hedges"] > 0, "causes": lambda x: x["causes"] > 0, "calls": lambda x: x["calls"] > 0, "longSentences": lambda x: x["words"] > long}
    rate = lambda f: F.when(F.size("s") > 0, F.floor(_sum(F.col("s"), f) * 1000 / F.size("s"))).otherwise(0)
    return d.select("doc_id", *keep, F.size("s").alias("sentences"), *[rate(is_[r]).cast("long").alias(r) for r in RATES])


def rate_percentiles(docs: DataFrame, kind: str, points: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """Per kind and rate the nearest-rank percentiles over documents, from counts of distinct rates."""
    r = document_rates(docs, kind)
    long = r.select(F.col(kind).alias("kind"), F.explode(F.array(*[F.struct(F.lit(x).alias("rate"), F.col(x).alias("value")) for x in RATES])).alias("m")).select("kind", "m.*")
    n = long.groupBy("kind", "rate", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind", "rate")
    n = n.withColumn("c", F.sum("n").over(w.orderBy("value"))).withColumn("t", F.sum("n").over(w))
    return n.groupBy("kind", "rate").agg(*[F.min(F.when(F.col("c") * 100 >= F.col("t") * p, F.col("value"))).alias(f"p{p}") for p in points])


def rhythm(docs: DataFrame) -> DataFrame:
    """Per document with sentences: their number, mean, standard deviation and burstiness (sd - mean) / (sd + mean) of the words, in thousandths."""
    d = document_rows(docs).filter(F.size("s") > 0)
    n = F.size("s")
    total, square = _sum(F.col("s"), lambda x: x["words"]), _sum(F.col("s"), lambda x: x["words"] * x["words"])
    d = d.select("doc_id", n.alias("sentences"), total.alias("total"), square.alias("square"))
    variance = F.col("square") / F.col("sentences") - (F.col("total") / F.col("sentences")) * (F.col("total") / F.col("sentences"))
    sd, mean = F.sqrt(F.greatest(variance, F.lit(0.0))), F.col("total") / F.col("sentences")
    milli = lambda x: F.floor(x * 1000 + 1e-6)
    return d.select("doc_id", "sentences", milli(mean).alias("mean"), milli(sd).alias("deviation"), milli(F.when(sd + mean > 0, (sd - mean) / (sd + mean)).otherwise(0.0)).alias("burstiness"))


def paragraph_prints(docs: DataFrame) -> DataFrame:
    """Paragraphs (lines with sentences): sentences, words, mean and deviation in thousandths, shared and united words with the paragraph before.

    One array per document; the neighbour is the element before, so no rows are exchanged.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.size(sentence_array(x)) > 0)
    p = docs.select("doc_id", F.transform(lines, lambda x: F.struct(F.transform(sentence_array(x), lambda q: F.size(word_array(q))).alias("w"), F.array_distinct(normal_words(x)).alias("bag"))).alias("p"))
    p = p.select("doc_id", F.posexplode("p").alias("paragraph", "x"), F.col("p.bag").alias("bags")).withColumn("before", F.get("bags", F.col("paragraph") - 1))
    n, total = F.size("x.w"), F.aggregate("x.w", F.lit(0).cast("long"), lambda a, b: a + b)
    square = F.aggregate("x.w", F.lit(0).cast("long"), lambda a, b: a + b * b)
    sd = F.sqrt(F.greatest(square / n - (total / n) * (total / n), F.lit(0.0)))
    shared = F.when(F.col("paragraph") > 0, F.size(F.array_intersect("x.bag", "before")))
    united = F.when(F.col("paragraph") > 0, F.size(F.array_union("x.bag", "before")))
    return p.select("doc_id", "paragraph", n.alias("sentences"), total.alias("words"), F.floor(total / n * 1000 + 1e-6).alias("mean"), F.floor(sd * 1000 + 1e-6).alias("deviation"), shared.alias("shared"), united.alias("united"))


def section_shapes(blocks: DataFrame) -> DataFrame:
    """Per section: its first line and the number of blocks of each kind."""
    kinds = ("prose", "code", "list", "table", "image", "quote", "html")
    count = lambda k: F.sum((F.col("kind") == k).cast("int")).alias(k)
    return blocks.filter("kind <> 'front'").groupBy("doc_id", "section_index").agg(F.min("start_line").alias("line"), *[count(k) for k in kinds])


def document_summary(blocks: DataFrame) -> DataFrame:
    """Per document: sections with a heading, headings, paragraphs, code blocks, images, tables."""
    is_ = lambda k: F.sum((F.col("kind") == k).cast("int"))
    return blocks.filter("kind <> 'front'").groupBy("doc_id").agg(F.max("section_index").alias("sections"), is_("heading").alias("headings"), is_("prose").alias("paragraphs"), is_("code").alias("code"), is_("image").alias("images"), is_("table").alias("tables"))


def audit(docs: DataFrame, reference: DataFrame, kind: str) -> DataFrame:
    """Each document's rates beside those of its kind: (doc_id, rate, value, p10, p50, p90, place). reference: rate_percentiles."""
    r = document_rates(docs, kind).select("doc_id", F.col(kind).alias("kind"), F.explode(F.array(*[F.struct(F.lit(x).alias("rate"), F.col(x).alias("value")) for x in RATES])).alias("m")).select("doc_id", "kind", "m.*")
    place = F.when(F.col("value") < F.col("p10"), "below").when(F.col("value") > F.col("p90"), "above").otherwise("within")
    return r.join(reference, ["kind", "rate"], "left").select("doc_id", "rate", "value", "p10", "p50", "p90", place.alias("place"))


def profile_changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Differences of the same measures in two tables; rows of one side count as 0 in the other."""
    a = before.select(*keys, *[F.col(v).alias(f"was_{v}") for v in values])
    b = after.select(*keys, *[F.col(v).alias(f"now_{v}") for v in values])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, keys, "full").select(*keys, *[(zero(f"now_{v}") - zero(f"was_{v}")).alias(v) for v in values])


def corpus_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, n, per 1,000 sentences) over the whole corpus."""
    total = docs.select(F.size(sentence_array(F.col("text"))).alias("n")).agg(F.sum("n").alias("total"))
    n = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total), F.lit(True)).select("rule", "n", F.floor(F.col("n") * 1000 / F.col("total")).alias("per_thousand"))


def duplicate_share(docs: DataFrame) -> DataFrame:
    """One row: sentences, distinct keys (blanks and digits folded), repeats in thousandths."""
    k = docs.select(F.explode(F.transform(sentence_array(F.col("text")), tokens.sentence_key)).alias("k"))
    n = k.groupBy(F.xxhash64("k").alias("h"), "k").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("sentences"), F.count(F.lit(1)).alias("keys")).select("sentences", "keys", F.floor((F.col("sentences") - F.col("keys")) * 1000 / F.col("sentences")).alias("repeats"))


def allocate(total: int, weights: list[int], minimums: list[int] | None = None) -> list[int]:
    """Whole shares of a total by largest remainder, no share below its minimum; ties go to the earlier slot."""
    least = minimums or [0] * len(weights)
    if sum(least) > total:
        raise ValueError("the minimums exceed the total")
    fixed: set[int] = set()
    while True:  # slots below their minimum get it, the rest is shared anew
        free = [i for i in range(len(weights)) if i not in fixed]
        left, mass = total - sum(least[i] for i in fixed), sum(weights[i] for i in free)
        share = {i: divmod(left * weights[i], mass) if mass else (0, 0) for i in free}
        low = [i for i in free if share[i][0] < least[i]]
        if not low:
            break
        fixed |= set(low)
    out = [least[i] if i in fixed else share[i][0] for i in range(len(weights))]
    for i in sorted(free, key=lambda i: (-share[i][1], i))[: total - sum(out)]:
        out[i] += 1
    return out


def blueprint(weights: list[int], sentences: int, paragraph: int, chars: int) -> list[dict]:
    """Sentences, paragraphs and characters of each section of a text of so many sentences."""
    parts = allocate(sentences, weights, [1] * len(weights))
    return [{"section": i, "sentences": n, "paragraphs": -(-n // paragraph), "chars": n * chars} for i, n in enumerate(parts)]


def prints(docs: DataFrame, *keep: str) -> DataFrame:
    """One print per document: sentences, words, questions, calls to the reader, endings, register counts and its measured sentences."""
    d = document_rows(docs, *keep)
    ends_as = lambda pattern: lambda x: tokens.last_word(x["sentence"]).rlike(pattern)
    registers = [F.size(F.filter("s", ends_as(pattern))).alias(name) for name, pattern in tokens.REGISTERS]
    return d.select("doc_id", *keep, F.size("s").alias("sentences"), _sum(F.col("s"), lambda x: x["words"]).alias("words"), _sum(F.col("s"), lambda x: x["mood"] == markers.QUESTION).alias("questions"), _sum(F.col("s"), lambda x: x["calls"]).alias("calls"), F.struct(*registers).alias("registers"), F.col("s").alias("prints"))


def fragments(blocks: DataFrame) -> DataFrame:
    """Texts outside prose: list items, table cells, headings and image labels with their lines."""
    lines = blocks.filter("kind in ('list', 'table', 'heading', 'image')").select("doc_id", "block_index", "kind", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    cells = F.when(F.col("kind") == "table", F.filter(F.transform(F.split(F.regexp_replace(strip(F.col("l")), r"^\||\|$", ""), r"\|", -1), strip), lambda c: (c != "") & ~c.rlike(markers.TABLE_RULE)))
    cells = cells.when(F.col("kind") == "heading", F.array(F.trim(F.regexp_replace("l", r"^ {0,3}#+|#+\s*$", "")))).when(F.col("kind") == "image", F.regexp_extract_all("l", F.lit(r"!\[([^\]]*)\]"), F.lit(1)))
    cells = cells.otherwise(F.array(strip(F.regexp_replace("l", f"^{markers.BULLET}", ""))))
    return lines.select("doc_id", "block_index", "kind", (F.col("start_line") + F.col("i")).alias("line"), F.explode(cells).alias("text")).filter("text <> ''")
