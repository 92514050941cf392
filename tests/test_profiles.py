import math

from pyspark.sql import functions as F

from proselake.operators import profiles as p
from proselake.operators import usage as u
from proselake.operators.structure import blocks_with_language

DOCS = [(1, "The cat sat. The dog ran, and ran.\nBirds fly high? Yes.", "en"), (2, "A cat sat. A cat sat.", "en"), (3, None, "ko"), (4, "비가 옵니다. 그래서 집에 갑니다. 왜 그럴까요?", "ko")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string")


def test_profile(spark):
    rows = {(r.kind, r.feature): r for r in p.profile(docs(spark), "lang").collect()}
    assert rows["en", "words"].total == 6 and rows["en", "words"].p50 == 3 and rows["en", "words"].p99 == 5
    new = sorted(r.value for r in p.sentence_values(docs(spark), "lang").filter("feature = 'newWords' and kind = 'en'").collect())
    assert new == [0, 1, 3, 3, 3, 3]
    rates = {r.doc_id: r for r in p.document_rates(docs(spark)).collect()}
    assert rates[3].sentences == 0 and rates[1].questions == 250 and rates[4].connectors == 333 and rates[4].questions == 333
    ref = p.rate_percentiles(docs(spark), "lang")
    got = {(r.doc_id, r.rate): r.place for r in p.audit(docs(spark), ref, "lang").collect()}
    assert got[1, "questions"] == "within" and len(got) == 4 * len(p.RATES)


def test_rhythm_and_paragraphs(spark):
    r = p.rhythm(docs(spark)).filter("doc_id = 1").first()
    lengths = [3, 5, 3, 1]
    sd = math.sqrt(sum((x - 3) ** 2 for x in lengths) / 4)
    assert (r.sentences, r.mean, r.deviation, r.burstiness) == (4, 3000, math.floor(sd * 1000), math.floor((sd - 3) / (sd + 3) * 1000))
    got = {(x.doc_id, x.paragraph): (x.sentences, x.words, x.shared, x.united) for x in p.paragraph_prints(docs(spark)).collect() if x.doc_id == 1}
    assert got == {(1, 0): (2, 8, None, None), (1, 1): (2, 4, 0, 10)}
    one = p.prints(docs(spark)).filter("doc_id = 4").first()
    assert (one.sentences, one.questions, one.registers["합니다"], one.registers["해요"]) == (3, 1, 2, 1)


def test_blocks(spark):
    text = "# t\n\n- one\n- two\n\n| a | b |\n|---|---|\n| c | d |\n\n![pic](x)\n\n## s\n\nprose\n"
    b = blocks_with_language(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(r.line, r.text) for r in p.fragments(b).orderBy("line", "text").collect()] == [(1, "t"), (3, "one"), (4, "two"), (6, "a"), (6, "b"), (8, "c"), (8, "d"), (10, "pic"), (12, "s")]
    assert [(r.line, r.prose, r["list"], r.table) for r in p.section_shapes(b).orderBy("section_index").collect()] == [(1, 0, 1, 1), (12, 1, 0, 0)]
    s = p.document_summary(b).first()
    assert (s.sections, s.headings, s.paragraphs, s.images) == (1, 2, 1, 1)


def test_changes_and_rates(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "rule string, n long")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "rule string, n long")
    assert {tuple(r) for r in p.profile_changes(a, b, ["rule"], ["n"]).collect()} == {("x", -2), ("y", -1), ("z", 2)}
    found = spark.createDataFrame([("x",), ("x",)], "rule string")
    assert tuple(p.corpus_rates(docs(spark), found).first()) == ("x", 2, 222)
    assert tuple(p.duplicate_share(docs(spark)).first()) == (9, 8, 111)


def test_allocation():
    assert p.allocate(10, [1, 1, 1]) == [4, 3, 3]
    assert p.allocate(10, [8, 1, 1], [0, 2, 2]) == [6, 2, 2]
    assert sum(p.allocate(17, [3, 0, 5], [1, 1, 1])) == 17
    assert [x["sentences"] for x in p.blueprint([1, 2, 1], 8, 3, 40)] == [2, 4, 2]


def test_usage_index(spark, tmp_path):
    rows = [(1, "# head.\n- 서버가 느립니다. 데이터를 읽습니다.\n```\n코드다.\n```\n"), (2, "서버가  느립니다. 데이터 12개를 읽습니다."), (3, "데이터 7개를 읽습니다. 말줄임"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = {r.sentence: (r.documents, r.id.doc_id) for r in u.index_sentences(d).collect()}
    assert s == {"서버가 느립니다.": (2, 1), "데이터를 읽습니다.": (1, 1), "데이터 12개를 읽습니다.": (2, 2)}
    u.build(d, str(tmp_path / "ix"))
    ix = u.Index(spark, str(tmp_path / "ix"))
    assert ix.lookup("데이터") == ("데이터", 2) and ix.lookup("없다") is None
    hits = ix.search("서버", 5).collect()
    assert [h.sentence for h in hits] == ["서버가 느립니다."]
    n, df, tf, length = 3, 1, 1, len(["서버", "느립니다", "느립", "립니", "니다"])
    mean = sum(r["length"] for r in ix.sentences.collect()) / 3
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
    assert abs(hits[0].score - want * 1e6) <= 1
    got = {(r.side, r.word, r.documents) for r in u.neighbours(d, "데이터").collect()}
    assert ("after", "읽습니다", 1) in got and ("before", "느립니다", 2) in got
    chains = u.chain_documents(d, 3, 2)
    assert u.attested(spark.createDataFrame([("서버가 느립니다",), ("x y",)], "chain string"), chains, 2).filter("attested").count() == 1
