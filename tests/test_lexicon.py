from proselake.functions import spans, tokens
from proselake.operators import lexicon
from proselake.operators.lexicon import Entry
from proselake.operators.structure import blocks_with_language, prose_sentences
from pyspark.sql import functions as F


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_plain_text_and_spans(spark):
    raw = "See **bold** and `a  b` or [link](http://x)  here *now*"
    assert one(spark, spans.plain_text, raw) == spans.plain(raw) == "See bold and a b or link here now"
    flat = spans.plain(raw)
    assert [flat[a:b] for a, b in spans.code_spans(raw, flat)] == ["a b"]
    assert [raw_[a:b] for raw_ in ['he “said” "x y" so'] for a, b in spans.quote_spans(raw_)] == ["said", "x y"]
    assert spans.inside_any((2, 3), [(1, 4)]) and not spans.inside_any((0, 3), [(1, 4)]) and spans.overlaps_any((0, 3), [(2, 4)])
    assert spans.occurrences("aaa", "aa") == [(0, 2), (1, 3)]
    assert spans.changed_span("the cat sat", "the dog sat") == ("cat", "dog") and spans.changed_span("aa", "aaa") == ("", "a")
    assert spans.promised_counts("세 가지가 있고 2 단계와 3단계") == [(3, "가지", "세 가지"), (2, "단계", "2 단계")]
    assert spans.tab_width("  \tx") == 4 and spans.spans_within([(2, 6)], 4, 9) == [(0, 2)]
    assert one(spark, spans.canonical_number, "01,230.500") == "1230.5"


def test_words(spark):
    assert [tuple(w) for w in one(spark, tokens.words, "서울에서, (책을) 3개")] == [("서울에서", True, False, True), ("책을", True, True, True), ("3개", False, False, False)]
    assert one(spark, tokens.topics, "서버에서 데이터를 읽고 Spark는 빠르다. 이 것") == ["spark", "데이터", "서버"]
    assert one(spark, lambda c: tokens.longest_noun_run(c, ["직접"]), "서버 로그 수집 3 오류 파일을 직접 본다") == 4
    assert one(spark, tokens.register_of, "비가 옵니다.") == "합니다" and one(spark, tokens.register_of, "비가 온다") == "한다" and one(spark, tokens.register_of, "abc") is None
    assert one(spark, tokens.index_tokens, "데이터를 Read-only") == ["데이터", "데이", "이터", "read", "only"]
    assert one(spark, tokens.sentence_key, " a  12b 3 ") == "a 0b 0"
    assert one(spark, tokens.query_cores, "데이터는 데이터가 a 책을") == ["데이터"]
    d = spark.createDataFrame([(1, "온다."), (1, "갑니다."), (1, "간다."), (2, "가요"), (3, "x")], "doc_id long, sentence string")
    assert sorted(map(tuple, tokens.document_register(d).select("doc_id", "register").collect())) == [(1, "섞임"), (2, "해요"), (3, "없음")]


ENTRIES = [
    Entry("spelling", "됬", fix="됐", why="short form"),
    Entry("spelling", "(할{ㄹ}?)께", fix="$1게"),
    Entry("easyWords", "리소스", fix="자원", keep="리소스 팩"),
    Entry("easyWords", "utili[sz]e[sd]?", fix="use", unless="never"),
    Entry("cliches", "시간이 금이다", to=(("시간이 금이다", "시간은 귀하다"),)),
]


def test_matching(spark):
    assert lexicon.needed_literal("됬") == "됬" and lexicon.needed_literal("ab?c") in ("a", "c") and lexicon.needed_literal("ab|cd") == ""
    rows = spark.createDataFrame([(1, "잘 됬다 리소스를 쓴다"), (2, "리소스 팩"), (3, "we never utilize it"), (4, "we utilized it"), (5, None)], "id long, sentence string")
    got = sorted((r.id, r.matched, r.fix, r.start_at) for r in lexicon.match_entries(rows, ENTRIES).collect())
    assert got == [(1, "됬", "됐", 2), (1, "리소스", "자원", 5), (4, "utilized", "use", 3)]


def test_findings(spark):
    text = "첫 줄이다.\n둘째는\n리소스를 본다. `리소스`와 “리소스”는 남는다.\n\n시간이 금이다."
    blocks = blocks_with_language(spark.createDataFrame([(7, text)], "doc_id long, text string"))
    got = sorted((r.rule, r.line, r.fix) for r in lexicon.lexicon_findings(prose_sentences(blocks), ENTRIES).collect())
    assert got == [("cliche", 5, "시간은 귀하다."), ("hardWord", 3, "둘째는\n자원을 본다.")]


def test_overrides(spark):
    rows = spark.createDataFrame([(1, "a big cat")], "id long, sentence string")
    both = [Entry("x", "big"), Entry("x", "big cat"), Entry("x", "big", fix="large")]
    found = lexicon.match_entries(rows, both)
    assert sorted(r.ord for r in lexicon.last_per_span(found, ["id"]).collect()) == [1, 2]
    assert lexicon.first_per_text(found, ["id"]).first().ord == 0


def test_lexicon_files(tmp_path):
    (tmp_path / "a.toml").write_text("[[entry]]\npattern = 'x'\nfix = 'y'\n[[entry]]\npattern = 'z'\nunless = 'q'\n")
    (tmp_path / "b.txt").write_text("# note\none\n\ntwo\n")
    got = lexicon.load_lexicons(tmp_path, ["a", "b"], [{"dictionary": "c", "pattern": "p"}])
    assert [(e.dictionary, e.pattern) for e in got] == [("a", "x"), ("a", "z"), ("b", "one"), ("b", "two"), ("c", "p")]
    try:
        lexicon.load_lexicons(tmp_path, ["none"])
    except ValueError:
        return
    raise AssertionError
