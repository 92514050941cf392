from pyspark.sql import functions as F

from proselake.operators import edits as e
from proselake.operators.document_rules import passive_pattern, section_at
from proselake.operators.structure import blocks_with_language
from proselake.sources import literals as s
from proselake.sources.readers import read_documents

A = "## 가\n\nSee `x` at https://a.b/c and 1,200 items. Plain line.\n\n## 나\n\nOnly 7 here [l](t.md)."


def test_surface(spark):
    d = spark.createDataFrame([(1, A, A.replace("1,200", "1200").replace("`x`", "`y`"))], "doc_id long, a string, b string")
    got = d.select(e.surface_diff(F.col("a"), F.col("b")).alias("x")).first().x
    assert [(r.kind, r.lost, r.gained) for r in got] == [("code", ["x"], ["y"])]
    assert e.fact_lines(A) == [A.split("\n")[2], A.split("\n")[6]]
    assert e.check(A, e.contract_from(A)) == []
    bad = e.check(A.replace("Only 7", "Only 8").replace("## 나", "## 다"), e.contract_from(A))
    assert [v[0] for v in bad] == ["lost", "added", "heading", "fact"]
    v = d.select(e.violations("a", "b").alias("v")).first().v
    assert [(x.kind, x.was, x.now) for x in v][:2] == [("lost", "code:x", ""), ("added", "", "code:y")]


def test_alignment(spark):
    assert e.align(["a", "b", "c"], ["a", "x", "y", "c"]) == [("b", ["x", "y"])]
    d = spark.createDataFrame([(1, "One. Bad here. Three.", "One. Good here. Three."), (2, "Same.", "Same.")], "doc_id long, before string, after string")
    assert [tuple(r) for r in e.changed_pairs(d).collect()] == [(1, "Bad here.", ["Good here."])]
    f = spark.createDataFrame([(1, "r", "Bad here."), (1, "q", "Good here.")], "doc_id long, rule string, quote string")
    assert [tuple(r) for r in e.learnt_examples(d, f, f.filter("rule = 'q'")).collect()] == [(1, "r", "Bad here.", "Good here.")]


def test_operations():
    assert e.operation_from("we utilize it", "we use it") == ("utilize", "use")
    assert e.operation_from("buy 7 now", "buy 8 now") is None and e.operation_from("a a", "a b") is None
    assert e.apply_operation("they utilize it", "utilize", "use") == "they use it"
    assert e.apply_operation("utilizes `utilize`", "utilize", "use") is None
    assert e.apply_fixes("one bad\n\nbad bad\n\nxx", [(1, "bad", "good"), (3, "bad", "good")]) == ("one good\n\nbad bad\n\nxx", 1, 1)
    assert e.apply_fixes("리소스를 본다", [(1, "리소스", "책")])[0] == "책을 본다"
    find = lambda t: [("r", x) for x in t.split() if x == "bad"]
    assert e.verify_patch("a bad b", "bad", "good", find, "r") == (True, [])
    assert e.verify_patch("bad bad", "bad", "good", find, "r")[0] is False
    assert e.edit_issues("a\nb\nc", "b", "x", [2], 5, 1) == [] and len(e.edit_issues("a\nb\nc", "b\nc", "x" * 9, [1], 5, 1)) == 3


def test_fix_documents(spark):
    d = spark.createDataFrame([(1, "a bad day"), (2, None)], "doc_id long, text string")
    f = spark.createDataFrame([(1, 1, "bad", "good")], "doc_id long, line int, fragment string, replacement string")
    assert sorted(map(tuple, e.fix_documents(d, f).collect())) == [(1, "a good day", 1, 0), (2, "", 0, 0)]


def test_outline_and_places(spark):
    h = spark.createDataFrame([(1, 1, 2, "a"), (1, 5, 2, "b")], "doc_id long, line int, level int, title string")
    g = spark.createDataFrame([(1, 1, 2, "a"), (1, 4, 2, "c"), (1, 9, 2, "d")], "doc_id long, line int, level int, title string")
    assert [r.status for r in e.outline_diff(h, g).orderBy("place").collect()] == ["same", "changed", "added"]
    b = blocks_with_language(spark.createDataFrame([(1, "x\n\n## s\n\ny\nz\n")], "doc_id long, text string"))
    lines = spark.createDataFrame([(1, 1), (1, 4), (1, 6)], "doc_id long, line int")
    assert [(r.line, r.section_index, r.block_index) for r in section_at(lines, b).orderBy("line").collect()] == [(1, 0, 0), (4, 1, 1), (6, 1, 2)]
    assert [(r.line, r.raw) for r in e.raw_sentences(b).orderBy("line").collect()] == [(1, "x"), (5, "y\nz")]
    assert "보여지" not in passive_pattern(["보이"]) and "보여" in passive_pattern(["보이"])


def test_literals(spark):
    src = "// 주석 '아니다'\nconst a = '저장했습니다';\nconsole.log('개발용 글');\nreturn <p>이름 <b>{x}</b></p>;\nconst t = `값 ${f('안')} 끝`;\n"
    got = s.source_literals(src)
    assert [(line, text, plain) for line, _, text, plain in got] == [(2, "저장했습니다", "저장했습니다"), (4, "이름", "이름"), (5, "값 ${f('안')} 끝", "값 끝")]
    line, column, old, _ = got[0]
    assert s.write_back(src, [(line, column, old, "저장함")]) == (src.replace("저장했습니다", "저장함"), 1)
    assert s.literal_rows(spark.createDataFrame([(1, src), (2, None)], "doc_id long, text string")).count() == 3
    row = s.sheet(spark.createDataFrame([(1, "a:1", "dash", "x|y\\", None)], "doc_id long, place string, rules string, text string, fix string")).first().row
    assert s.split_row(row) == ["a:1", "dash", "x|y\\", ""] and s.split_row("|--|:--|") is None and s.split_row("text") is None


def test_wiki(spark, tmp_path):
    text = "{{box|{{in}}}}'''Name''' is [[link|shown]]<ref>x</ref> [[File:a.png|b [[c]]]].\n== Part ==\n* item\n[[Category:x]]\n== References ==\nend"
    assert s.normalize_wikitext(text) == "Name is shown .\n## Part\n- item"
    (tmp_path / "d.xml").write_text(f"<m><page><title>T</title><ns>0</ns><revision><text>{text.replace('<', '&lt;')}</text></revision></page><page><title>R</title><ns>0</ns><redirect title='T'/><revision><text>x</text></revision></page><page><title>U</title><ns>4</ns><revision><text>y</text></revision></page></m>")
    assert [(r.source, r.text[:4]) for r in s.wiki_pages(spark, str(tmp_path / "d.xml")).collect()] == [("T", "Name")]
    (tmp_path / "v.tsv").write_text("배1\tA\n배2\tC\n말\tC\n")
    words = s.vocabulary(spark, str(tmp_path / "v.tsv"))
    assert {(r.lexeme, tuple(r.grades)) for r in words.collect()} == {("배", ("A", "C")), ("말", ("C",))}
    topics = spark.createDataFrame([(1, 4, "말"), (1, 2, "말"), (1, 1, "배")], "doc_id long, pos int, topic string")
    assert [tuple(r) for r in s.graded_terms(topics, words, "C").collect()] == [(1, "말", 2)]
    (tmp_path / "a.markdown").write_text("m")
    (tmp_path / "b.py").write_text("x = '가'")
    assert read_documents(spark, str(tmp_path)).count() == 1 and s.source_files(spark, str(tmp_path)).count() == 1
