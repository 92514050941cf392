from proselake.functions.hangul import fit_particle, join_syllable, split_syllable
from proselake.functions.text import sentences
from proselake.sources.markdown import add_sections, blocks_of, front_matter, parse_markdown
from proselake.sources.readers import read_documents


def test_syllables():
    assert split_syllable("한") == (18, 0, 4)
    assert join_syllable(*split_syllable("글")) == "글"


def test_particles():
    assert fit_particle("책", "를") == "을"
    assert fit_particle("나무", "을") == "를"
    assert fit_particle("서울", "으로") == "로"
    assert fit_particle("abc", "은") == "은"


def test_sentences_keep_abbreviations(spark):
    d = spark.createDataFrame([(1, "By J. R. Smith. Next one! Last"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.sentence) for r in sentences(d).orderBy("doc_id", "pos").collect()] == [(1, 0, "By J. R. Smith."), (1, 1, "Next one!"), (1, 2, "Last")]


def test_markdown_blocks(spark):
    text = "---\ntitle: x\n---\nintro\nmore\n\n## One\n- a\n- b\n\n```py\n## no heading\n```\n"
    assert front_matter(text.split("\n")) == ({"title": "x"}, 3)
    assert [(k, a, b, level) for k, a, b, level, _ in blocks_of(text)] == [("prose", 4, 5, 0), ("heading", 7, 7, 2), ("list", 8, 9, 0), ("code", 11, 13, 0)]
    got = add_sections(parse_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("block_index").collect()
    assert [r.section_index for r in got] == [0, 1, 1, 1]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo")
    (tmp_path / "y.jsonl").write_text('{"source": "s", "text": "t"}\n')
    assert [r.text for r in read_documents(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    assert [tuple(r) for r in read_documents(spark, str(tmp_path), "jsonl").collect()] == [("s", "t")]


def test_stream(spark, tmp_path):
    from proselake.streaming.lint import stream_findings

    spark.createDataFrame([(1, "word " * 40, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream_findings(spark, str(tmp_path / "in"), "doc_id long, text string, lang string", lambda df, n: seen.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [(r.doc_id, r.words) for r in seen] == [(1, 40)]
