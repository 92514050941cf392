from proselake.operators import prose


def test_every_span_of_a_sentence(spark, monkeypatch):
    monkeypatch.setattr(prose, "LEXICON", [("license", "a"), ("of the", "b"), ("the", "c"), ("license", "d")])
    docs = spark.createDataFrame([(1, "Of the license, the other of the LICENSE. Nothing here."), (2, None)], "doc_id long, text string")
    got = sorted((r.pos, r.start_at, r.end_at, r.ord) for r in prose.override_spans(docs).collect())
    text = "of the license, the other of the license."
    assert [text[a:b] for _, a, b, _ in got] == ["of the", "the", "license", "the", "of the", "the", "license"]
    assert got == [(0, 0, 6, 1), (0, 3, 6, 2), (0, 7, 14, 3), (0, 16, 19, 2), (0, 26, 32, 1), (0, 29, 32, 2), (0, 33, 40, 3)]
    assert [(r.doc_id, r.pos, r.start_at, r.end_at, r.ord) for r in prose.earliest_match(docs).collect()] == [(1, 0, 0, 6, 1)]
