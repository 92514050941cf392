import pytest
from pyspark.sql import functions as F

from proselake.operators import findings as f
from proselake.operators import statistics as st
from proselake.operators.lexicon import Entry

TEXT = "## 가\n\n이어서 간다. 리소스다.\n\n<!-- lint-disable fillerOpener -->\n\n이어서 온다.\n\n<!-- lint-enable -->\n\n이어서 본다 – 끝.\n\n<!-- lint-disable-next -->\n\n이어서 쓴다.\n\n이어서 판다.\n"
ENTRIES = [Entry("easyWords", "리소스", fix="자원", why="a plainer word")]


def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")


def test_lint(spark):
    got = sorted((r.rule, r.line) for r in f.lint(docs(spark), entries=ENTRIES).collect() if r.rule in ("fillerOpener", "hardWord", "dash"))
    assert got == [("dash", 11), ("fillerOpener", 3), ("fillerOpener", 11), ("fillerOpener", 17), ("hardWord", 3)]
    off = f.lint(docs(spark), f.Config(disable=frozenset({"dash"}), preset="web", presets={"web": frozenset({"fillerOpener", "hardWord"})}, enforce=frozenset({"hardWord"}), severity="error"), ENTRIES).collect()
    assert {r.rule for r in off} & {"dash", "fillerOpener", "hardWord"} == {"hardWord"}
    hard = next(r for r in off if r.rule == "hardWord")
    assert (hard.scope, hard.mechanism, hard.why, hard.fragment, hard.fix) == ("sentence", "dictionary", "a plainer word", "리소스", "자원이다.") or hard.fix == "자원다."


def test_config(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "x.toml").write_text('disable = ["dash"]\npreset = "p"\n[presets]\np = ["deixis"]\n')
    c = f.load_config(f.find_config(tmp_path / "a", "x.toml"))
    assert not c.enabled("dash") and not c.enabled("deixis") and c.enabled("spelling")
    with pytest.raises(ValueError, match="headingSkip"):
        f.Config(disable=frozenset({"headingskip"}))
    with pytest.raises(ValueError):
        f.Config(preset="none")
    assert f.near_names("scr") == ["screenNarration", "screenSentence", "screenTone"]


def some(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, rule string, severity string, line int, quote string").withColumn("scope", F.lit("sentence")).withColumn("mechanism", F.when(F.col("rule") == "deixis", "reader"))


def test_baselines_and_reports(spark):
    found = some(spark, [(1, "dash", "error", 2, "a  b"), (1, "dash", "error", 2, "c%"), (1, "deixis", "notice", 2, "x"), (2, "dash", "notice", 1, "q")])
    lock = f.baseline_of(found)
    assert lock.count() == 4 and ("a b",) in {tuple(r) for r in lock.select("quote").collect()}
    later = found.filter("quote <> 'c%' and doc_id = 1")
    assert sorted(r.quote for r in f.prune(lock, later, later).collect()) == ["a b", "q", "x"]
    assert {r.rule for r in f.worst(found).filter("doc_id = 1").collect()} == {"dash"} and f.worst(found).count() == 2
    assert {tuple(r) for r in f.summary(found).collect()} == {(1, 2, 1, "dash"), (2, 0, 1, "dash")}
    assert f.reader_debts(found).count() == 1
    assert f.as_annotations(found, F.lit("a.md")).filter("doc_id = 1").collect()[1].annotation == "::error file=a.md,line=2::dash: c%25"
    assert f.as_text(found).filter("doc_id = 2").first().report == "1: notice [dash] q"
    assert '"rule":"dash"' in f.as_json(found).first().json and f.baseline_json(lock).count() == 2


def test_reviews(spark):
    d = spark.createDataFrame([(1, "first line here\nsecond part\nof the text\n\nlast")], "doc_id long, text string")
    reviews = spark.createDataFrame([(1, "second  part", "a"), (1, "part of the text", "a"), (1, "last", "b"), (1, "nowhere to see", "b")], "doc_id long, quote string, kind string")
    got = {r.quote: (r.line, r.covered, r.by_error) for r in f.review_coverage(d, reviews, some(spark, [(1, "dash", "error", 3, "x")])).collect()}
    assert got == {"second  part": (2, True, True), "part of the text": (2, True, True), "last": (None, False, False), "nowhere to see": (None, False, False)}


def test_classification(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None), ("b", "b")], "gold string, predicted string")
    got = {r["class"]: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in st.classification(rows).collect()}
    assert got == {"a": (1, 0, 1, 1.0, 0.5), "b": (2, 1, 0, 2 / 3, 1.0), "c": (0, 0, 1, None, 0.0)}
    m = st.macro(rows).first()
    assert (m.cases, m.answered, m.accuracy) == (5, 4, 0.75) and abs(m.macro_f1 - (2 / 3 + 0.8 + 0) / 3) < 1e-12


def test_alpha_and_consensus(spark):
    # by hand: units 1 (a, a, b), 2 (b, b), 3 (a) which does not count
    r = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, "a"), (2, None)], "unit long, value string")
    a = st.nominal_alpha(r).first()
    assert a.pairs == 5 and abs(a.observed - 2 / 5) < 1e-12 and abs(a.expected - 12 / 20) < 1e-12 and abs(a.alpha - 1 / 3) < 1e-12
    assert {tuple(x) for x in st.consensus(r, ["a", "b"], 2).collect()} == {(1, 3, "a"), (2, 2, "b"), (3, 1, "noConsensus")}


def test_calibration(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.95, 0), (0.2, 0)], "c double, ok int")
    assert {(r.bin, r.n) for r in st.calibration(rows, "c", "ok").collect()} == {(9, 2), (2, 1)}
    e = st.calibration_error(rows, "c", "ok").first()
    assert abs(e.ece - (2 * 0.475 + 0.2) / 3) < 1e-12 and abs(e.brier - (0.95**2 + 0.04) / 3) < 1e-12
    assert [(r.covered, r.risk) for r in st.risk_coverage(rows, "c", "ok").orderBy("covered").collect()] == [(1, 0.0), (2, 0.5), (3, 2 / 3)]


def test_trials(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("tie", "y"), (None, "y"), ("a", "y")], "choice string, genre string")
    assert {(r.genre, r.n, r.share) for r in st.preferences(rows, "choice", "genre").collect()} == {("x", 2, 0.5), ("y", 2, 0.75), (None, 4, 0.625)}
    b = st.bootstrap_mean(spark.range(200).select(F.lit("g").alias("g"), (F.col("id") % 2).alias("v")), "g", "v", seed=1).first()
    assert b.n == 200 and b.mean == 0.5 and 0.42 < b.low < 0.45 and 0.55 < b.high < 0.58
    sides = st.balanced_sides(spark.range(101), "id", 4).groupBy("left").count().collect()
    assert sorted(r["count"] for r in sides) == [50, 51]
    cases = st.judge_cases(spark.createDataFrame([(1, "p", "q")], "case_id long, a string, b string")).orderBy("order").collect()
    assert [(c.first, c.second) for c in cases] == [("p", "q"), ("q", "p")]
    judged = spark.createDataFrame([(1, "forward", "first"), (1, "reversed", "second"), (2, "forward", "first"), (2, "reversed", "first")], "case_id long, order string, winner string")
    assert {tuple(r) for r in st.pair_decisions(judged).collect()} == {(1, "a", True), (2, "tie", False)}
    assert st.stable_digest({"b": 1, "a": "é"}) == st.stable_digest({"a": "é", "b": 1})
    assert [r.id for r in st.evenly(spark.range(10), ["id"], 3).orderBy("id").collect()] == [0, 4, 7]
    assert tuple(st.percentile_rank(spark.range(11), [], "id").first()) == (1, 2, 5, 8, 9)
    assert {tuple(r) for r in st.results_summary(rows, "choice", "genre").filter("dimension = 'genre'").collect()} == {("genre", "x", 2), ("genre", "y", 3)}
