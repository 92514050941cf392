import pytest

from proselake.operators import document_rules  # noqa: F401
from proselake.operators.structure import RULES, findings, without_baseline
from proselake.plans.samples import CASES, CODE

def test_every_rule_has_a_case():
    assert set(CASES) == set(RULES)


@pytest.fixture(scope="module")
def found(spark):
    names = sorted(CASES)
    rows = [(2 * i + side, CASES[n][2 * side]) for i, n in enumerate(names) for side in (0, 1)] + [(1000, None), (1001, "")]
    got = {}
    for r in findings(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.rule), []).append(r.line)
    return names, got


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(found, name):
    names, got = found
    i = names.index(name)
    assert sorted(got.get((2 * i, name), [])) == CASES[name][1]
    assert (2 * i + 1, name) not in got
    assert not any(doc >= 1000 for doc, _ in got)


def test_baseline_locks_quotes(spark):
    docs = spark.createDataFrame([(1, "a – b\nc  – d\n")], "doc_id long, text string")
    f = findings(docs, ["dash"])
    lock = spark.createDataFrame([(1, "dash", "c – d")], "doc_id long, rule string, quote string")
    assert [(r.line, r.quote) for r in without_baseline(f, lock).collect()] == [(1, "a – b")]


def test_front_matter_title_is_level_one(spark):
    docs = spark.createDataFrame([(1, "---\ntitle: x\n---\n### deep\n"), (2, "---\nname: x\n---\n### deep\n")], "doc_id long, text string")
    assert [(r.doc_id, r.line) for r in findings(docs, ["headingSkip"]).collect()] == [(1, 4)]


def test_lines_inside_paragraphs(spark):
    docs = spark.createDataFrame([(1, "하나. 둘.\n셋이다.  \n가지 않을 수\n없다. 끝\n\n가지 않을 수 없다.")], "doc_id long, text string")
    assert sorted(r.line for r in findings(docs, ["doubleNegative"]).collect()) == [6]
    docs = spark.createDataFrame([(1, "U.S. law.\n\n다.\n이어서 간다.\n마지막으로 간다.")], "doc_id long, text string")
    assert sorted(r.line for r in findings(docs, ["fillerOpener"]).collect()) == [4, 5]


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "## 만들기\n\n## 지우기\n\n## 고치기\n"), (2, "![a](b)\n\n![c](d)\n\n## s\n\nx\n"), (3, f"{CODE}\n\ntext\n\n{CODE}\n")], "doc_id long, text string")
    got = {r.doc_id: r.quote for r in findings(docs, ["headingUniform", "introImage", "duplicateBlock"]).collect()}
    assert got == {1: "만들기, 지우기, 고치기", 2: "![a](b)", 3: "a = 1"}
