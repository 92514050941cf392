"""Every link counts, also inside a component and between blocks."""

import re

import pytest
from test_edges import brute_jaccard, corpus, frame, words

from proselake.llm import jaccard_join


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    return {a: sum(a != b and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}


@pytest.mark.parametrize(("seed", "block", "expanded"), [(1, 1 << 18, 1 << 22), (2, 60, 50)])
def test_links(spark, monkeypatch, seed, block, expanded):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "EXPANDED", expanded)
    rows = corpus(seed)
    base = [f"w{i}" for i in range(100)]
    rows += [(1000 + i, " ".join(base[: 60 + i] + [f"x{i}"] * (i % 3 == 0))) for i in range(40)]  # a chain: one component, not all pairs link
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_links(frame(spark, rows)).collect()}
    links = brute_links(rows)
    assert got == {i: (*x, links[i]) for i, x in brute_jaccard(rows).items()}
    assert max(links.values()) > 10


def test_repeated_and_null_ids(spark):
    some = frame(spark, [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, "A b"), (3, "")])
    assert sorted((r.doc_id or 0, r.n_links) for r in jaccard_join.jaccard_links(some).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]
    assert jaccard_join.jaccard_links(frame(spark, [])).count() == 0
