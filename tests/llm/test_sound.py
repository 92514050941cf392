"""Words built to collide under polynomial hashes stay apart."""

import numpy as np
import pyarrow as pa
import pytest

from proselake.llm import _words, jaccard_join, substring_dedup


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
@pytest.mark.parametrize("swap", [False, True])
def test_thue_morse(spark, n, swap):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    x, y = (y, x) if swap else (x, y)
    docs = spark.createDataFrame([(1, x), (2, y), (3, " ".join([x] * 13)), (4, " ".join([y] * 13))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_long_words_and_secrets():
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("ab"), 200_000))
    texts = pa.array([long, long[:-1] + "c", long, "c" + long[1:], "B", "b"])
    (s,) = [*_words.slices(texts, lower=True, secret=5, lanes=2)] if len(long) * 4 < _words.SLICE else [None]
    assert s.word[0] == s.word[2] and len(set(s.word[:4].tolist())) == 3 and s.word[4] == s.word[5]
    assert s.other[0] == s.other[2] and not set(s.word.tolist()) & set(s.other.tolist())
    (t,) = _words.slices(texts, lower=True, secret=6)
    assert not set(s.word.tolist()) & set(t.word.tolist())
