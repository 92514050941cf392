"""Token operators over tables against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest

from proselake.llm import bpe, token_counts

ROWS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y z"), (4, "the " * 3000), (5, "ab" * 4000), (6, " " * 3000), (7, "é日本 " * 500 + "<|endoftext|>" + " don't"), (8, "a  b\n\n c" * 700), (9, "▁ ▁a" * 900)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 5) for i, t in rows], "doc_id long, text string, ids string, row string, n_bytes int")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    more = ["".join(rng.choice(["a", "b", " ", "\n", "'", "s", "é", "日", "1", ".", "the", "ing", "  ", "▁"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    return ROWS + list(enumerate(more, 20))


def test_bpe_over_a_table(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    want = sorted((i or -1, ids(t), lib.decode(ids(t), skip_special_tokens=False)) for i, t in texts)
    out = bpe.encode(frame(spark, texts), path, decoded=True)
    assert sorted((r.doc_id or -1, list(r.ids), r.decoded) for r in out.collect()) == want
    apart = bpe.decode(bpe.encode(frame(spark, texts), path), path)
    assert sorted((r.doc_id or -1, r.decoded) for r in apart.collect()) == [(i, d) for i, _, d in want]
    assert bpe.encode(frame(spark, []), path, decoded=True).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls, path).collect()] == ["", ""]


def test_pieces_of_long_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(2)
    for text in ["word " * 30_000, " " * 70_000, "x" * 70_000, "".join(rng.choice(["ab ", "\n", "  c", "é"]) for _ in range(60_000))]:
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_counts_over_a_table(spark, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i or -1, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 700) for i, t in texts)
    for long, chunk in ((1 << 16, 1 << 15), (200, 7), (900, 128)):
        out = token_counts.count_tokens(frame(spark, texts), path, limit=700, long=long, chunk=chunk)
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_short_words_run_through_the_table():
    machine = token_counts.Transducer(P.path("piece_bpe_32k.model"))
    assert not machine.states
    n = machine.count("hello worlds")
    assert machine.states and machine.start[" "][0]["h"][0].open
    machine.merges = None  # nothing is merged again: the transitions hold the counts
    assert machine.count("hello worlds") == n


def test_queries_against_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    lib, sp = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {tuple(r) for r in bpe.op1_bpe(spark, folder).collect()}
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    assert got == {(i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    got = {tuple(r) for r in token_counts.op6_token_counts(spark, folder).collect()}
    assert got == {(i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in docs.items()}


def test_short_words_side_by_side():
    coder = bpe.ByteBpe(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "e", "qu", "é", "日", "1", "ss", "tion", "'", "\n", "\0"]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    ids, ends = coder.side_by_side.merged([w.encode() for w in words])
    assert [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [[*coder.word(w)] for w in words]
    text = " ".join(words) + "  end \x1c x \n"
    plain = [*bpe.ByteBpe(P.path("byte_bpe_50k.json")).encode(text)]
    coder.learn([text, "", " ", "a  b"])
    assert [*coder.encode(text)] == plain
