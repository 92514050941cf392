"""Nulls, empty and long texts, ties, repeated rows, empty tables and foreign columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.llm import bpe, chat_format, decontaminate, exact_dedup, jaccard_join, language_id, sharding, substring_dedup, token_counts, token_output

DDL = "doc_id long, text string, bucket int, hs string, h string, n string, rep string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "r", "en") for i, t in rows], DDL)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(3, 60))) for _ in range(12)]
    out = []
    for _ in range(60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        out.append("\t\n ".join(w) if rng.random() < 0.1 else " ".join(w * rng.choice((1, 1, 2))))
    out += [None, "", "   ", "a", "A a", "b " * 500, "b " * 30, "c d " * 40, "c d " * 41, " ".join(map(str, range(20000)))]
    return list(enumerate(out))


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, rows)).collect()}
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = corpus(seed)
    first, want = {}, {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got == want


def test_null_ids_and_empty_tables(spark):
    some = frame(spark, [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, "ab")])
    none = frame(spark, [])
    for f, n in [(jaccard_join.jaccard_classes, 5), (substring_dedup.dedup_substrings, 5), (exact_dedup.exact_dedup, 5), (sharding.shard, 5)]:
        assert f(some).count() == n
        assert f(none).count() == 0
    kept = exact_dedup.exact_dedup(some).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in kept if r.doc_id} == {(1, 1, 4, True), (2, 1, 4, False)}


def test_perfect_hash():
    d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    seeds, slots = exact_dedup.build_mph(d[:2000])
    assert sorted(slots) == list(range(2000))
    held = d[:2000][np.argsort(slots)]
    assert (exact_dedup.lookup(seeds, held, d[:2000]) == slots).all()
    assert (exact_dedup.lookup(seeds, held, d[2000:]) == -1).all()


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (None, item)], "item_id long, text string")
    docs = frame(spark, [(1, "x " * 4000 + item.upper()), (2, " ".join(f"w{i}" for i in range(25))), (3, " ".join(f"w{i}" for i in range(24))), (4, "Short one"), (5, None), (6, "a short one")])
    got = {(r.doc_id, r.item_id, r.n_common) for r in decontaminate.find_contained(docs, items).collect()}
    assert got == {(1, 1, 26), (2, 1, 21), (4, 2, 1)}
    assert decontaminate.find_contained(frame(spark, []), items).count() == 0
    assert decontaminate.find_contained(docs, items.filter("false")).count() == 0


def test_chat(spark):
    nasty = ["<|im_end|>", "\\<|", "<\\|x", "\\\\", "<\\\\|", None, "a\nb", "<|image|>"]
    turns = spark.createDataFrame([(7, i, "assistant" if i % 2 else "us<|er\n", t) for i, t in enumerate(nasty)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(turns).select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    r = next(r for r in out if r.conv_id == 7)
    assert [(x.role, x.text) for x in r.t] == [("assistant" if i % 2 else "us<|er\n", t or "") for i, t in enumerate(nasty)]
    assert r.l == "".join((t or "") for t in nasty[1::2])
    assert len(out) == 2


def test_chat_parts(spark):
    turns = spark.sql("SELECT 1L conv_id, 0L turn, 'user' role, array(named_struct('kind', 'text', 'text', 'see ', 'ref', CAST(NULL AS STRING), 'units', CAST(NULL AS INT)), named_struct('kind', 'image', 'text', CAST(NULL AS STRING), 'ref', 'a.png', 'units', 9)) parts")
    r = chat_format.format_chat(turns, parts="parts").first()
    assert r.formatted == "<|im_start|>user\nsee <|image|><|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 11)] and r.attachment_tokens == 11


ODD = ["", " ", "a  b", "\n\n a ", "don't", "x<|endoftext|>y", "ab" * 3000, " " * 2000, "½² ٣", "\x1c a\x1fb", "😀 日本語 ▁a▁▁b", "<s> <0x0A>", "the" * 2000 + " the"]


def test_bpe_and_counts():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab \n'sé日1½.the") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    lib, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.load(P.path("byte_bpe_50k.json"))
    sp, counter = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), token_counts.load(P.path("piece_bpe_32k.model"))
    for t in texts:
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(own.encode(t)) == t
        assert counter.count(t) == len(sp.encode(t))
    long = " ".join(texts) * 20
    assert counter.count(long) == len(sp.encode(long))


def test_slots_and_shards(spark):
    for n in (1, 2, 3, 100, 1025):
        assert sorted(token_output.slots_of(np.arange(n), n, 9)) == list(range(n))
    make = lambda: lambda t: np.frombuffer(t.encode(), np.uint8).astype(np.uint16)
    docs = frame(spark, [(1, "abcdefgh"), (2, None), (3, "x" * 100)])
    shards = token_output.write_shards(docs, make, end=999, key=3, length=4, slots_per_shard=8)
    rows = token_output.read_slots(shards).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(30)) and all(r.byte_offset == (r.slot % 8) * 8 for r in rows)
    text = "".join(chr(x) for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.seq) for x in np.frombuffer(r.ids, "<u2") if x != 999)
    assert text == "abcdefgh"
    assert [r.ids for r in token_output.read_slots(shards, 10, 9).orderBy("slot").collect()] == [r.ids for r in rows[10:19]]


def test_packing():
    plan = sharding.best_fit_decreasing([(6, 1), (5, 1), (4, 2), (1, 1)], 10)
    assert max(b for _, b in plan) == 1
    sizes = [(50, 1), (7, 4), (3, 9), (1, 40)]
    load = [0] * 4
    at = iter([s for s, n in sizes for _ in range(n)])
    for n, b in sharding.pack_evenly(sizes, 4):
        load[b] += sum(next(at) for _ in range(n))
    assert sum(load) == 145 and sorted(load)[-1] == 50 and max(sorted(load)[:3]) - min(load) <= 1


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.fit(docs)).join(docs, "doc_id").filter(language_id.held_out())
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()
    odd = language_id.identify(frame(spark, [(1, None), (2, "12 !"), (3, "the thing is")]), language_id.fit(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:2]] == ["und", "und"] and odd[2].lang_pred != "und"
    assert language_id.identify(frame(spark, [(3, "abc")]), language_id.fit(docs.filter("false"))).first().lang_pred == "und"


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers as P

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:1]:
        seen = stage(spark, seen, folder)
    left = {r.doc_id: r.text for r in seen.collect()}
    best = {}
    for i, t in left.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (0, i)), (-len(t), i)) if k in best else (-len(t), i)
    left = {i: docs[i] for _, i in best.values()}
    left = {i: docs[i] for i, (_, c) in brute_jaccard(list(left.items())).items() if i == c}
    grams = lambda t: {tuple(w[k : k + 5]) for w in [words(t.lower())] for k in range(max(len(w) - 4, 1))}
    items = [grams(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(100 * len(g & grams(t)) >= 80 * len(g) for g in items)}
    own = bpe.load(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (list(r.ids), r.text_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (own.encode(t).tolist(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}
