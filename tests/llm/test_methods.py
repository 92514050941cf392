"""The dealt methods decide the results: taken out, these tests fail."""

import random

from pyspark.sql import functions as F

from proselake.llm import chat_format, decontaminate, exact_dedup

DOC = "doc_id long, text string"


def test_history_decides(spark):
    old = spark.createDataFrame([(100, "a  b"), (101, "only old"), (None, "no id")], DOC)
    new = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "new"), (4, "n e w"), (5, "onlyold"), (6, "no id"), (6, "no id")], DOC + "")
    history = exact_dedup.learn(exact_dedup.digests_of(old))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(new, history).collect()}
    assert got == {(1, 100, 3, False), (2, 100, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 101, 2, False), (6, 6, 3, True)}
    grown = exact_dedup.learn(exact_dedup.digests_of(new), history)
    assert {r.keep_id for r in exact_dedup.entries(grown).collect()} == {100, 101, 4, 6}
    again = exact_dedup.exact_dedup(spark.createDataFrame([(9, "a     b"), (8, "unknown")], DOC), grown).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in again} == {(9, 9, 4), (8, 8, 1)}


def test_dedup_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", " ", "a b", "ab", "a  b", "x", "xy", "x y", f"t{rng.randrange(9)}"])) for _ in range(200)]
    groups = {}
    for i, t in rows:
        k = "".join((t or "").split())
        groups.setdefault(k, []).append((i is not None, len(t or ""), -(i or 0)))
    want = sorted((i, -max(g)[2] if max(g)[0] else None, len(g)) for i, t in rows for g in [groups["".join((t or "").split())]] if i is not None)
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOC)).collect() if r.doc_id is not None)
    assert got == want


def test_sketch_prunes(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40)))) for i in range(30)] + [(3, "more words of item three here")]
    docs = [(i, " ".join(rng.choice([t for _, t in items] + vocab) for _ in range(rng.randrange(0, 6)))) for i in range(120)]
    docs += [(7, "x y z"), (200, " ".join(items[0][1].split()[:18])), (200, " ".join(items[0][1].split()[14:]))]
    docs += [(300 + 2 * i + side, " ".join(t.split()[:9] if side else t.split()[-9:])) for i, t in items for side in (0, 1)]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(len(w) - 4, 1))} if t.split() else set()
    own, said = {}, {}
    for table, rows in ((own, items), (said, docs)):
        for i, t in rows:
            table[i] = table.get(i, set()) | grams(t)
    want = {(d, i, len(g & h)) for i, g in own.items() for d, h in said.items() if g and 100 * len(g & h) >= 80 * len(g)}
    items_, docs_ = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, DOC)
    assert {(r.doc_id, r.item_id, r.n_common) for r in decontaminate.find_contained(docs_, items_).collect()} == want
    shingles = decontaminate.item_shingles(items_, 5, 80)
    sketch = decontaminate.sketches(shingles, 80)
    assert sketch.count() < shingles.count() / 2
    outside = shingles.join(sketch, ["h", "item_id"], "left_anti").join(sketch, "h", "left_anti").count()
    assert outside > 0
    found = decontaminate.candidates(docs_, sketch, 5).count()
    assert found < decontaminate.candidates(docs_, shingles.select("h", "item_id"), 5).count()


def test_clashing_parts_column(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (None, 1, "a", "b", "x", "y"), (None, 0, "a", "c", "x", "y")], "conv_id long, turn long, role string, text string, parts string, seen string")
    out = {r.conv_id: (r.n_turns, r.formatted) for r in chat_format.format_chat(turns).collect()}
    assert out == {1: (1, "<|im_start|>user\nhi<|im_end|>\n"), None: (2, "<|im_start|>a\nc<|im_end|>\n<|im_start|>a\nb<|im_end|>\n")}
    assert chat_format.format_chat(turns.filter("false")).count() == 0
    many = spark.createDataFrame([(1, 0, "user", "same")] * 3, "conv_id long, turn long, role string, text string")
    assert chat_format.format_chat(many).first().n_turns == 3


def test_audio_and_documents(spark):
    part = lambda kind, ref, units: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(ref).alias("ref"), F.lit(units).cast("int").alias("units"))
    turns = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.array(part("audio", "a.wav", 30), part("document", "b.pdf", None), part("strange", None, 5)).alias("p"))
    r = chat_format.format_chat(turns, parts="p").first()
    assert r.formatted == "<|im_start|>user\n<|audio|><|document|><|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "audio", "a.wav", 32), (2, "document", "b.pdf", 2)]
