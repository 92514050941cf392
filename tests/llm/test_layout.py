"""Sharding, token output and language identification against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselake.llm import language_id, sharding, token_output
from proselake.llm._store import materialise


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(rng.choice([None, *range(400)]), rng.choice([None, "", "é" * rng.randrange(30), f"t{rng.randrange(40)}", "x" * rng.randrange(5000)])) for _ in range(600)]
    return out + [(1, "big " * 20_000)]


@pytest.mark.parametrize("precision", [None, 6])
def test_shards(spark, rows, precision):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, rank string")
    got = sharding.shard(docs, 7, precision).collect()
    size = lambda t: len((t or "").encode()) + 1
    key = lambda i, t: (-1 if i is None else i, size(t), zlib.crc32((t or "").encode()))
    assert Counter(key(r.doc_id, None)[:1] + (r["size"], r.text_crc32) for r in got) == Counter(key(i, t) for i, t in rows)
    slots, groups, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r["size"], r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    rest = sorted(load.values())[:-1]  # the one huge group has a shard for itself
    assert len(load) == 7 and max(load.values()) <= 80_001 + 5000 and rest[-1] - rest[0] <= 5001


def test_best_fit_by_hand():
    sizes = [(9, 1), (7, 2), (4, 3), (2, 4), (1, 3)]
    room, want = [], []
    for s, n in sizes:
        for _ in range(n):
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            i = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(10)
            room[i] -= s
            want.append(i)
    assert [b for n, b in sharding.best_fit_decreasing(sizes, 10) for _ in range(n)] == want


@pytest.fixture
def codec():
    return lambda: lambda text: np.frombuffer(text.encode(), np.uint8).astype(np.uint16)


def test_ranks_do_not_depend_on_splits(spark, rows, codec):
    docs = materialise(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(5), "docs")
    out = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        shards = token_output.write_shards(docs, codec, end=999, key=5, length=16, slots_per_shard=64)
        out.append(sorted((r.slot, r.doc_id, r.seq, bytes(r.ids)) for r in token_output.read_slots(shards).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out[0] == out[1] and [r[0] for r in out[0]] == list(range(len(out[0])))
    texts = Counter()
    by_doc = defaultdict(list)
    for _, doc, seq, ids in out[0]:
        by_doc[doc].append((seq, np.frombuffer(ids, "<u2")))
    for doc, parts in by_doc.items():
        texts[doc] += sum(int((x != 999).sum()) for _, x in parts)
    want = Counter()
    for i, t in rows:
        want[-(2**63) if i is None else i] += len((t or "").encode())
    assert texts == want


def test_a_broken_run_is_taken_up(spark, rows, codec):
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    write = lambda done=None: token_output.write_shards(docs, codec, end=999, key=5, length=16, slots_per_shard=64, done=done)
    whole = write()
    part = whole.filter("shard % 3 = 0")
    again = write(part)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    assert token_output.write_shards(docs.filter("false"), codec, end=9, key=1).count() == 0


def test_language_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)

    def margins(text):
        data = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in text.lower().encode())
        total, n = np.zeros(model.weights.shape[1]), 0
        for k, tag in ((1, 0), (2, 1 << 24), (3, 1 << 25)):
            for i in range(k - 1, len(data)):
                gram = sum(data[i - j] << (8 * j) for j in range(k)) | tag
                total += model.weights[((gram * 2654435761) & 0xFFFFFFFF) >> (32 - language_id.BITS)]
                n += 1
        return total / max(n, 1) ** 0.5

    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        m = margins(r.text)
        loss = [sum(t * np.logaddexp(0, -x * c) for x, c, t in zip(m, code, model.trust, strict=True)) for code in model.code]
        p = np.exp(-(np.array(loss) - min(loss)) / (model.trust.sum() / 2))
        want = model.languages[int(np.argmin(loss))] if any(c.isalpha() for c in r.text) else "und"
        assert got[r.doc_id][0] == want and (want == "und" or abs(got[r.doc_id][1] - (p / p.sum()).max()) < 1e-3)


def test_language_edges(spark):
    one = spark.createDataFrame([(i, "the cat sat", "en") for i in range(40)] + [(41, None, "en"), (None, "the", None)], "doc_id long, text string, lang string")
    model = language_id.fit(one)
    assert model.languages == ["en"]
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(one.withColumn("letter", F.lit(1)).withColumn("score", F.lit("x")), model).collect()}
    assert (41, "und") in got and (3, "en") in got and (None, "en") in got
    assert language_id.identify(one.filter("false"), model).count() == 0
    texts = pa.array(["ab é " * 700_000, "x" * 3])
    rows = np.concatenate([*language_id.counts(texts)])
    small = np.concatenate([*language_id.counts(pa.array(["ab é " * 7]))])[0]
    assert rows.shape[0] == 2 and rows[0].sum() == 3 * len(("ab é " * 700_000).encode()) - 3
    assert set(np.flatnonzero(small)) == set(np.flatnonzero(rows[0]))
