"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. A binary classifier per bit separates the languages whose bit
is 1 from the others by hashed byte n-grams: its weights are log odds of n-gram rates, averaged over
the languages of a side, and its margin grows with the square root of the number of n-grams. Decoding
sums a logistic loss over the bits of each codeword, weighted by how well each bit did on the
training rows, and takes the codeword with the least loss; a small distance to the runner-up is
flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keyed_text, table
from ._words import buffers, spans

BITS = 14
FEATURES = 1 << BITS
#: Bound of the training sample: about so many labelled rows of each language, chosen by a hash of doc_id.
ROWS_PER_LANGUAGE = 1500
#: A training row counts by its n-gram rates times at most so many n-grams.
LENGTH_CAP = 3000
BLOCK = 1 << 20  # bytes that are counted at once
SCALE = 1 << 16
SMOOTHING = 1e-5
AMBIGUOUS = 0.4

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def _long(data: np.ndarray) -> np.ndarray:
    """The row of one long text, block by block; each block sees the two bytes before it."""
    out = np.zeros((1, FEATURES), np.float32)
    for at in range(0, len(data), BLOCK):
        lead = min(at, 2)
        x = _FOLD[data[at - lead : at + BLOCK]]
        grams = [x[lead:], (x[1:] | (x[:-1] << np.uint32(8)) | np.uint32(1 << 24))[max(lead - 1, 0) :], x[2:] | (x[1:-1] << np.uint32(8)) | (x[:-2] << np.uint32(16)) | np.uint32(1 << 25)]
        h = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out[0] += np.bincount(h, minlength=FEATURES)
    return out


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of n-gram counts (1 to 3 bytes, letters only, lower case), some texts at a time, in order."""
    offs, data = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    for lo, hi in spans(offs, BLOCK):
        if offs[hi] - offs[lo] > 2 * BLOCK:  # one long text
            yield _long(data[offs[lo] : offs[hi]])
            continue
        for at in range(lo, hi, 64):
            top = min(at + 64, hi)
            a, b = int(offs[at]), int(offs[top])
            x = _FOLD[data[a:b]]
            three = np.zeros((3, len(x)), np.uint32)
            three[0] = x
            three[1, 1:] = x[1:] | (x[:-1] << np.uint32(8)) | np.uint32(1 << 24)
            three[2, 2:] = x[2:] | (x[1:-1] << np.uint32(8)) | (x[:-2] << np.uint32(16)) | np.uint32(1 << 25)
            h = (three * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            out = np.zeros((top - at, FEATURES), np.float32)
            for i in range(at, top):
                s, e = int(offs[i]) - a, int(offs[i + 1]) - a
                if e > s:
                    grams = np.concatenate([h[n, s + n : e] for n in range(3)])
                    out[i - at] = np.bincount(grams, minlength=FEATURES)
            yield out


def codewords(k: int) -> np.ndarray:
    """k codewords of bits as -1 and 1: all different splits for few languages, else random ones far apart."""
    if k < 2:
        return np.ones((k, 0), np.float32)
    if k <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T
    rng, n, best, far = np.random.default_rng(11), max(15, int(np.ceil(10 * np.log2(k)))), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.float32), (k, n))
        m = m[:, np.abs(m.sum(0)) < k]
        d = min((m[i] != m[j]).sum() for i, j in itertools.combinations(range(k), 2))
        if d > far:
            best, far = m, d
    return best


class Model:
    """Weights of the bit classifiers and the codewords."""

    def __init__(self, languages: list[str], rates: np.ndarray):
        """rates: languages x FEATURES, n-gram rates that sum to 1."""
        self.languages, self.code = languages, codewords(len(languages))
        p = rates + SMOOTHING
        w = []
        for bit in self.code.T:
            w.append(np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0)))
        self.weights = np.array(w, np.float32).reshape(-1, FEATURES).T
        self.trust = np.ones(self.code.shape[1], np.float32)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def tune(self, wrong: np.ndarray, rows: int) -> None:
        """Weight each bit by its accuracy on the training rows (above chance)."""
        self.trust = np.clip(1 - 2 * wrong / max(rows, 1), 0.05, 1).astype(np.float32)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and a score between 0 and 1."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        scale = max(float(self.trust.sum()) / 2, 1e-6)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) / scale)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from text and lang of labelled rows that are not held out; their ids only decide which rows these are."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
    known = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(known)
    if not languages:
        return Model([], np.zeros((0, FEATURES)))
    share = F.lit(0.0)
    for name, n in known.items():
        share = F.when(F.col("lang") == name, min(1.0, rows_per_language / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < share).select("doc_id", "lang", "text").repartition(12, "doc_id")
    index = {name: i for i, name in enumerate(languages)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), FEATURES), np.int64)  # whole numbers, so that the order of adding does not matter
        for b in batches:
            lang, at = [index[x] for x in b["lang"].to_pylist()], 0
            for x in counts(b["text"]):
                n = x.sum(1, keepdims=True)
                x = np.rint(x / np.maximum(n, 1) * np.minimum(n, LENGTH_CAP) * SCALE).astype(np.int64)
                np.add.at(total, lang[at : at + len(x)], x)
                at += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * FEATURES, np.int64)
        for b in batches:
            for blob in b["sums"]:
                total += np.frombuffer(blob.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    got = sample.mapInArrow(sums, "sums binary").repartition(2).mapInArrow(add, "sums binary").collect()  # two rows of a fixed size
    total = sum(np.frombuffer(r["sums"], np.int64) for r in got).reshape(len(languages), FEATURES) / SCALE
    model = Model(languages, total / np.maximum(total.sum(1, keepdims=True), 1))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, rows = np.zeros(model.code.shape[1]), 0
        for b in batches:
            lang, at = np.array([index[x] for x in b["lang"].to_pylist()], int), 0
            for x in counts(b["text"]):
                want = model.code[lang[at : at + len(x)]]
                wrong += (model.margins(x) * want <= 0).sum(0)
                at, rows = at + len(x), rows + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([wrong.tobytes()], pa.binary()), pa.array([rows], pa.int64())], names=["wrong", "rows"])

    got = sample.mapInArrow(errors, "wrong binary, rows long").collect()
    model.tune(sum(np.frombuffer(r["wrong"], np.float64) for r in got) + 0.0, sum(r["rows"] for r in got))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where no language was
    learned. Only the text decides. docs: doc_id long, text string; other columns are ignored, and
    every row stays. An empty table gives an empty table.
    """
    names = np.array([*model.languages, "und"], object)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter, at = b["letter"].to_numpy(zero_copy_only=False), 0
            for x in counts(b["text"]):
                ok = letter[at : at + len(x)]
                if model.languages:
                    best, score = model.decode(model.margins(x))
                else:
                    best, score, ok = np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x), bool)
                best, score = np.where(ok, best, len(names) - 1), np.where(ok, score, 0.0)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(x)), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
                at += len(x)

    seen = keyed_text(docs).select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    out = seen.mapInArrow(f, "doc_id long, lang_pred string, score double")
    return out.withColumn("ambiguous", F.col("score") < AMBIGUOUS)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
