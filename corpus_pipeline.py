"""A training corpus from `documents`: five stages, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from proselake.llm._store import materialise


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among `gone`; a null doc_id stays."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those between two languages go."""
    seen = language_id.identify(docs, language_id.fit(docs))
    return _without(docs, seen.filter((F.col("lang_pred") == "und") | F.col("ambiguous")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return _without(docs, exact_dedup.exact_dedup(docs).filter(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest doc_id stays."""
    classes = jaccard_join.jaccard_classes(docs, k=5, percent=80)
    return _without(docs, classes.filter("doc_id <> component_id"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item (0.8 of its five-word shingles) go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.find_contained(docs, items, k=5, percent=80))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with a digest of the text that they decode to."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]

#: SQL cannot express the language and token stages; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
