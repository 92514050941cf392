"""Sources: folders of text and Markdown files, JSON lines, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, folder: str, kind: str = "md") -> DataFrame:
    """(source, text): one document per txt or md file, one per line of jsonl files with source and text."""
    if kind == "jsonl":
        return spark.read.schema("source string, text string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}" if kind == "md" else f"*.{kind}").text(folder, wholetext=True)
    out = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return out.filter(~F.col("source").rlike(r"/(\.[^/]+|node_modules)/"))
