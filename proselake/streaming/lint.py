"""The same plans over newly arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from proselake.operators.prose import long_sentences


def stream_findings(spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, rule: Callable[[DataFrame], DataFrame] = long_sentences) -> StreamingQuery:
    """Apply a rule to each batch of new Parquet files of documents and hand the findings to sink(df, batch)."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.writeStream.foreachBatch(lambda df, n: sink(rule(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
