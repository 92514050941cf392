"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where it is unset, a local session (tests) gets a folder of its own; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="proselake-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session. DataFrames that still read them cannot be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    """One folder per session, so that the tables of a run go together."""
    return f"{shared_dir(spark)}/proselake/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the table, not a recomputation,
    and non-deterministic columns (partition ids) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id long and text. No alias where none is needed, so that equal exchanges of it are reused."""
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, "text")


def global_rank(df: DataFrame, order: list, name: str, tag: str) -> DataFrame:
    """Add the dense 0-based rank of every row under `order`, without a single-partition window.

    A range partitioning sorts the rows; the position inside a partition is stored with the row,
    and only one count per partition travels (a table as long as the number of partitions).
    """
    spark = df.sparkSession
    n = partitions(spark)
    part, pos = f"__{name}_part", f"__{name}_pos"
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(pos, F.monotonically_increasing_id())
    placed = materialise(placed.withColumn(part, F.shiftright(pos, 33)).withColumn(pos, F.col(pos).bitwiseAND(F.lit((1 << 33) - 1))), tag)
    counts = placed.groupBy(part).count().orderBy(part).collect()  # one row per partition
    total, starts = 0, []
    for row in counts:
        starts.append((row[part], total))
        total += row["count"]
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop(part, pos)
    offsets = spark.createDataFrame(starts, f"{part} long, __start long")
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col("__start") + F.col(pos)).drop(part, pos, "__start")
