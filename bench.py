"""Headline queries, timed; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from proselake.plans import registry

HEADLINE = ["sentence_stats_by_lang", "outside_profile", "topic_overlap_prev", "sentence_dedupe_fold", "bm25_topk", "collocations_topk", "phrase_share", "ngram_doc_counts", "line_multiset_dice"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["long_sentences"](spark, folder).limit(1).collect()  # the first query would carry the start of the workers
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sentences = registry.queries()["sentence_stats_by_lang"](spark, folder).agg({"sentences": "sum"}).first()[0]
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rpartition("sf")[2], "sentences_per_second": round(sentences / took["sentence_stats_by_lang"])}))


if __name__ == "__main__":
    main()
