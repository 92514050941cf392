from test_edges import frame

from proselake.llm import decontaminate


def test_leak_over_two_rows_of_one_document(spark):
    item = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = frame(spark, [(1, " ".join(item[:17])), (1, " ".join(item[13:]))])
    assert [(r.doc_id, r.item_id, r.n_common) for r in decontaminate.find_contained(docs, items).collect()] == [(1, 1, 26)]
