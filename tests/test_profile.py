from proselake.operators import prose


def test_every_measure_of_the_profile(spark):
    plain = [(i, "en", "Aa, aa.") for i in range(300)] + [(500 + i, None, "Bb bb.") for i in range(300)] + [(2000 + i, "ko", "그는 올 것 같다.") for i in range(300)]
    odd = [(1000, "en", "Aa, aa, aa."), (1001, "en", "Aa, bb."), (1002, None, "Bb bb bb."), (1003, "ko", "올 것 같다 갈 것 같다."), (1004, "en", "Aa aa aa.")]
    docs = spark.createDataFrame(plain + odd, "doc_id long, lang string, text string")
    got = {(r.doc_id, r.measure, r.value, r.p99) for r in prose.outside_profile_measures(docs).collect()}
    assert got == {(1000, "length", 3, 2), (1000, "commas", 2, 1), (1001, "newTopics", 2, 1), (1002, "length", 3, 2), (1003, "length", 6, 4), (1003, "hedges", 2, 1), (1004, "length", 3, 2)}


def test_beyond_the_cap(spark):
    docs = spark.createDataFrame([(i, "en", "a " * (200 + i) + ".") for i in range(9)], "doc_id long, lang string, text string")
    assert prose.outside_profile(docs).count() == 0
    assert prose.outside_profile_measures(docs).filter("measure = 'length'").count() == 9
