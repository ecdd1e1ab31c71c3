"""Term tables of many parts: a batch of texts costs the same whatever their number."""

import time

from shroud.operators import automaton as A


def test_many_parts_and_many_batches(spark):
    terms = spark.range(30_000).selectExpr("concat('Item ', id, ' ', id % 7) AS term", "'a' AS category").union(
        spark.range(30_000).selectExpr("concat('->', id, '<-')", "'b'"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        start = time.time()
        files = A.build_terms(terms, False, 300)
        texts = spark.range(6000).selectExpr("id", "concat('an Item ', id, ' ', id % 7, ', Item ', id, ' x->', id, '<-_ ->', id, '0<') AS text").repartition(2)
        rows = A.with_terms(texts, "text", files, "hits").collect()
        took = time.time() - start
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert not files.files and len(files.terms) == 20 and len(rows) == 6000
    for r in rows:
        whole, mark = f"Item {r.id} {r.id % 7}", f"->{r.id}<-"
        assert [tuple(h) for h in r.hits] == [(3, 3 + len(whole), "a", whole), (r.text.index(mark), r.text.index(mark) + len(mark), "b", mark)]
    assert took < 90


def test_marks_alone_stand_beside_words(spark):
    terms = spark.createDataFrame([("--", "m"), ("-a-", "w"), ("_a", "w"), ("a-b", "w"), ("A-B", "v")], "term string, category string")
    found = A.with_terms(spark.createDataFrame([("-a--a-b _a A-b",)], "text string"), "text", A.build_terms(terms, True), "hits").first().hits
    assert [(h.start, h.end, h.category) for h in found] == [(0, 3, "w"), (2, 4, "m"), (3, 6, "w"), (4, 7, "v"), (4, 7, "w"), (8, 10, "w"),
                                                          (11, 14, "v"), (11, 14, "w")]
