"""Table streams over tables that are folders of files, in an order that is not that of the rows."""

import __spark_entry__ as E
import pytest

TURNS = [(c, t, f"mail u{c}@x.org {t // 2}") for c in range(4) for t in range(6)]
DOCS = [(i, f"doc {i} a{i}@x.org 10.0.0.{i % 200} Orre" if i % 3 else None) for i in range(0, 6000, 40)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    for part in (2, 0, 1):  # the latest rows lie in the oldest file
        docs = spark.createDataFrame([r for r in DOCS if r[0] // 2000 == part], "doc_id long, text string").coalesce(1)
        docs.write.mode("append").parquet(f"{at}/documents.parquet")
        turns = spark.createDataFrame([r for r in TURNS if r[1] // 2 == part], "conv_id long, turn long, text string").coalesce(1)
        turns.write.mode("append").parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(1, 1), (1, 2)], "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("stream, batch", [("stream_mask", "mask_documents"), ("stream_gazetteer_find", "gazetteer_large_find"),
                                           ("stream_dedup_conversations", "dedup_conversations_batch"),
                                           ("stream_dedup_conversations_table", "dedup_conversations_batch")])
def test_streams_equal_batches(spark, sf, stream, batch):
    run = lambda name: sorted(map(repr, E.queries()[name](spark, sf).collect()))
    got = run(stream)
    assert got and got == run(batch)


def test_no_window_is_late_by_its_file(spark, sf):
    rows = E.queries()["stream_window_report"](spark, sf).collect()
    counts = {r.category: r.n for r in E.queries()["counts_by_category"](spark, sf).selectExpr("category", "n_findings AS n").collect()}
    assert counts and {c: sum(r.n_findings for r in rows if r.category == c) for c in counts} == counts
