"""Plan shape: pruning, shuffles and join strategies of the headline queries."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_mask_reads_two_columns_and_shuffles_once(spark):
    plan = _plan(E.queries()["mask_documents"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "struct<doc_id:bigint,text:string>" in plan
    # only the round-robin spread of a single-row-group file; detection itself is narrow
    assert plan.count("Exchange") <= 1
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_counts_by_source_aggregates_before_the_shuffle(spark):
    plan = _plan(E.queries()["counts_by_source"](spark, SF))
    assert "partial_sum" in plan and "hashpartitioning(source" in plan


def test_unlock_uses_equi_joins_only(spark):
    plan = _plan(E.queries()["unlock_documents"](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_filter_reaches_the_scan_through_mask(spark):
    from shroud.operators.mask import mask

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plan = _executed(mask(docs, "text").where("doc_id = 5").select("doc_id", "masked_text"))
    assert "EqualTo(doc_id,5)" in plan


def test_unused_findings_run_no_regex(spark):
    from shroud.operators.mask import mask

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plan = _executed(mask(docs, "text").select("doc_id"))
    assert "regexp" not in plan and "text#" not in plan


def test_explode_detects_once(spark):
    from shroud.operators.detect import find
    from shroud.operators.report import changed_rows, explode_findings

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = find(docs, "text")
    once = str(_executed(found.select("doc_id", "findings"))).count("PRIVATE KEY")
    for df in (explode_findings(found, ("doc_id",)), changed_rows(found).select("doc_id", "findings")):
        assert str(_executed(df)).count("PRIVATE KEY") <= once
