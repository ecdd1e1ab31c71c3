"""Reports: per-document counts and summary, corpus-wide rollups."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import count_label
from ..functions.sql import add, ident
from .detect import guard


def counts_sql(f: str) -> str:
    """``map<category, int>`` of one document, keys in first-occurrence order."""
    cats = f"array_distinct(transform({f}, x -> x.category))"
    return f"map_from_arrays({cats}, transform({cats}, c -> size(filter({f}, x -> x.category = c))))"


def summary_sql(f: str) -> str:
    """``"2 emails, 1 secret"``; categories in order of first occurrence."""
    cats = f"array_distinct(transform({f}, x -> x.category))"
    label = count_label("c", f"size(filter({f}, x -> x.category = c))")
    return f"array_join(transform({cats}, c -> {label}), ', ')"


def with_report(df: DataFrame, findings: str = "findings") -> DataFrame:
    f = ident(findings)
    return add(df, {
        "n_findings": f"CAST(size({f}) AS BIGINT)",
        "changed": f"size({f}) > 0",
        "counts": counts_sql(f),
        "summary": summary_sql(f),
    })


def explode_findings(df: DataFrame, keys: Sequence[str], findings: str = "findings") -> DataFrame:
    """Findings table ``(keys..., start, end, category, value)``."""
    return guard(df.select(*keys, findings), findings).select(*keys, F.inline(findings))


def changed_rows(df: DataFrame, findings: str = "findings") -> DataFrame:
    """The rows with findings, detected once."""
    return guard(df, findings).where(F.size(findings) > 0)


def counts_by(df: DataFrame, group: Sequence[str], findings: str = "findings") -> DataFrame:
    """Finding counts per ``group`` + category, pre-aggregated per row.

    Each row contributes one ``(category, n)`` pair per category present and
    the hash aggregate combines them map-side before the shuffle, so a hot
    group never concentrates raw findings in one task.
    """
    per_row = guard(df.select(*group, findings), findings).select(*group, F.explode(F.expr(counts_sql(ident(findings)))).alias("category", "n"))
    return per_row.groupBy(*group, "category").agg(F.sum("n").cast("long").alias("n_findings"))


#: The groupings of a corpus report: each pair, each group, each category, and the total.
LEVELS = ("both", "group", "category", "total")


def _level() -> Column:
    """Name of a row's grouping."""
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.grouping_id().cast("int") + 1)


def _per_row(df: DataFrame, group: str, findings: str) -> DataFrame:
    """``(group, category, value, n)``: a row's distinct values with how often each stands there."""
    found = guard(df.select(group, findings), findings).select(F.col(group).alias("g"), F.inline(findings))
    return found.groupBy("g", "category", F.xxhash64("value").alias("h"), F.xxhash64(F.lit("second"), "value").alias("h2")).agg(
        F.count(F.lit(1)).alias("n"))


def rollup_report(df: DataFrame, group: str, findings: str = "findings") -> DataFrame:
    """``(level, <group>, category, n_findings, n_values)`` for every grouping of ``group`` and category, the total included.

    Values are counted exactly, by a 128-bit hash, and pre-aggregated per group
    and category before the groupings are formed, so a value that stands in many
    rows is one row of the second step. Null groups are a group of their own.
    """
    counted = _per_row(df, group, findings)
    out = counted.cube("g", "category").agg(F.sum("n").cast("long").alias("n_findings"), F.count_distinct("category", "h", "h2").alias("n_values"),
                                            _level().alias("level"))
    return out.select("level", F.col("g").alias(group), "category", "n_findings", "n_values")


def sketch_report(df: DataFrame, group: str, findings: str = "findings", lg_k: int = 12) -> DataFrame:
    """``(<group>, category, n_findings, sketch)``: counts and mergeable sketches of the distinct values.

    A sketch has at most ``2 ** lg_k`` registers whatever it has seen, so such
    tables of many runs can be kept and merged (:func:`merge_sketches`) without
    the findings themselves.
    """
    found = guard(df.select(group, findings), findings).select(F.col(group).alias("g"), F.inline(findings))
    out = found.groupBy("g", "category").agg(F.count(F.lit(1)).alias("n_findings"), F.hll_sketch_agg(F.concat_ws("\u0000", "category", "value"), lg_k).alias("sketch"))
    return out.select(F.col("g").alias(group), "category", "n_findings", "sketch")


def merge_sketches(sketches: DataFrame, group: str) -> DataFrame:
    """``(level, <group>, category, n_findings, about_values)`` from sketch tables of any number of runs."""
    out = sketches.withColumnRenamed(group, "g").cube("g", "category").agg(
        F.sum("n_findings").cast("long").alias("n_findings"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about_values"),
        _level().alias("level"))
    return out.select("level", F.col("g").alias(group), "category", "n_findings", "about_values")
