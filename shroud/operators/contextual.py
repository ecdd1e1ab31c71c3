"""Contextual entities (person, location, org, date) and pluggable detectors.

The entity categories have no fixed shape. Here they are found with a
*gazetteer* — a table ``(term, category[, score])`` — matched against whole
words of the text: a term matches when it equals, case-sensitively, a run of
whole words together with the exact separators between them, so it must begin
and end with a word character. Terms scoring below the policy's minimum (0.4 by
default) are ignored.

A gazetteer of any size is compiled into automata that every executor gets as
files (:mod:`shroud.operators.automaton`); one plan serves batches and streams.

Any other detector (a model, a service client) plugs in as a pandas UDF through
:func:`custom_detector`; it runs on executors in Arrow batches.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from .automaton import build_terms, with_terms

# FIXED VALUES: external entity labels and the categories they map to.
ENTITY_LABELS = {"PERSON": P.PERSON, "LOCATION": P.LOCATION, "ORGANIZATION": P.ORG, "DATE_TIME": P.DATE}

CTX_TYPE = "array<struct<start:int,end:int,category:string,value:string>>"


def prepare_gazetteer(gazetteer: DataFrame, policy: P.Policy) -> DataFrame:
    """Enabled categories only, score cut, entity labels mapped to categories."""
    g = gazetteer
    mapping = F.create_map(*[F.lit(x) for kv in ENTITY_LABELS.items() for x in kv])
    g = g.withColumn("category", F.coalesce(mapping[F.col("category")], F.col("category")))
    if "score" in g.columns:
        g = g.where(F.col("score") >= F.lit(policy.contextual_min_score))
    g = g.where(F.col("category").isin(*sorted(policy.contextual_enabled)))
    g = g.where(F.col("term").rlike(r"(?Us)^\w(?:.*\w)?$"))
    return g.select("term", "category")


def with_contextual(df: DataFrame, text: str, policy: P.Policy, out: str) -> DataFrame:
    """``out`` = contextual findings array (category per element)."""
    if policy.contextual_status != "active" or policy.gazetteer is None:
        return df.withColumn(out, F.array().cast(CTX_TYPE))
    return with_terms(df, text, build_terms(prepare_gazetteer(policy.gazetteer, policy), fold=False), out)


def custom_detector(fn: Callable[[str], Iterable[tuple]], category: str | None = None):
    """Wrap ``fn(text) -> iterable of (start, end[, category])`` as a column function.

    Offsets are code points into the text. The function runs in pandas UDF
    batches on executors; load models lazily inside ``fn`` (once per worker).
    """
    from ..functions.vectorized import detector_udf

    return detector_udf(fn, category)
