"""Detection: build the enabled detectors, collect their findings, resolve.

Everything here is a narrow transformation: each document row carries its own
findings array, so detection, resolution and masking need no shuffle. Which
detectors exist is decided on the driver from the :class:`Policy`, so a
disabled category never reaches the plan.

Collection order (also the order of equal findings before resolution):
built-in patterns by category order, custom keywords, the entropy catch-all
(rides on ``secret``), contextual entities, custom detectors, dotenv values.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.scalar import looks_secret, luhn_valid
from ..functions.scan import SENTINEL_COL, Scan, with_sentinel, with_spans, with_tagged_spans
from ..functions.sql import FINDING_T, add, empty, ident, q
from . import catalog as C
from .automaton import build_terms, with_terms
from .contextual import with_contextual
from .dates import with_dates
from .dotenv import with_dotenv_spans
from .resolve import with_resolved
from .tagger import with_tagged_entities


LOWER_COL = "__lc"


def detector_plan(text: str, policy: P.Policy, lowered: str | None = None) -> list[tuple[Scan, str, str | None]]:
    """(scan, category, validator) for every enabled regex-style detector."""
    plan = []
    t = ident(text)
    for category in P.ALL_CATEGORIES:
        if not policy.is_on(category):
            continue
        for spec in C.BUILTIN.get(category, ()):
            plan.append((Scan(f"__d{len(plan)}", spec.regex, spec.grouped, spec.gate(t, lowered)), category,
                         spec.validator))
    for word in policy.active_keywords:
        rx = C.keyword_regex(word)
        plan.append((Scan(f"__d{len(plan)}", rx, False, C.keyword_gate(word, t, lowered)), P.KEYWORD, None))
    if policy.is_on(P.SECRET):
        spec = C.ENTROPY_CANDIDATE
        plan.append((Scan(f"__d{len(plan)}", spec.regex, False, spec.gate(t)), P.SECRET, "entropy"))
    return plan


def with_keyword_table(df: DataFrame, text: str, keywords: DataFrame, out: str) -> DataFrame:
    """Keywords of a table ``(keyword)`` of any size, whatever their case, as whole words (marks may touch anything)."""
    return with_terms(df, text, build_terms(keywords.select(F.col("keyword").alias("term"), F.lit(P.KEYWORD).alias("category")), fold=True), out)


def _needs_lower(policy: P.Policy) -> bool:
    # one lower-cased copy per row makes every case-insensitive gate a byte search
    return policy.is_on(P.SECRET) or bool(policy.active_keywords)


def _tagged(name: str, category: str) -> str:
    return (f"transform({name}, s -> named_struct('start', s.start, 'end', s.`end`, "
            f"'category', {q(category)}, 'value', s.value))")


def with_raw_findings(df: DataFrame, text: str, policy: P.Policy, out: str = "raw_findings",
                      dotenv: Column | bool = False, custom: Sequence = ()) -> DataFrame:
    """``out`` = unresolved findings of every enabled detector."""
    t = ident(text)
    df, own = with_sentinel(df, text)
    lowered = None
    if _needs_lower(policy):
        # one lower-cased copy per row, shared by every case-insensitive gate
        df = add(df, {LOWER_COL: f"lower({t})", LOWER_COL + "__cf": C.special_chars(t)})
        lowered = LOWER_COL
    plan = detector_plan(text, policy, lowered)
    extra = ["__tagged"]
    arrays = []
    if plan:
        df = with_tagged_spans(df, text, [s for s, _, _ in plan], "__tagged")
        checks = []
        for i, (_scan, _category, validator) in enumerate(plan):
            if validator == "luhn":
                checks.append(f"WHEN {i} THEN {luhn_valid('s.value')}")
            elif validator == "entropy":
                checks.append(f"WHEN {i} THEN "
                              f"{looks_secret('s.value', policy.entropy_min_length, policy.entropy_min_bits)}")
        valid = f"CASE s.id {' '.join(checks)} ELSE true END" if checks else "true"
        category = "CASE s.id " + " ".join(f"WHEN {i} THEN {q(cat)}" for i, (_s, cat, _v) in enumerate(plan)) + " END"
        arrays.append(f"transform(filter(__tagged, s -> {valid}), s -> named_struct('start', s.start, 'end', s.`end`, "
                      f"'category', {category}, 'value', s.value))")
    if lowered:
        df = df.drop(LOWER_COL, LOWER_COL + "__cf")
    if policy.contextual_status == "active":
        df = with_contextual(df, text, policy, "__ctx")
        arrays.append("__ctx")
        extra.append("__ctx")
        if policy.tagger is not None:
            df = with_tagged_entities(df, text, policy.tagger, "__tag")
            on = ", ".join(q(c) for c in sorted(policy.contextual_enabled))
            arrays.append(f"transform(filter(__tag, s -> s.score >= {float(policy.contextual_min_score)!r}D AND s.category IN ({on})), "
                          "s -> named_struct('start', s.start, 'end', s.`end`, 'category', s.category, 'value', s.value))")
            extra.append("__tag")
        if policy.dates and policy.is_on(P.DATE):
            df = with_dates(df, text, "__dated")
            arrays.append("transform(__dated, s -> named_struct('start', s.start, 'end', s.`end`, 'category', s.category, 'value', s.value))")
            extra.append("__dated")
    if policy.keyword_table is not None and policy.is_on(P.KEYWORD):
        df = with_keyword_table(df, text, policy.keyword_table, "__kwt")
        arrays.append("__kwt")
        extra.append("__kwt")
    for i, det in enumerate(custom):
        name = f"__cu{i}"
        df = df.withColumn(name, det(F.col(text)))
        arrays.append(f"coalesce({name}, {empty(FINDING_T)})")
        extra.append(name)
    if not (isinstance(dotenv, bool) and not dotenv):
        df = with_dotenv_spans(df, text, "__env", dotenv)
        arrays.append(_tagged("__env", P.SECRET))
        extra.append("__env")

    raw = f"concat({', '.join(arrays)})" if arrays else empty(FINDING_T)
    df = add(df, {out: f"CASE WHEN {t} IS NULL OR length({t}) = 0 THEN {empty(FINDING_T)} ELSE {raw} END"})
    df = df.drop(*[c for c in extra if c in df.columns])
    if own:
        df = df.drop(SENTINEL_COL)
    return df


def guard(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Publish the finding count as an observed metric, and keep later filters above it.

    ``explode``/``inline`` infer a filter ``size(findings) > 0``, and a filter
    on the findings is pushed through projections by substituting the staged
    expressions, which would run the detection twice. Put this only in front
    of such a step: it also keeps key filters and column pruning from reaching
    the scan.
    """
    name = f"shroud_findings_{uuid.uuid4().hex[:10]}"
    return df.observe(name, F.sum(F.size(F.col(findings))).alias("n_findings"))


def find(df: DataFrame, text: str = "text", policy: P.Policy | None = None, out: str = "findings",
         dotenv: Column | bool = False, custom: Sequence = ()) -> DataFrame:
    """Add ``out``: resolved, ascending, non-overlapping findings per row.

    A plain projection: filters on other columns reach the scan, and an unused
    ``out`` costs nothing.
    """
    policy = policy or P.Policy()
    df = with_raw_findings(df, text, policy, "__raw", dotenv=dotenv, custom=custom)
    return with_resolved(df, "__raw", out).drop("__raw")


def scan_pattern(df: DataFrame, text: str, spec: C.PatternSpec, out: str = "spans",
                 validate: bool = True) -> DataFrame:
    """One catalog pattern alone (validator applied): ``array<start,end,value>``."""
    df = with_spans(df, text, [Scan(out, spec.regex, spec.grouped, spec.gate(ident(text)))])
    if validate and spec.validator == "luhn":
        df = add(df, {out: f"filter({out}, s -> {luhn_valid('s.value')})"})
    return df
