"""Small helpers for writing Catalyst expressions as Spark SQL text.

Detection builds a few hundred higher-order-function expressions per plan.
Written as SQL text, each column costs one parser call in the JVM instead of
hundreds of Python-to-JVM calls for the equivalent ``Column`` objects.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN_T = "ARRAY<STRUCT<start: INT, `end`: INT, value: STRING>>"
FINDING_T = "ARRAY<STRUCT<start: INT, `end`: INT, category: STRING, value: STRING>>"


def q(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def case_map(expr: str, mapping: Mapping, default: str) -> str:
    """``CASE expr WHEN k THEN v ... ELSE default END`` with literal keys/values."""
    if not mapping:
        return default
    parts = " ".join(f"WHEN {q(k)} THEN {_lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {parts} ELSE {default} END)"


def _lit(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return q(str(v))


def add(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``withColumns`` from SQL expression text."""
    if not columns:
        return df
    return df.withColumns({k: F.expr(v) for k, v in columns.items()})


def empty(sql_type: str) -> str:
    return f"CAST(array() AS {sql_type})"


def let(bindings: Mapping[str, str], body: str, var: str) -> str:
    """Evaluate ``bindings`` once per row and ``body`` over them as ``var.<name>``.

    ``transform(array(named_struct(...)), var -> body)[0]``: values a lambda
    reads through ``var`` are computed once, whereas a column read inside a
    lambda may be inlined there by the optimizer (projection collapsing
    counts references, not evaluations) and recomputed per element.
    """
    fields = ", ".join(f"'{k}', {v}" for k, v in bindings.items())
    return f"transform(array(named_struct({fields})), {var} -> {body})[0]"
