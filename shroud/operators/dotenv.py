"""dotenv mode: every ``KEY=VALUE`` value is a finding unless clearly harmless.

Lines are split like Python's ``str.splitlines(keepends=True)``; each line is
matched as a whole against the assignment shape (optional ``export``, quoted
or bare value, trailing ``# comment`` excluded). Quotes stay inside the span;
booleans, null-ish words, empty values and numbers are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import should_mask_env_value
from ..functions.scan import SENTINEL_COL, with_prefix_sums, with_sentinel
from ..functions.sql import SPAN_T, add, empty, ident, let, q

# FIXED VALUES: line separators of str.splitlines and the assignment shape.
LINE_SEP = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
ENV_LINE = (
    r"(?d)^([ \t]*(?:export[ \t]+)?[A-Za-z_][A-Za-z0-9_.]*[ \t]*=[ \t]*)"
    r"(\"[^\"]*\"|'[^']*'|[^#\r\n]*?)"
    r"([ \t]*(?:#.*)?[\r\n]*)$"
)


def with_dotenv_spans(df: DataFrame, text: str, out: str, enabled: Column | bool = True) -> DataFrame:
    """``out`` = value spans (``array<struct<start,end,value>>``) of dotenv lines.

    ``enabled`` may be a boolean column (e.g. from the file name) so one plan
    serves mixed inputs.
    """
    t = ident(text)
    df, own = with_sentinel(df, text)
    sx = SENTINEL_COL
    flag = "__dv_on"
    df = df.withColumn(flag, F.lit(enabled) if isinstance(enabled, bool) else enabled)
    run = f"({flag} AND {t} IS NOT NULL AND contains({t}, '='))"
    sep = q("(" + LINE_SEP + ")")
    df = add(df, {
        "__dv_mk": f"CASE WHEN {run} AND {sx} IS NOT NULL THEN regexp_replace({t}, {sep}, concat('$1', {sx})) END",
        "__dv_g": f"CASE WHEN {run} AND {sx} IS NULL THEN split({t}, {q(LINE_SEP)}, -1) END",
        "__dv_s": f"CASE WHEN {run} AND {sx} IS NULL THEN regexp_extract_all({t}, {sep}, 1) END",
    })
    slow = "transform(__dv_g, (x, i) -> concat(x, CASE WHEN i < size(__dv_s) THEN __dv_s[i] ELSE '' END))"
    df = add(df, {"__dv_lines": f"CASE WHEN __dv_mk IS NOT NULL THEN split(__dv_mk, {sx}, -1) "
                                f"WHEN __dv_g IS NOT NULL THEN {slow} ELSE {empty('ARRAY<STRING>')} END"})
    df = df.drop("__dv_mk", "__dv_g", "__dv_s")
    df = add(df, {"__dv_len": "transform(__dv_lines, x -> length(x))"})
    df = with_prefix_sums(df, [("__dv_len", "__dv_off")])
    env = q(ENV_LINE)
    df = add(df, {"__dv_m": f"transform(__dv_lines, l -> CASE WHEN l RLIKE {env} THEN named_struct("
                            f"'head', length(regexp_extract(l, {env}, 1)), 'value', regexp_extract(l, {env}, 2)) END)"})
    one = ("i -> CASE WHEN v.m[i] IS NOT NULL THEN named_struct('start', v.o[i] + v.m[i].head, "
           "'end', v.o[i] + v.m[i].head + length(v.m[i].value), 'value', v.m[i].value) END")
    keep = f"x -> x IS NOT NULL AND {should_mask_env_value('x.value')}"
    spans = let({"m": "__dv_m", "o": "__dv_off"},
                f"filter(transform(sequence(0, size(v.m) - 1), {one}), {keep})", "v")
    df = add(df, {out: f"CASE WHEN size(__dv_m) > 0 THEN {spans} ELSE {empty(SPAN_T)} END"})
    df = df.drop("__dv_lines", "__dv_len", "__dv_off", "__dv_m", flag)
    if own:
        df = df.drop(SENTINEL_COL)
    return df


def is_dotenv_name(file_name: Column) -> Column:
    """``.env``, ``.env.*`` and ``*.env`` file names use dotenv mode."""
    return (file_name == ".env") | file_name.startswith(".env.") | file_name.endswith(".env")
