"""Masking: splice replacement tokens over resolved findings, left to right."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame

from .. import policy as P
from ..functions.scalar import replacement_for
from ..functions.sql import add, ident, let
from .detect import find


# Above this many findings a text is cut once into chunks of CHUNK characters,
# so each piece costs O(piece + CHUNK) instead of a walk from the text start.
SPLICE_CHUNKED_ABOVE = 32
CHUNK = 2048


def _piece_sql(a: str, b: str) -> str:
    """Characters [a, b) of the text held as ``v.ch`` chunks of CHUNK characters."""
    c0, c1 = f"CAST(({a}) div {CHUNK} AS INT)", f"CAST((({b}) - 1) div {CHUNK} AS INT)"
    part = (f"c -> substr(v.ch[c], greatest(({a}) - c * {CHUNK}, 0) + 1, "
            f"least(({b}), (c + 1) * {CHUNK}) - greatest(({a}), c * {CHUNK}))")
    return f"CASE WHEN ({b}) <= ({a}) THEN '' ELSE array_join(transform(sequence({c0}, {c1}), {part}), '') END"


def splice_sql(text: str, findings: str, token: str) -> str:
    """SQL: ``text`` rebuilt with ``token`` (SQL over ``f`` and ``i``) per finding.

    ``findings`` must be ascending and disjoint (the resolver's output) and a
    materialised column. Spark's ``substr`` on UTF-8 walks from the start of
    the text, so texts with many findings are first cut into fixed-size
    chunks with one linear regex pass.
    """
    prev = f"CASE WHEN i = 0 THEN 0 ELSE {findings}[i - 1].`end` END"
    piece = f"(f, i) -> concat(substr({text}, {prev} + 1, f.start - {prev}), {token})"
    body = f"array_join(transform({findings}, {piece}), '')"
    tail = f"substr({text}, {findings}[size({findings}) - 1].`end` + 1)"
    direct = f"concat({body}, {tail})"

    vprev = "CASE WHEN i = 0 THEN 0 ELSE v.f[i - 1].`end` END"
    vbody = f"array_join(transform(v.f, (f, i) -> concat({_piece_sql(vprev, 'f.start')}, {token})), '')"
    vtail = _piece_sql("v.f[size(v.f) - 1].`end`", "v.n")
    chunked = let({"f": findings, "n": f"length({text})",
                   "ch": f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"},
                  f"concat({vbody}, {vtail})", "v")
    return (f"CASE WHEN {text} IS NULL OR size({findings}) = 0 THEN {text} "
            f"WHEN size({findings}) <= {SPLICE_CHUNKED_ABOVE} THEN {direct} ELSE {chunked} END")


def with_masked(df: DataFrame, text: str, findings: str, policy: P.Policy, out: str = "masked_text") -> DataFrame:
    token = replacement_for("f.category", dict(policy.replacements))
    return add(df, {out: splice_sql(ident(text), ident(findings), token)})


def mask(df: DataFrame, text: str = "text", policy: P.Policy | None = None, out: str = "masked_text",
         findings: str = "findings", dotenv: Column | bool = False, custom: Sequence = ()) -> DataFrame:
    """Add ``findings`` and the masked text ``out`` (null text stays null)."""
    policy = policy or P.Policy()
    df = find(df, text, policy, out=findings, dotenv=dotenv, custom=custom)
    return with_masked(df, text, findings, policy, out)
