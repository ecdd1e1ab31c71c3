"""Scalar predicates and helpers as Catalyst expressions (no Python workers).

Each builder takes the SQL text of its input and returns SQL text; wrap with
``F.expr`` (or :func:`column`) to get a ``Column``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy as P
from .sql import case_map, q

# Python's ``\s`` for text also covers U+001C..U+001F; Java's Unicode ``\s``
# does not. Inside a character class this fragment gives Python's set.
WS = r"\s\x1c-\x1f"


def column(sql: str) -> Column:
    return F.expr(sql)


@lru_cache(maxsize=1)
def _decimal_digit_map() -> tuple[str, str]:
    """Every non-ASCII Unicode decimal digit (category Nd) and its ASCII digit."""
    src, dst = [], []
    for cp in range(0x80, 0x110000):
        value = unicodedata.decimal(chr(cp), None)
        if value is not None:
            src.append(chr(cp))
            dst.append(str(value))
    return "".join(src), "".join(dst)


def ascii_digits(s: str) -> str:
    src, dst = _decimal_digit_map()
    return f"translate({s}, {q(src)}, {q(dst)})"


def luhn_valid(s: str) -> str:
    """Luhn checksum over the decimal digits of ``s``; needs 13..19 digits."""
    d = f"regexp_replace({ascii_digits(s)}, '[^0-9]', '')"
    weight = (f"(c, i) -> CASE WHEN i % 2 = length({d}) % 2 "
              f"THEN (CASE WHEN CAST(c AS INT) * 2 > 9 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END) "
              f"ELSE CAST(c AS INT) END")
    total = f"aggregate(transform(split({d}, ''), {weight}), 0, (a, x) -> a + x)"
    return f"((length({d}) BETWEEN 13 AND 19) AND {total} % 10 = 0)"


def shannon_entropy(s: str) -> str:
    """Bits of entropy per character; 0.0 for the empty string."""
    p = f"((length({s}) - length(replace({s}, c, ''))) / length({s}))"
    h = f"aggregate(transform(array_distinct(split({s}, '')), c -> {p} * log2({p})), 0D, (a, x) -> a + x)"
    return f"(CASE WHEN length({s}) = 0 THEN 0D ELSE -{h} END)"


def looks_secret(token: str, min_length: int = P.ENTROPY_MIN_LENGTH,
                 min_bits: float = P.ENTROPY_MIN_BITS) -> str:
    """Long, mixed-class, high-entropy token (candidate tokens are ASCII)."""
    classes = (f"(CAST({token} RLIKE '[a-z]' AS INT) + CAST({token} RLIKE '[A-Z]' AS INT) "
               f"+ CAST({token} RLIKE '[0-9]' AS INT))")
    symbol = f"({token} RLIKE {q(r'[+/=_\-]')})"
    return (f"(length({token}) >= {int(min_length)} AND ({classes} >= 3 OR ({classes} >= 2 AND {symbol})) "
            f"AND {shannon_entropy(token)} >= {float(min_bits)!r}D)")


# Python float() grammar: any Unicode decimal digit, single underscores between
# digits, optional exponent, inf/infinity/nan in any ASCII case. The input is
# already stripped.
_DIGITPART = r"\d(?:_?\d)*"
PY_FLOAT = (
    r"(?U)\A[+\-]?(?:(?:(?:" + _DIGITPART + r")?\." + _DIGITPART + r"|" + _DIGITPART + r"\.?)"
    r"(?:[eE][+\-]?" + _DIGITPART + r")?|(?i:infinity|inf|nan))\z"
)


def is_python_float(s: str) -> str:
    return f"({s} RLIKE {q(PY_FLOAT)})"


def py_strip(s: str) -> str:
    """``str.strip()`` with Python's Unicode whitespace set."""
    return f"regexp_replace({s}, {q(r'(?U)\A[' + WS + r']+|[' + WS + r']+\z')}, '')"


# FIXED VALUES: dotenv values that stay readable.
ENV_SKIP_WORDS = ("true", "false", "yes", "no", "on", "off", "null", "none", "")


def should_mask_env_value(value: str) -> str:
    """Strip, drop one pair of matching quotes, strip; keep words and numbers."""
    inner = py_strip(value)
    quoted = (f"(length({inner}) >= 2 AND substr({inner}, 1, 1) IN ('\"', '\\'') "
              f"AND substr({inner}, -1, 1) = substr({inner}, 1, 1))")
    unq = f"substr({inner}, 2, length({inner}) - 2)"
    inner2 = py_strip(f"(CASE WHEN {quoted} THEN {unq} ELSE {inner} END)")
    words = ", ".join(q(w) for w in ENV_SKIP_WORDS)
    return f"(NOT (lower({inner2}) IN ({words}) OR {is_python_float(inner2)}))"


# FIXED VALUES: vault token prefix and number format.
TOKEN_PREFIX = "PMV_"
TOKEN_FORMAT = TOKEN_PREFIX + "%08d"


def vault_token(n: str) -> str:
    """``PMV_`` + the id zero-padded to 8 digits (wider ids keep all digits)."""
    return f"format_string({q(TOKEN_FORMAT)}, CAST({n} AS BIGINT))"


def replacement_for(category: str, tokens: dict) -> str:
    """Token for a category; a category without one becomes ``keyword``."""
    return case_map(category, tokens, q(P.MISSING_TOKEN))


def priority_of(category: str) -> str:
    return case_map(category, dict(P.PRIORITY), str(P.UNKNOWN_PRIORITY))


def count_label(category: str, count: str) -> str:
    """``"2 emails"`` style label; unknown categories use their own name."""
    one = case_map(category, {k: v[0] for k, v in P.LABELS.items()}, category)
    many = case_map(category, {k: v[1] for k, v in P.LABELS.items()}, category)
    return f"concat(CAST({count} AS STRING), ' ', CASE WHEN {count} = 1 THEN {one} ELSE {many} END)"
