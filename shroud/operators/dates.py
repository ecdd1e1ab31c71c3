"""Dates and times without a list: shapes plus calendar arithmetic.

Four shapes are scanned (year first, year last, day before the month's name,
month's name first), and each match is read into year, month and day and kept
only if that day exists: month lengths and leap years are checked by arithmetic,
not by a parser. A match whose day does not exist is dropped and not retried.
With slashes the month comes first where that gives a day, else the day; with
dots and hyphens the day comes first. All of it is Catalyst expressions in the
narrow detection stage.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from .. import policy as P
from ..functions.scan import Scan, with_tagged_spans
from ..functions.sql import add, case_map, let, q

DATED_T = "ARRAY<STRUCT<start: INT, `end`: INT, category: STRING, value: STRING, iso: STRING>>"

# FIXED VALUES: names of the months in English, German, French and Spanish, and short English ones.
MONTH_NAMES = (
    ("january", "jan", "januar", "janvier", "enero"),
    ("february", "feb", "februar", "février", "febrero"),
    ("march", "mar", "märz", "mars", "marzo"),
    ("april", "apr", "avril", "abril"),
    ("may", "mai", "mayo"),
    ("june", "jun", "juni", "juin", "junio"),
    ("july", "jul", "juli", "juillet", "julio"),
    ("august", "aug", "août", "agosto"),
    ("september", "sep", "sept", "septembre", "septiembre"),
    ("october", "oct", "oktober", "octobre", "octubre"),
    ("november", "nov", "novembre", "noviembre"),
    ("december", "dec", "dezember", "décembre", "diciembre"),
)
MONTHS = {name: n + 1 for n, names in enumerate(MONTH_NAMES) for name in names}

_MONTH = "(?:" + "|".join(sorted(MONTHS, key=lambda n: (-len(n), n))) + ")"
_TIME = r"(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
SHAPES = {
    "year_first": r"(?U)\b[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}" + _TIME + r"\b",
    "year_last": r"(?U)\b[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}\b",
    "day_month": r"(?iuU)\b[0-9]{1,2}(?:st|nd|rd|th|\.|er)? (?:of |de )?" + _MONTH + r"\.?,?(?: de)? [0-9]{4}\b",
    "month_day": r"(?iuU)\b" + _MONTH + r"\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}\b",
}
#: Necessary conditions, cheaper than the shapes.
_GATES = {
    "year_first": r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]",
    "year_last": r"[0-9][-/.][0-9]{1,2}[-/.][0-9]{4}",
    "day_month": r"[0-9](?:st|nd|rd|th|\.|er)? \p{L}[^0-9]{2,16} [0-9]{4}",
    "month_day": r"\p{L}\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}",
}


def date_scans(text: str) -> list[Scan]:
    """One scan for each shape (ids in the order of :data:`SHAPES`)."""
    return [Scan(f"__date{i}", rx, False, f"{text} RLIKE {q('(?i)' + _GATES[name])}") for i, (name, rx) in enumerate(SHAPES.items())]


def day_exists(y: str, m: str, d: str) -> str:
    """SQL: whether day ``d`` of month ``m`` of year ``y`` exists (Gregorian rule)."""
    leap = f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
    length = f"(CASE WHEN {m} = 2 THEN (CASE WHEN {leap} THEN 29 ELSE 28 END) WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"
    return f"({y} >= 1 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND {length})"


def _iso(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {day_exists(y, m, d)} THEN format_string('%04d-%02d-%02d', {y}, {m}, {d}) END"


def iso_of(shape: str, value: str) -> str:
    """SQL: the day a match of ``shape`` names as ``YYYY-MM-DD`` (null if there is no such day)."""
    n = f"transform(regexp_extract_all({value}, '[0-9]+', 0), x -> CAST(x AS INT))" if shape != "year_first" else \
        f"transform(slice(regexp_extract_all({value}, '[0-9]+', 0), 1, 3), x -> CAST(x AS INT))"
    if shape == "year_first":
        return let({"n": n}, _iso("p.n[0]", "p.n[1]", "p.n[2]"), "p")
    if shape == "year_last":
        day_first, month_first = _iso("p.n[2]", "p.n[1]", "p.n[0]"), _iso("p.n[2]", "p.n[0]", "p.n[1]")
        return let({"n": n, "us": f"contains({value}, '/')"}, f"CASE WHEN p.us THEN coalesce({month_first}, {day_first}) ELSE {day_first} END", "p")
    month = case_map(f"regexp_extract(lower({value}), {q(_MONTH)}, 0)", MONTHS, "0")
    return let({"n": n, "m": month}, _iso("p.n[1]", "p.m", "p.n[0]"), "p")


def dated_sql(tagged: str, ids: Sequence[int]) -> str:
    """SQL: findings ``(start, end, category, value, iso)`` of tagged spans whose ids are those of the four shapes."""
    iso = "CASE s.id " + " ".join(f"WHEN {i} THEN {iso_of(name, 's.value')}" for i, name in zip(ids, SHAPES)) + " END"
    row = f"named_struct('start', s.start, 'end', s.`end`, 'category', '{P.DATE}', 'value', s.value, 'iso', {iso})"
    return f"filter(transform({tagged}, s -> {row}), s -> s.iso IS NOT NULL)"


def with_dates(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out`` = every date of the text, of each shape on its own (null and empty texts have none)."""
    from ..functions.sql import ident

    df = with_tagged_spans(df, text, date_scans(ident(text)), "__dates")
    found = dated_sql("__dates", range(len(SHAPES)))
    return add(df, {out: f"CASE WHEN __dates IS NULL THEN CAST(array() AS {DATED_T}) ELSE {found} END"}).drop("__dates")
