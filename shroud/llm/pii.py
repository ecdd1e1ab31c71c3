"""Personal data: base patterns, candidate generators, boosted trees, calibrated cuts.

Base spans (leftmost, non-overlapping per kind, in code points) are found by
four patterns and checked (octets, Luhn, digit counts). High-recall generators
propose further, possibly overlapping spans: pieces of text in which a greedy
base match failed, spaced or bracketed forms, numbers without a plus. Boosted
trees over format and context features score every proposal; a cut per kind,
calibrated on held-out rows, accepts it. Accepted proposals that touch no base
span and no earlier accepted one are added.

Everything on the data path is one narrow Catalyst plan. The trees are fitted on
the proposals of all documents, which Spark merges to weighted feature rows (the
features are few and coarse; ``sample_rows`` bounds the different rows that the
classifier is fitted on). A proposal is an example if its normalised value
passes its kind's check: brackets undone, and for phones a plus, a leading
``00``, an area code in the usual 3-3-4 form, or a word such as ``tel`` before
it. Each proposal is also written in other ways (``10[.]0[.]0[.]1``, ``(at)``,
points between the groups of a card, ``00``, area codes, a home number) and
altered (a changed last digit, a lifted octet, a lost point, bare digits), and
every form is labelled by the same check.

Null text counts as empty: no spans. Repeated rows and null ids are kept.
Finding costs time in proportion to the text; adding and merging cost
proposals times spans of the one document. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.scan import Scan, with_spans
from shroud.functions.sql import add, ident, let, q
from shroud.operators.mask import splice_sql

from . import boosting
from .common import need

KINDS = ("email", "ip", "card", "phone")

#: Base patterns, matching just what the plain ones do, but starting only where a run of their first class starts.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals; every repetition is bounded, so a start costs at most a few hundred characters.
PROPOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[{]\x20?(?i:at|@)\x20?[)\]}]\x20?|@)[A-Za-z0-9-]{1,63}"
             r"(?:(?:\x20?[(\[{]\x20?(?i:dot|\.)\x20?[)\]}]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{1,4}|[0-9]{4}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}"
            r"|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}"
             r"(?![0-9A-Za-z])",
}
#: Necessary conditions of both patterns of a kind.
GATE = {
    "email": "({t} LIKE '%@%' OR {t} RLIKE '(?i)[(\\\\[{{] ?at ?[)\\\\]}}]')",
    "ip": "{t} RLIKE '[0-9](\\\\.|\\\\[\\\\.\\\\])[0-9]'",
    "card": "{t} RLIKE '[0-9]([ .-]?[0-9]){{12}}'",
    "phone": "{t} RLIKE '[0-9][0-9 ().-]{{5}}'",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = 24
_HINTS = r"(?i)\b(?:e-?mail|mail|contact|write|tel|phone|call|fax|mobile|card|visa|credit|pay|ip|host|server|addr(?:ess)?|from|to)\b"
_AGAINST = r"(?i)(?:\b(?:version|v|id|token|hash|commit|sha|order|isbn|build|serial|key)\b|[=#/_])"
_BRACKETS = r"(?i) ?[(\[{{] ?(?:{}) ?[)\]}}] ?"
#: A phone's area code form, and words that call what follows a phone.
_AREA = r"^(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}$"
_CALLED = r"(?i)\b(?:tel|phone|call|fax|mobile|cell)\b[^0-9A-Za-z]{0,4}(?:(?:no|number|at|me|us|us at|me at)\b[^0-9A-Za-z]{0,3})?$"
FEATURES = ("digits", "marks", "form", "luhn", "octets", "at", "tail", "left", "right", "hint", "distinct", "size", "called", "brackets")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL: whether the digit string ``d`` (a bound name) passes Luhn."""
    x = f"CAST(substr({d}, i, 1) AS INT)"
    step = f"(s, i) -> s + IF((length({d}) - i) % 2 = 1, 2 * {x} - IF({x} > 4, 9, 0), {x})"
    return f"(length({d}) > 0 AND aggregate(sequence(1, greatest(length({d}), 1)), 0, {step}) % 10 = 0)"


def _valid(kind: str, v: str) -> str:
    """SQL: the base check of a match ``v`` of the kind."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{v} RLIKE {q('^' + _OCTET + '(?:[.]' + _OCTET + '){3}$')}"
    if kind == "card":
        return let({"d": _digits(v)}, f"length(w.d) BETWEEN 13 AND 19 AND {_luhn('w.d')}", "w")
    return f"length({_digits(v)}) BETWEEN 9 AND 15"


def _class(c: str) -> str:
    """SQL: 0 none or white space, 1 letter, 2 digit, 3 point, 4 other."""
    return (f"CASE WHEN {c} = '' OR {c} RLIKE '^\\\\s' THEN 0 WHEN {c} RLIKE '^[\\\\p{{L}}]' THEN 1 WHEN {c} RLIKE '^[0-9]' THEN 2 "
            f"WHEN {c} = '.' THEN 3 ELSE 4 END")


def _form(v: str) -> str:
    """SQL: 3 a plus, 2 two noughts, each with as many digits as such a phone has; 1 an area code form; else 0."""
    n = f"length({_digits(v)})"
    return (f"CASE WHEN startswith({v}, '+') AND {n} BETWEEN 9 AND 15 THEN 3 WHEN startswith({v}, '00') AND {n} BETWEEN 11 AND 17 THEN 2 "
            f"WHEN {v} RLIKE {q(_AREA)} THEN 1 ELSE 0 END")


def _features(v: str, before: str, after: str) -> dict[str, str]:
    d = _digits(v)
    return {
        "digits": f"least(length({d}), 20)",
        "marks": f"least(length(regexp_replace({v}, '[^ .()-]', '')), 8)",
        "form": _form(v),
        "luhn": f"IF({let({'d': d}, _luhn('w.d'), 'w')}, 1, 0)",
        "octets": f"IF({_valid('ip', _plain('ip', v))}, 1, 0)",
        "at": f"IF(contains({_plain('email', v)}, '@'), 1, 0)",
        "tail": f"least(length(regexp_extract({_plain('email', v)}, '[.]([A-Za-z]+)$', 1)), 8)",
        "left": _class(f"right({before}, 1)"),
        "right": _class(f"left({after}, 1)"),
        "hint": f"1 + IF({before} RLIKE {q(_HINTS)}, 1, 0) - IF({before} RLIKE {q(_AGAINST)}, 1, 0)",
        "distinct": f"size(array_distinct(split({d}, '')))",
        "size": f"least(length({v}) div 4, 16)",
        "called": f"IF({before} RLIKE {q(_CALLED)}, 1, 0)",
        "brackets": f"IF({v} RLIKE '[\\\\[{{]|[(] ?[a-zA-Z@.]', 1, 0)",
    }


def _plain(kind: str, v: str) -> str:
    """SQL: the value with brackets undone."""
    if kind == "email":
        at = f"regexp_replace({v}, {q(_BRACKETS.format('at|@'))}, '@')"
        return f"regexp_replace({at}, {q(_BRACKETS.format('dot|[.]'))}, '.')"
    return f"replace(replace({v}, '[', ''), ']', '')" if kind == "ip" else v


def _example(kind: str, v: str, before: str) -> str:
    """SQL: whether a proposal is real data, by its normalised value (and for phones what stands before it)."""
    if kind == "email":
        return f"{_plain(kind, v)} RLIKE {q('^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}$')}"
    if kind == "phone":
        return f"({_form(v)} > 0 OR {before} RLIKE {q(_CALLED)} AND length({_digits(v)}) BETWEEN 7 AND 15)"
    return _valid(kind, _plain(kind, v))


def _variants(kind: str, v: str, before: str) -> list[tuple[str, str]]:
    """SQL of ``(value, what stands before)``: the proposal, the same value in other ways of writing, and altered copies."""
    if kind == "email":
        others = [f"replace({v}, '@', ' (at) ')", f"replace(replace({v}, '@', ' [at] '), '.', ' [dot] ')", f"replace({_plain(kind, v)}, '.', '')"]
    elif kind == "ip":
        others = [f"replace({_plain(kind, v)}, '.', '[.]')", f"concat('7', lpad({v}, length({v}) + 1, '8'))"]
    elif kind == "card":
        changed = f"concat(left({v}, length({v}) - 1), CAST((CAST(right({v}, 1) AS INT) + 1) % 10 AS STRING))"
        others = [f"translate({v}, ' -', '..')", changed]
    else:
        d = f"lpad({_digits(v)}, 10, '5')"
        home = f"concat('0', substr({d}, -9, 2), ' ', substr({d}, -7, 4), ' ', substr({d}, -3))"
        area = f"substr({d}, -10, 3), {{}}, substr({d}, -7, 3), '-', substr({d}, -4)"
        others = [f"IF(startswith({v}, '+'), concat('00', substr({v}, 2)), {v})", f"concat('(', {area.format(q(') '))})", f"concat({area.format(q('-'))})",
                  home, _digits(v), f"concat(substr({d}, -10, 4), ' ', substr({d}, -6, 3), ' ', substr({d}, -3))"]
        return [(v, before)] + [(x, before) for x in others] + [(home, "'tel: '")]
    return [(x, before) for x in (v, *others)]


def _proposals_sql(kind: str, spans: str, parts: str, text_n: str = "") -> str:
    """SQL: the kind's proposals with what stands before and after them."""
    return (f"transform({spans}, (x, i) -> named_struct('start', x.start, 'end', x.`end`, 'value', x.value, "
            f"'before', right({parts}[2 * i], {CONTEXT}), 'after', left({parts}[2 * i + 2], 1)))")


def with_proposals(df: DataFrame, text: str) -> DataFrame:
    """Add ``__base_<kind>`` (checked base spans) and ``__prop_<kind>`` (proposals with context)."""
    need(df, (text,))
    scans = []
    for kind in KINDS:
        gate = GATE[kind].format(t=ident(text))
        scans.append(Scan(f"__raw_{kind}", BASE[kind], gate=gate))
        scans.append(Scan(f"__gen_{kind}", PROPOSE[kind], gate=gate, parts_out=f"__part_{kind}"))
    df = with_spans(df, text, scans)
    df = add(df, {f"__base_{k}": f"transform(filter(__raw_{k}, x -> {_valid(k, 'x.value')}), "
                                 f"x -> named_struct('start', x.start, 'end', x.`end`))" for k in KINDS}
             | {f"__prop_{k}": _proposals_sql(k, f"__gen_{k}", f"__part_{k}") for k in KINDS})
    return df.drop(*[f"__{x}_{k}" for x in ("raw", "gen", "part") for k in KINDS])


@dataclass(frozen=True)
class PiiModel:
    """Per kind: boosted trees and the calibrated cut (None: nothing to learn from, so nothing is added)."""

    kinds: dict


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 50_000, precision: float = 0.98) -> PiiModel:
    """Fit on the proposals of all documents, merged to weighted rows, of which at most ``sample_rows`` different ones (by hash) are used."""
    need(docs, (text_col,))
    found = with_proposals(docs.select(F.col(text_col).alias("t")), "t")
    rows = None
    for k, kind in enumerate(KINDS):
        one = found.select(F.explode(f"__prop_{kind}").alias("p"))
        written = ", ".join(f"named_struct('v', {v}, 'before', {before})" for v, before in _variants(kind, "p.value", "p.before"))
        one = one.select(F.col("p.after").alias("after"), F.explode(F.expr(f"array({written})")).alias("e"))
        one = one.select("after", F.col("e.before").alias("before"), F.struct("e.v", F.expr(f"IF({_example(kind, 'e.v', 'e.before')}, 1, 0)").alias("y")).alias("e"))
        one = one.select(F.lit(k).alias("kind"), F.col("e.y").alias("y"),
                         *[F.expr(e).cast("int").alias(f) for f, e in _features("e.v", "before", "after").items()])
        rows = one if rows is None else rows.unionByName(one)
    merged = rows.groupBy("kind", "y", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    merged = merged.orderBy(F.xxhash64("kind", "y", *FEATURES)).limit(sample_rows).collect()
    models = {}
    for k, kind in enumerate(KINDS):
        part = [r for r in merged if r["kind"] == k]
        y, w = np.array([r["y"] for r in part], float), np.array([r["n"] for r in part], float)
        if not part or not 0 < y.sum() < len(y):
            models[kind] = None
            continue
        x = np.array([[r[f] for f in FEATURES] for r in part], np.int64)
        held = np.arange(len(part)) % 4 == 0  # rows come in hash order
        model = boosting.calibrate(boosting.fit(x[~held], y[~held], w[~held]), x[held], y[held], w[held])
        p = model.probability(x[held])
        models[kind] = (model, boosting.threshold(p, y[held], w[held], precision))
    return PiiModel(models)


SPAN = "STRUCT<kind: INT, start: INT, `end`: INT>"


def detect(df: DataFrame, model: PiiModel, text_col: str = "text", base_out: str = "pii_base", out: str = "pii") -> DataFrame:
    """Add ``base_out`` and ``out`` (base and added spans): ``array<struct<kind,start,end>>`` by kind, then start."""
    df = with_proposals(df, text_col)
    tagged = lambda k, a: f"transform({a}, x -> named_struct('kind', {k}, 'start', x.start, 'end', x.`end`))"
    base = "concat(" + ", ".join(tagged(k, f"__base_{kind}") for k, kind in enumerate(KINDS)) + ")"
    df = add(df, {base_out: base})
    fresh = {}
    for k, kind in enumerate(KINDS):
        new = f"filter(__prop_{kind}, p -> NOT array_contains(__base_{kind}, named_struct('start', p.start, 'end', p.`end`)))"
        known = model.kinds.get(kind)
        if known is None:
            fresh[kind] = f"CAST(array() AS ARRAY<{SPAN}>)"
            continue
        trees, cut = known
        feats = let(_features("p.value", "p.before", "p.after"), f"{trees.probability_sql([f'z.{f}' for f in FEATURES])} >= {cut!r}D", "z")
        clear = f"NOT exists({ident(base_out)}, b -> b.start < p.`end` AND p.start < b.`end`)"
        fresh[kind] = tagged(k, f"filter(filter({new}, p -> {clear}), p -> {feats})")
    df = add(df, {"__fresh": "concat(" + ", ".join(fresh.values()) + ")"})
    key = "named_struct('start', x.start, 'neg', x.start - x.`end`, 'kind', x.kind, 'end', x.`end`)"
    fold = (f"aggregate(sort_array(transform(__fresh, x -> {key})), named_struct('last', -1, 'kept', CAST(array() AS ARRAY<{SPAN}>)), "
            "(a, x) -> IF(x.start >= a.last, named_struct('last', x.`end`, 'kept', array_append(a.kept, "
            "named_struct('kind', x.kind, 'start', x.start, 'end', x.`end`))), a), a -> a.kept)")
    df = add(df, {out: f"IF(size(__fresh) = 0, {ident(base_out)}, sort_array(concat({ident(base_out)}, {fold})))"})
    return df.drop("__fresh", *[f"__{x}_{k}" for x in ("base", "prop") for k in KINDS])


def listing(spans: str) -> str:
    """SQL: ``kind:start:end`` of every span, comma-joined."""
    names = "element_at(array(" + ", ".join(q(k) for k in KINDS) + "), x.kind + 1)"
    return f"array_join(transform({ident(spans)}, x -> concat_ws(':', {names}, x.start, x.`end`)), ',')"


def redact(df: DataFrame, spans: str = "pii", text_col: str = "text") -> DataFrame:
    """Replace the spans in ``text_col`` by ``[KIND]``; touching spans of several kinds become one, named after the first."""
    names = "element_at(array(" + ", ".join(q(f"[{k.upper()}]") for k in KINDS) + "), f.kind + 1)"
    key = "transform({}, x -> named_struct('start', x.start, 'end', x.`end`, 'kind', x.kind))".format(ident(spans))
    union = ("aggregate(sort_array({}), CAST(array() AS ARRAY<STRUCT<start: INT, `end`: INT, kind: INT>>), "
             "(a, x) -> IF(size(a) > 0 AND x.start < a[size(a) - 1].`end`, "
             "concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, "
             "'end', greatest(x.`end`, a[size(a) - 1].`end`), 'kind', a[size(a) - 1].kind))), array_append(a, x)))").format(key)
    df = add(df, {"__cut": f"coalesce({union}, CAST(array() AS ARRAY<STRUCT<start: INT, `end`: INT, kind: INT>>))"})
    return add(df, {text_col: splice_sql(ident(text_col), "__cut", names)}).drop("__cut")
