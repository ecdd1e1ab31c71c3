"""Offset-preserving regex scan ("rx") built only from Catalyst expressions.

Spark has ``regexp_extract_all`` but no "find all with offsets", and
``regexp_instr`` counts UTF-16 units while findings use code points. The scan
therefore marks every match in one ``regexp_replace`` pass with a private
sentinel character, splits on that character, and derives the code-point
offsets from the lengths of the pieces::

    marked = regexp_replace(text, R, "$1<s>$2<s>$3")  # grouped patterns
    marked = regexp_replace(text, R, "<s>$0<s>")      # whole-match patterns
    parts  = split(marked, <s>)  ->  gap0, value1, gap1, value2, ..., gapN

The sentinel is the first Unicode noncharacter (U+FDD0..U+FDEF) absent from the
row, so no text can fake a boundary, and splitting on one plain character takes
the JDK's non-regex fast path. A row that contains all 32 of them falls back to
an exact multi-pass scan (``split`` for the gaps plus ``regexp_extract_all``
for the groups) that yields the same alternation.

Grouped patterns have exactly three capturing groups ``(prefix)(value)(suffix)``;
only the value is reported. No pattern may match the empty string.

Every intermediate array is materialised in its own projection: a lambda that
referenced an unmaterialised array expression would re-evaluate it per element.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import DataFrame

from .sql import SPAN_T, add, empty, ident, let, q

SENTINELS = tuple(chr(c) for c in range(0xFDD0, 0xFDF0))
SENTINEL_COL = "__sx"


@dataclass(frozen=True)
class Scan:
    """One regex scan: column ``out`` receives ``array<struct<start,end,value>>``.

    ``gate`` is SQL text of a necessary condition (rows failing it get an empty
    array without touching the regex); ``parts_out`` keeps the gap/value
    alternation in a column of that name.
    """

    out: str
    regex: str
    grouped: bool = False
    gate: Optional[str] = None
    parts_out: Optional[str] = None
    dense: bool = False  # many matches per row expected (e.g. every word)


def sentinel_sql(text: str) -> str:
    """First noncharacter not present in ``text`` (null if all 32 are)."""
    whens = " ".join(f"WHEN NOT contains({text}, {q(s)}) THEN {q(s)}" for s in SENTINELS)
    return f"(CASE {whens} END)"


def with_sentinel(df: DataFrame, text: str) -> tuple[DataFrame, bool]:
    if SENTINEL_COL in df.columns:
        return df, False
    return add(df, {SENTINEL_COL: sentinel_sql(ident(text))}), True


_SUM = "0, (a, x) -> a + x"


# Arrays up to this size get their prefix sums from Catalyst expressions; longer
# ones (word scans, long line lists) from one vectorised numpy pass.
PYTHON_PREFIX_ABOVE = 128


def with_prefix_sums(df: DataFrame, pairs: Sequence[tuple], dense: bool | Sequence[bool] = False) -> DataFrame:
    """Exclusive prefix sums of int-array columns; ``pairs`` = [(lengths, out)].

    Spark's higher-order functions have no scan, and folding into an array
    accumulator copies it at every step (O(n^2)). Short arrays use blocks of
    ~sqrt(n) elements (O(n^1.5), no accumulator copies, all in Catalyst; each
    stage is one projection for all arrays and every lambda reads materialised
    arrays only). For *dense* arrays (``dense`` per pair), those longer than
    :data:`PYTHON_PREFIX_ABOVE` go to a pandas UDF that only sees those int
    arrays (null for every other row); sparse scans (detectors, where matches
    are rare) stay entirely in Catalyst so their stage keeps no Python step.
    """
    from pyspark.sql import functions as F

    flags = [dense] * len(pairs) if isinstance(dense, bool) else list(dense)
    big, out = {}, {}
    for (src, dst), is_dense in zip(pairs, flags):
        ln = ident(src)
        n = f"coalesce(size({ln}), 0)"
        blk = "CAST(k div r.b AS INT)"
        body = (f"transform(r.l, (x, k) -> r.st[{blk}] + aggregate(slice(r.l, {blk} * r.b + 1, k - {blk} * r.b), "
                f"{_SUM}))")
        with_st = let({"l": "q.l", "b": "q.b", "st": f"transform(q.bs, (y, j) -> aggregate(slice(q.bs, 1, j), {_SUM}))"},
                      body, "r")
        with_bs = let({"l": "p.l", "b": "p.b",
                       "bs": (f"transform(sequence(0, CAST(ceil(size(p.l) / p.b) AS INT) - 1), "
                              f"j -> aggregate(slice(p.l, j * p.b + 1, p.b), {_SUM}))")}, with_st, "q")
        blocks = let({"l": ln, "b": f"greatest(1, CAST(ceil(sqrt({n})) AS INT))"}, with_bs, "p")
        if is_dense:
            py = f"{dst}__py"
            big[py] = F.expr(f"CASE WHEN {n} > {PYTHON_PREFIX_ABOVE} THEN {ln} END")
            out[dst] = f"CASE WHEN {n} <= 0 THEN {empty('ARRAY<INT>')} WHEN {py} IS NOT NULL THEN {py} ELSE {blocks} END"
        else:
            out[dst] = f"CASE WHEN {n} <= 0 THEN {empty('ARRAY<INT>')} ELSE {blocks} END"
    if big:
        from .vectorized import exclusive_cumsum

        df = df.withColumns({k: exclusive_cumsum(v) for k, v in big.items()})
    df = add(df, out)
    return df.drop(*big.keys())


def with_spans(df: DataFrame, text: str, scans: Sequence[Scan]) -> DataFrame:
    """Add one span column per :class:`Scan` (empty array when gated off)."""
    if not scans:
        return df
    t = ident(text)
    df, own = with_sentinel(df, text)
    sx = SENTINEL_COL

    stage1, stage2, stage3, stage4, drop1 = {}, {}, {}, {}, []
    for i, s in enumerate(scans):
        rx = q(s.regex)
        run = f"({t} IS NOT NULL AND ({s.gate or 'true'}))"
        repl = f"concat('$1', {sx}, '$2', {sx}, '$3')" if s.grouped else f"concat({sx}, '$0', {sx})"
        mk, fg, fv, fp, fs = (f"__mk{i}", f"__fg{i}", f"__fv{i}", f"__fp{i}", f"__fs{i}")
        slow = f"{run} AND {sx} IS NULL"
        stage1[mk] = f"CASE WHEN {run} AND {sx} IS NOT NULL THEN regexp_replace({t}, {rx}, {repl}) END"
        stage1[fg] = f"CASE WHEN {slow} THEN split({t}, {rx}, -1) END"
        stage1[fv] = f"CASE WHEN {slow} THEN regexp_extract_all({t}, {rx}, {2 if s.grouped else 0}) END"
        drop1 += [mk, fg, fv]
        if s.grouped:
            stage1[fp] = f"CASE WHEN {slow} THEN regexp_extract_all({t}, {rx}, 1) END"
            stage1[fs] = f"CASE WHEN {slow} THEN regexp_extract_all({t}, {rx}, 3) END"
            drop1 += [fp, fs]
            before = f"CASE WHEN j > 0 THEN {fs}[j - 1] ELSE '' END"
            after = f"{fp}[j]"
        else:
            before, after = "''", "''"
        slow_parts = (f"flatten(transform(sequence(0, size({fv})), j -> CASE WHEN j < size({fv}) "
                      f"THEN array(concat({before}, {fg}[j], {after}), {fv}[j]) "
                      f"ELSE array(concat({before}, {fg}[j])) END))")
        pt, ln, ps = f"__pt{i}", f"__ln{i}", f"__ps{i}"
        stage2[pt] = (f"CASE WHEN {mk} IS NOT NULL THEN split({mk}, {sx}, -1) "
                      f"WHEN {fg} IS NOT NULL THEN {slow_parts} ELSE {empty('ARRAY<STRING>')} END")
        stage3[ln] = f"transform({pt}, x -> length(x))"
        spans = let({"p": pt, "l": ln, "s": ps},
                    "transform(sequence(0, CAST((size(v.p) - 1) div 2 AS INT) - 1), "
                    "j -> named_struct('start', v.s[2 * j + 1], 'end', v.s[2 * j + 1] + v.l[2 * j + 1], "
                    "'value', v.p[2 * j + 1]))", "v")
        stage4[s.out] = f"CASE WHEN size({pt}) < 3 THEN {empty(SPAN_T)} ELSE {spans} END"

    df = add(df, stage1)
    df = add(df, stage2).drop(*drop1)
    df = add(df, stage3)
    df = with_prefix_sums(df, [(f"__ln{i}", f"__ps{i}") for i in range(len(scans))], [s.dense for s in scans])
    df = add(df, stage4)
    kept = {f"__pt{i}": s.parts_out for i, s in enumerate(scans) if s.parts_out}
    if kept:
        df = df.withColumnsRenamed(kept)
    tmp = [f"__{x}{i}" for i in range(len(scans)) for x in ("pt", "ln", "ps") if f"__{x}{i}" not in kept]
    df = df.drop(*tmp)
    if own:
        df = df.drop(SENTINEL_COL)
    return metric_barrier(df, [s.out for s in scans])


def metric_barrier(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Observe the total size of ``arrays`` (published as a query metric).

    The metric node also keeps the optimizer from pushing later filters (such
    as the ``size(x) > 0`` it infers for ``explode``/``inline``) below it by
    substituting the staged expressions into the predicate, which would
    evaluate the scan again inside the filter.
    """
    from pyspark.sql import functions as F

    name = f"shroud_spans_{uuid.uuid4().hex[:10]}"
    total = None
    for a in arrays:
        term = F.coalesce(F.size(F.col(a)), F.lit(0))
        total = term if total is None else total + term
    return df.observe(name, F.sum(total).alias("n_spans"))


TAGGED_T = "ARRAY<STRUCT<id: INT, start: INT, `end`: INT, value: STRING>>"


def with_tagged_spans(df: DataFrame, text: str, scans: Sequence[Scan], out: str) -> DataFrame:
    """All ``scans`` at once into one column ``out``: ``array<(id, start, end, value)>``.

    ``id`` is the scan's index. Only scans whose gate passes for a row enter
    the per-row work array, so every later stage is a single lambda over a
    usually empty array, however many scans there are.
    """
    t = ident(text)
    df, own = with_sentinel(df, text)
    sx = SENTINEL_COL
    live, slow = [], []
    for i, s in enumerate(scans):
        rx = q(s.regex)
        gate = s.gate or "true"
        repl = f"concat('$1', {sx}, '$2', {sx}, '$3')" if s.grouped else f"concat({sx}, '$0', {sx})"
        live.append(f"named_struct('id', {i}, 'm', CASE WHEN {gate} THEN regexp_replace({t}, {rx}, {repl}) END)")
        grp = (f"regexp_extract_all({t}, {rx}, 1)", f"regexp_extract_all({t}, {rx}, 3)") if s.grouped else \
            ("CAST(NULL AS ARRAY<STRING>)", "CAST(NULL AS ARRAY<STRING>)")
        slow.append(f"named_struct('id', {i}, 'g', CASE WHEN {gate} THEN split({t}, {rx}, -1) END, "
                    f"'v', CASE WHEN {gate} THEN regexp_extract_all({t}, {rx}, {2 if s.grouped else 0}) END, "
                    f"'p', {grp[0]}, 's', {grp[1]})")
    df = add(df, {
        "__tk": f"CASE WHEN {t} IS NOT NULL AND {sx} IS NOT NULL THEN array({', '.join(live)}) END",
        "__tf": f"CASE WHEN {t} IS NOT NULL AND {sx} IS NULL THEN array({', '.join(slow)}) END",
    })
    df = add(df, {
        "__tk": "filter(coalesce(__tk, array()), x -> x.m IS NOT NULL)",
        "__tf": "filter(coalesce(__tf, array()), x -> x.g IS NOT NULL)",
    })
    before = "CASE WHEN j > 0 AND x.s IS NOT NULL THEN x.s[j - 1] ELSE '' END"
    after = "CASE WHEN j < size(x.v) AND x.p IS NOT NULL THEN x.p[j] ELSE '' END"
    interleave = (f"flatten(transform(sequence(0, size(x.v)), j -> CASE WHEN j < size(x.v) "
                  f"THEN array(concat({before}, x.g[j], {after}), x.v[j]) ELSE array(concat({before}, x.g[j])) END))")
    df = add(df, {"__tp": (f"concat(transform(__tk, x -> named_struct('id', x.id, 'parts', split(x.m, {sx}, -1))), "
                           f"transform(__tf, x -> named_struct('id', x.id, 'parts', {interleave})))")})
    df = df.drop("__tk", "__tf")
    df = add(df, {"__tp": "transform(filter(__tp, x -> size(x.parts) >= 3), x -> named_struct('id', x.id, "
                          "'parts', x.parts, 'lens', transform(x.parts, p -> length(p))))"})
    df = add(df, {"__tp": "transform(__tp, x -> named_struct('id', x.id, 'parts', x.parts, 'lens', x.lens, "
                          "'b', greatest(1, CAST(ceil(sqrt(size(x.lens))) AS INT))))"})
    df = add(df, {"__tp": (f"transform(__tp, x -> named_struct('id', x.id, 'parts', x.parts, 'lens', x.lens, 'b', x.b, "
                           f"'bs', transform(sequence(0, CAST(ceil(size(x.lens) / x.b) AS INT) - 1), "
                           f"j -> aggregate(slice(x.lens, j * x.b + 1, x.b), {_SUM}))))")})
    df = add(df, {"__tp": (f"transform(__tp, x -> named_struct('id', x.id, 'parts', x.parts, 'lens', x.lens, 'b', x.b, "
                           f"'st', transform(x.bs, (y, j) -> aggregate(slice(x.bs, 1, j), {_SUM}))))")})
    blk = "CAST((2 * j + 1) div x.b AS INT)"
    pre = f"(x.st[{blk}] + aggregate(slice(x.lens, {blk} * x.b + 1, 2 * j + 1 - {blk} * x.b), {_SUM}))"
    span = (f"named_struct('id', x.id, 'start', {pre}, 'end', {pre} + x.lens[2 * j + 1], "
            f"'value', x.parts[2 * j + 1])")
    df = add(df, {out: (f"flatten(transform(__tp, x -> transform(sequence(0, CAST((size(x.parts) - 1) div 2 AS INT) - 1), "
                        f"j -> {span})))")})
    df = df.drop("__tp")
    if own:
        df = df.drop(SENTINEL_COL)
    return df
