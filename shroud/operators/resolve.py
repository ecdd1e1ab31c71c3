"""Overlap resolution: earliest start, then longest, then category priority.

Greedy keep: walk the sorted findings and keep one when it starts at or after
the end of the last kept finding. This is a fold, not a running max
([0,10) [5,15) [12,20) keeps the first and the third).

Two physical forms:

* :func:`with_resolved` — per row, on the findings array (no shuffle).
* :func:`resolve_exploded` — on an exploded findings table, for keys with any
  number of findings: islands of overlapping findings are found by a running
  maximum of earlier ends over range partitions, and the fold runs per island.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import priority_of
from ..functions.sql import FINDING_T, add, empty, ident, let
from ..session import materialize, remove_tables, table_path

SORT_T = ("ARRAY<STRUCT<start: INT, neg_len: INT, prio: INT, `end`: INT, category: STRING, "
          "value: STRING>>")


def _fold_sql(arr: str) -> str:
    """Greedy keep over an ascending array of sort structs (state: last end)."""
    step = ("(acc, f) -> CASE WHEN f.start >= acc.last_end "
            "THEN named_struct('last_end', f.`end`, 'kept', array_append(acc.kept, f)) ELSE acc END")
    init = f"named_struct('last_end', -1, 'kept', {empty(SORT_T)})"
    return f"aggregate({arr}, {init}, {step}, acc -> acc.kept)"


def resolve_sql(raw: str) -> str:
    """SQL: resolved findings of the materialised array column ``raw`` (single fold)."""
    key = (f"named_struct('start', f.start, 'neg_len', f.start - f.`end`, 'prio', {priority_of('f.category')}, "
           f"'end', f.`end`, 'category', f.category, 'value', f.value)")
    ordered = f"sort_array(transform({raw}, f -> {key}))"
    out = ("transform({}, f -> named_struct('start', f.start, 'end', f.`end`, 'category', f.category, "
           "'value', f.value))").format(_fold_sql(ordered))
    return f"coalesce({out}, {empty(FINDING_T)})"


# Rows with at most this many raw findings use one fold (cheapest for the
# common case); longer arrays are cut into islands first.
FOLD_UP_TO = 32


def with_resolved(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``out`` = resolved, ascending, disjoint findings of the ``raw`` array.

    The sorted findings are cut into *islands*: a finding starts one when it
    begins at or after the end of every earlier finding. The greedy state
    cannot cross such a point, so each island is folded on its own and a
    one-finding island is simply kept. The running maximum of earlier ends
    comes from blocks of ~sqrt(k) elements with ``array_max``, so a document
    with very many findings costs O(k^1.5) instead of the O(k^2) array copies
    of one long fold. Intermediates are bound with :func:`let` so no lambda
    recomputes them per element.
    """
    r = ident(raw)
    key = (f"named_struct('start', f.start, 'neg_len', f.start - f.`end`, 'prio', {priority_of('f.category')}, "
           f"'end', f.`end`, 'category', f.category, 'value', f.value)")
    blk = "CAST(i div c.b AS INT)"
    prev_max = f"greatest(d.rp[{blk}], coalesce(array_max(slice(c.re, {blk} * c.b + 1, i - {blk} * c.b)), -1))"
    nxt = "CASE WHEN j + 1 < size(e.ri) THEN e.ri[j + 1] ELSE size(a.rs) END"
    island = (f"CASE WHEN {nxt} - s = 1 THEN array(a.rs[s]) "
              f"ELSE {_fold_sql(f'slice(a.rs, s + 1, {nxt} - s)')} END")
    kept = f"flatten(transform(e.ri, (s, j) -> {island}))"
    final = ("transform({}, f -> named_struct('start', f.start, 'end', f.`end`, 'category', f.category, "
             "'value', f.value))").format(kept)
    step_e = let({"ri": f"filter(sequence(0, size(a.rs) - 1), i -> a.rs[i].start >= {prev_max})"}, final, "e")
    step_d = let({"rp": "transform(c.rm, (x, j) -> coalesce(array_max(slice(c.rm, 1, j)), -1))"}, step_e, "d")
    step_c = let({"re": "b.re", "b": "b.b",
                  "rm": ("transform(sequence(0, CAST(ceil(size(b.re) / b.b) AS INT) - 1), "
                         "j -> array_max(slice(b.re, j * b.b + 1, b.b)))")}, step_d, "c")
    step_b = let({"re": "transform(a.rs, f -> f.`end`)", "b": "greatest(1, CAST(ceil(sqrt(size(a.rs))) AS INT))"},
                 step_c, "b")
    body = let({"rs": f"sort_array(transform({r}, f -> {key}))"},
               f"CASE WHEN size(a.rs) = 0 THEN {empty(FINDING_T)} ELSE {step_b} END", "a")
    return add(df, {out: f"CASE WHEN {r} IS NULL OR size({r}) = 0 THEN {empty(FINDING_T)} "
                         f"WHEN size({r}) <= {FOLD_UP_TO} THEN {resolve_sql(r)} ELSE {body} END"})


def _carried(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(__pid, __carry)``: for each range, the largest ``value`` that earlier ranges hold under the key it begins with.

    ``rows`` are range-partitioned and sorted by key, so ranges that end with
    one key follow each other. One row per range.
    """
    ends = rows.groupBy("__pid").agg(F.min(F.struct(F.col(key).alias("k"))).alias("first"),
                                     F.max(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias("last"))
    so_far = F.max("last.v").over(Window.partitionBy("last.k").orderBy("__pid"))
    ends = ends.select("__pid", "first", F.struct(F.col("last.k").alias("k"), so_far.alias("v")).alias("last"))
    before = F.lag("last").over(Window.orderBy("__pid"))
    ends = ends.select("__pid", "first", before.alias("before"))
    same = F.col("before").isNotNull() & F.col("before.k").eqNullSafe(F.col("first.k"))
    return ends.where(same & F.col("before.v").isNotNull()).select("__pid", F.struct("first.k", "before.v").alias("__carry"))


def _running(rows: DataFrame, key: str, value: str, order: list, last_row: int) -> Column:
    """The largest ``value`` of the key's rows so far (up to ``last_row`` from this one), earlier ranges included.

    Keys ascend in a range, so the largest ``(key, value)`` seen is of the
    present key if any row of it came before.
    """
    own = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
    seen = F.max(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).over(own)
    here = F.when(seen["k"].eqNullSafe(F.col(key)), seen["v"])
    return F.greatest(here, F.when(F.col("__carry").isNotNull() & F.col("__carry.k").eqNullSafe(F.col(key)), F.col("__carry.v")))


def resolve_exploded(findings: DataFrame, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Resolve an exploded findings table ``(key, start, end, category, value)``.

    An island starts where a finding begins at or after every earlier end of
    its key; no keep/drop decision crosses that boundary, so the greedy fold
    runs per island. Rows are range-partitioned by (key, sort order) and the
    ranges frozen in a written table; the running maximum of ends is segmented
    by key inside a range and carried over range borders by one row per range.
    A key with any number of findings spreads over as many tasks as its rows
    need; only the findings of one island (a run of overlapping spans) meet.
    Null keys are one key; offsets may be of any integer type.
    """
    partitions = partitions or int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = findings.select(key, "start", "end", "category", "value").withColumn("__prio", F.expr(priority_of("category")))
    order = [F.col(key), F.col("start"), F.col("start") - F.col("end"), F.col("__prio"), F.col("end"), F.col("category"), F.col("value")]
    ranged = materialize(f.repartitionByRange(partitions, *order).withColumn("__pid", F.spark_partition_id()), "resolve-ranges")
    rows = ranged.join(F.broadcast(_carried(ranged, key, "end")), "__pid", "left")
    rows = rows.withColumn("__ends", _running(rows, key, "end", order, -1)).drop("__carry")
    opens = F.col("__ends").isNull() | (F.col("start") >= F.col("__ends"))
    rows = materialize(rows.withColumn("__open", F.when(opens, F.col("start"))).drop("__ends"), "resolve-islands")
    remove_tables(findings.sparkSession, [table_path(ranged)])
    # The start of the latest island so far names a finding's island.
    islands = rows.join(F.broadcast(_carried(rows, key, "__open")), "__pid", "left")
    islands = islands.withColumn("__island", _running(islands, key, "__open", order, 0))
    near = [(F.col(c) - F.col("__island")).cast("int").alias(c) for c in ("start", "end")]
    grouped = islands.groupBy(key, "__island").agg(F.collect_list(F.struct(*near, "category", "value")).alias("__raw"))
    kept = with_resolved(grouped, "__raw", "__kept").select(key, "__island", F.inline("__kept"))
    types = dict(findings.dtypes)
    return kept.select(key, *[(F.col(c) + F.col("__island")).cast(types[c]).alias(c) for c in ("start", "end")], "category", "value")
