"""Mixing sources to target weights by Sainte-Laguë apportionment, in equal-token blocks.

Sources weigh ``WEIGHTS`` in turn, by code point of their name (null last).
They share ``share`` times all words; a target stops at ``limit`` times its
source's words and the excess is shared again by weight (the level at which
this settles is found with prefix sums over the sources, sorted by
``words / weight``).

Each source's words are dealt to shards of bounded size by a seeded hash of
the document, as many as its own words and rows ask for; a shard's words, in
seeded order of its documents, form a stream cut into blocks of ``block``
words, of which the last may be shorter. The words of the whole mix go to
sources by highest quotients ``target / (2k + 1)``, and each source's words to
its shards in the same way. A shard's ``quota`` is the number of its blocks that
come nearest to its words. It takes all its blocks ``quota div blocks``
times and the first ``quota mod blocks`` of them once more, in a seeded
permutation of block numbers, so nothing is sorted or exploded by block.

A null text has no words; a null source is a source of its own. Repeated rows
are separate documents. Documents without words take nothing. An empty table
gives no rows; if there are no words at all, all targets are 0. Other columns
pass through :func:`mix` and are not read.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions.sql import ident, let, q

from .common import materialize, need

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_WORDS = 4_000_000
SHARD_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of the seeded permutation: primes above any shard's number of blocks.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``(source, words)``, one row per source -> ``(source, words, weight, place, target)``.

    One row per source is sorted as a whole: a list of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("place", F.row_number().over(order).cast("long"))
    s = s.withColumn("weight", F.element_at(wheel, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    # Sources reach their limit in order of words / weight. With the first i at their limit, the level of the rest is
    # (share of all - limits of the first i) / weights of the rest; the first i for which no other source is above settles.
    by_ratio = Window.orderBy(F.col("words") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumns({
        "capped": F.coalesce(F.sum(F.col("words") * limit).over(before), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all": F.sum("words").over(every) * share,
    })
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    fits = F.col("words") * limit >= F.col("level") * F.col("weight")
    level = F.coalesce(F.min(F.when(fits, F.struct(F.col("words") / F.col("weight"), "place", "level"))).over(every)["level"],
                       F.lit(float("inf")))
    target = F.least(F.col("words") * limit, F.when(F.col("words") > 0, level * F.col("weight")).otherwise(0.0))
    return s.select("source", "words", "weight", "place", target.cast("double").alias("target"))


def sainte_lague(claims: DataFrame, group: list[str], key: list[str], claim: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each row when ``seats`` of its group go to the highest quotients ``claim / (2k + 1)``.

    ``seats`` is constant within a group; ties go to the smaller ``key``. Seats
    that any divisor this large or larger gives are taken at once; only the
    few quotients beyond them (about two for a row) are ranked.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(claim).over(w), F.sum((F.col(claim) > 0).cast("int")).over(w)
    c = claims.withColumns({"__all": total, "__n": n})
    sure = F.col(claim) * F.greatest(F.col(seats) - F.col("__n") / 2, F.lit(0.0)) / F.col("__all") + 0.5
    most = F.col(claim) * (F.col(seats) + F.col("__n") / 2) / F.col("__all") + 0.5
    c = c.withColumns({
        "__low": F.when((F.col("__all") > 0) & (F.col(claim) > 0) & (F.col(seats) * 2 > F.col("__n")),
                        F.greatest(F.floor(sure) - 1, F.lit(0))).otherwise(0).cast("long"),
        "__high": F.when((F.col("__all") > 0) & (F.col(claim) > 0), F.least(F.ceil(most) + 1, F.col(seats) + 1)).otherwise(0).cast("long"),
    })
    c = c.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    # Quotients number __low .. __high - 1 of each row, largest first.
    rivals = c.withColumn("__k", F.explode_outer(F.when(F.col("__high") > F.col("__low"),
                                                        F.sequence(F.col("__low"), F.col("__high") - 1))))
    rank = w.orderBy(F.desc_nulls_last(F.col(claim) / (2 * F.col("__k") + 1)), *key)
    won = F.col("__k").isNotNull() & (F.row_number().over(rank) <= F.col("__left"))
    keep = [x for x in claims.columns]
    got = rivals.withColumn("__won", won.cast("long"))
    return (got.groupBy(*[F.col(x) for x in keep]).agg((F.max("__low") + F.sum("__won")).alias(out)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = WEIGHTS, share: float = 1.5, limit: float = 2.0, block: int = BLOCK_WORDS,
         seed: int = 3) -> DataFrame:
    """``(doc_id, row_hash, source, size, source_size, target, start, quota, blocks, shift, multiplier)``.

    ``start`` is the document's place in its shard's stream. The words of block
    ``b`` are taken ``quota div blocks`` times, and once more if
    ``(multiplier * b + shift) mod blocks < quota mod blocks``.
    """
    need(docs, (id_col, text_col, source_col))
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                       h.alias("row_hash"))
    rows = materialize(rows, "mix-sizes")
    # A source's shards follow its own words and rows, so a small source is not spread thin by the size of the rest.
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD_ROWS), F.ceil(F.col("words") / SHARD_WORDS))
    sizes = materialize(sizes.select("source", "words", shards.cast("long").alias("shards")), "mix-sources")
    goal = targets(sizes.select("source", "words"), weights, share, limit)
    # All words of the mix, then each source's, then each shard's.
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0)))).cast("long")
    goal = sainte_lague(goal.withColumn("seats", seats), [], ["place"], "target", "seats", "source_quota").drop("seats")
    goal = goal.join(sizes.select(F.col("source").alias("__source"), "shards"), F.col("source").eqNullSafe(F.col("__source")))
    goal = materialize(goal.drop("__source"), "mix-targets")
    named = goal.select("source", "place", "shards")
    rows = rows.join(named, rows["source"].eqNullSafe(named["source"])).drop(named["source"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row_hash", F.lit(seed)), F.col("shards"))).drop("shards")

    cells = materialize(rows.groupBy("place", "shard").agg(F.sum("size").alias("cell")), "mix-cells")
    cells = cells.join(goal.select("place", "words", "target", "source_quota"), "place")
    cells = sainte_lague(cells, ["place"], ["shard"], "cell", "source_quota", "owed")
    count = F.ceil(F.col("cell") / block)
    spin = F.xxhash64("place", "shard", F.lit(seed + 1))
    primes = F.array(*[F.lit(p).cast("long") for p in _PRIMES])
    cells = cells.withColumn("blocks", count).withColumns({
        "shift": F.when(F.col("blocks") > 0, F.pmod(spin, F.col("blocks"))).otherwise(0),
        "multiplier": F.when(F.col("blocks") > 0, F.pmod(F.element_at(primes, (F.pmod(spin, F.lit(len(_PRIMES))) + 1).cast("int")),
                                                         F.col("blocks"))).otherwise(0)})
    cells = cells.select("place", "shard", F.col("words").alias("source_size"), "target", F.expr(_quota(block, limit)).alias("quota"),
                         "blocks", "shift", "multiplier")
    stream = Window.partitionBy("place", "shard").orderBy("row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    return rows.join(cells, ["place", "shard"]).drop("place", "shard")


def _quota(block: int, limit: float) -> str:
    """SQL: the number of a shard's blocks whose words come nearest to ``owed``; its short last block counts as it is.

    Whole passes over the shard come first. Of the rest, ``r`` blocks in the
    order of the permutation hold ``block * r`` words up to the place ``late``
    of the last block, and then ``block - short`` words less.
    """
    nearest = let({"late": "(multiplier * (blocks - 1) + shift) % blocks", "short": f"cell - {block} * (blocks - 1)", "rest": "owed % cell"},
                  f"IF(v.rest < {block} * v.late + v.short / 2, least(round(v.rest / {block}), v.late), "
                  f"v.late + 1 + greatest(round((v.rest - {block} * v.late - v.short) / {block}), 0))", "v")
    return f"IF(cell = 0, 0L, least((owed div cell) * blocks + CAST({nearest} AS BIGINT), CAST(blocks * {limit} AS BIGINT)))"


def _spans(block: int) -> str:
    """SQL: the document's stretches ``(from, to, times)``, one per block it touches (``to`` exclusive, in its own words)."""
    rest = "quota - (quota div blocks) * blocks"
    times = f"quota div blocks + IF((multiplier * b + shift) % blocks < {rest}, 1, 0)"
    return (f"IF(size = 0 OR blocks = 0, CAST(array() AS ARRAY<STRUCT<a: BIGINT, z: BIGINT, times: BIGINT>>), "
            f"transform(sequence(start div {block}, (start + size - 1) div {block}), b -> named_struct("
            f"'a', greatest(b * {block} - start, 0L), 'z', least((b + 1) * {block} - start, size), 'times', {times})))")


def taken(planned: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Add ``taken``: the words the mix takes of each document, repeats counted."""
    total = f"aggregate({_spans(block)}, 0L, (s, x) -> s + (x.z - x.a) * x.times)"
    return planned.withColumn("taken", F.expr(total))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK_WORDS, seed: int = 3, **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each pass over a document that takes any of its words.

    The first pass holds the words of all its blocks taken at least once, the
    second those taken twice, and so on. A pass over a whole document keeps its
    text as it is; else the words taken keep the white space that follows them.
    """
    decided = plan(docs, id_col, text_col, source_col, block=block, seed=seed, **options)
    spans = decided.select(F.col("row_hash").alias("__row"), "start", F.col("size").alias("words"), F.expr(_spans(block)).alias("spans"))
    # Rows that repeat share a hash: the n-th of them takes the n-th decision.
    spans = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "words", "spans"))).alias("__plans"))
    keyed = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)))
    keyed = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy("__row")))
    out = keyed.join(spans, "__row").withColumn("__plan", F.element_at("__plans", F.col("__nth")))
    most = F.expr("coalesce(array_max(__plan.spans.times), 0L)")
    out = out.withColumn("__pass", F.explode(F.when(most > 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(
        F.array().cast("array<bigint>"))))
    out = out.withColumn("__cut", F.expr("filter(__plan.spans, x -> x.times >= __pass)"))
    pieces = f"regexp_extract_all({ident(text_col)}, {q(WORD + '[\\x20\\x09-\\x0D]*')}, 0)"
    joined = let({"w": pieces, "c": "__cut"},
                 "array_join(flatten(transform(v.c, x -> slice(v.w, CAST(x.a + 1 AS INT), CAST(x.z - x.a AS INT)))), '')", "v")
    whole = "aggregate(__cut, 0L, (s, x) -> s + x.z - x.a) = __plan.words"
    return out.withColumn(text_col, F.expr(f"IF({whole}, {ident(text_col)}, {joined})")).select(*docs.columns)
