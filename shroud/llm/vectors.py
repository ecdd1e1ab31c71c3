"""Shards of distinct vectors or codes, and query blocks joined to them.

Rows that repeat a key (a vector, a code) are one class; a class carries its
smallest row ids, as many as any query can return, so a very common vector
neither unbalances a shard nor fills a neighbour list. A shard is one row of
flat arrays; each block of distinct queries meets each shard once, in an
equi-join on the shard number.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, materialize

SALTS = 64


def usable(vec: Column) -> Column:
    """Not null, not zero, and every component finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """``(id, key)`` -> ``(key, ids)``: each distinct key with its ``ids`` smallest row ids, ascending.

    Two stages over salted groups: no task ranks all rows of a hot key.
    """
    part = Window.partitionBy("key", "salt").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = few.withColumn("n", F.row_number().over(part)).where(F.col("n") <= ids)
    return few.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("id")), 1, ids).alias("ids"))


def shards(distinct: DataFrame, per_shard: int, build: Callable[[pd.DataFrame], dict], schema: str, label: str) -> tuple[DataFrame, int]:
    """One row ``(shard, <schema>)`` for each group of about ``per_shard`` classes, written to the shared folder."""
    distinct = materialize(distinct, label + "-classes")
    n = blocks_of(distinct.count(), per_shard)
    placed = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n))).repartition(n, "shard")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **build(pdf)}])

    return materialize(placed.groupBy("shard").applyInPandas(make, f"shard long, {schema}"), label), n


def flat_ids(lists: pd.Series) -> dict:
    """The classes' row ids as one flat array and each class's end in it."""
    return {"ids": np.concatenate(lists.to_numpy()).astype(np.int64).tobytes(),
            "ends": np.cumsum(lists.map(len).to_numpy()).astype(np.int64).tobytes()}


def split_ids(row: dict) -> list[np.ndarray]:
    return np.split(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)[:-1])


def search(asked: DataFrame, index: DataFrame, n_shards: int, per_block: int,
           find: Callable[[dict, list], Iterator[tuple]], measure: str) -> DataFrame:
    """``(qnum, <measure>, ids)``: what ``find(shard row, query keys)`` yields for each block of queries and shard.

    ``asked(qnum, qkey)`` holds distinct queries; ``find`` yields
    ``(place of the query, measure, row ids)``.
    """
    blocks = blocks_of(asked.count(), per_block)
    block = asked.groupBy(F.pmod(F.xxhash64("qnum"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("qnum", "qkey")).alias("q"))
    block = block.select("block", F.col("q.qnum").alias("qnums"), F.col("q.qkey").alias("qkeys"))
    work = block.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    # A unit of work holds a whole shard: about one unit for each task.
    work = work.join(index, "shard").repartition(blocks * n_shards, "block", "shard")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.float64() if measure.endswith("double") else pa.int32()
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                out = list(find(row, row["qkeys"]))
                if out:
                    place, value, ids = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["qnums"][p] for p in place], pa.int64()), pa.array(value, kind),
                         pa.array(ids, pa.list_(pa.int64()))], ["qnum", measure.split()[0], "ids"])

    return work.mapInArrow(run, f"qnum long, {measure}, ids array<long>")


def distinct_queries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query_id, qkey)`` -> distinct ``(qnum, qkey)`` and ``(query_id, qnum)``; ``qnum`` is the smallest query id."""
    asked = rows.groupBy("qkey").agg(F.min("query_id").alias("qnum"))
    return asked, rows.join(asked, "qkey").select("query_id", "qnum")


def answer(found: DataFrame, members: DataFrame, best: Column, k: int) -> DataFrame:
    """Each query row's ``k`` best rows other than itself.

    First the ``k + 1`` best rows of a distinct query (a query row excludes at
    most itself), then of each query row.
    """
    order = [best, F.col("vec_id")]
    rows = found.select(*[c for c in found.columns if c != "ids"], F.explode("ids").alias("vec_id"))
    top = rows.withColumn("n", F.row_number().over(Window.partitionBy("qnum").orderBy(*order))).where(F.col("n") <= k + 1)
    mine = members.join(top.drop("n"), "qnum").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return mine.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
