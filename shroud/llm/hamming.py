"""Exact top-k by Hamming distance: incremental multi-index hashing.

Distinct 64-bit codes are dealt to shards of bounded size. A shard's index has
one table for each of four 16-bit segments: code numbers sorted by segment
value and each value's first place, as flat arrays. For a query the search
radius of all segments grows step by step; codes whose segment differs in just
that many bits are looked up and verified. After radius r every code within
distance 4(r + 1) - 1 has been met (one segment differs in at most r bits), so
the search of a shard ends when its kth verified distance is within that.

Null codes and rows with a null id take no part. Rows that repeat a code are
found through their common class; ties in distance go to the smaller id. If
there are fewer candidates than ``k``, all are returned. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import need

SEGMENTS, BITS = 4, 16
_ALL = np.arange(1 << BITS, dtype=np.uint16)
#: All 16-bit masks by number of set bits.
MASKS = [_ALL[np.bitwise_count(_ALL) == r] for r in range(BITS + 1)]


def sign_code(vec: Column) -> Column:
    """A 64-bit code: bit i is set if component i is above 0 (the first 64 components)."""
    bits = F.transform(F.slice(vec, 1, 64), lambda x, i: F.when(x > 0, F.call_function(
        "shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def segments(codes: np.ndarray) -> np.ndarray:
    """(codes, 4) 16-bit segments."""
    return np.ascontiguousarray(codes).view("<u2").reshape(-1, SEGMENTS)


def build_tables(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment: code numbers sorted by its value, and the first place of every value (and the end)."""
    parts = segments(codes)
    order = np.stack([np.argsort(parts[:, s], kind="stable") for s in range(SEGMENTS)]).astype(np.int32)
    first = np.stack([np.searchsorted(parts[order[s], s], np.arange((1 << BITS) + 1)) for s in range(SEGMENTS)]).astype(np.int32)
    return order, first


def top(codes: np.ndarray, order: np.ndarray, first: np.ndarray, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of all codes within the kth smallest distance to ``query``."""
    q = np.array([query], np.int64).view(np.uint64)
    parts = segments(q.view(np.int64))[0]
    met = np.zeros(len(codes), bool)
    nodes, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    count = np.zeros(8 * SEGMENTS * 2 + 2, np.int64)  # verified codes by distance
    for r in range(BITS + 1):
        for s in range(SEGMENTS):
            values = MASKS[r] ^ parts[s]
            lo, hi = first[s][values], first[s][values.astype(np.int64) + 1]
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            if not len(n):
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            new = order[s][at]
            new = new[~met[new]]
            if not len(new):
                continue
            met[new] = True
            d = np.bitwise_count(codes[new].view(np.uint64) ^ q).astype(np.int64)
            nodes.append(new.astype(np.int64))
            far.append(d)
            count += np.bincount(d, minlength=len(count))
        covered = SEGMENTS * (r + 1) - 1
        if count[: covered + 1].sum() >= min(k, len(codes)):
            break
    nodes, far = np.concatenate(nodes), np.concatenate(far)
    cut = int(np.searchsorted(count.cumsum(), min(k, len(codes)), "left"))
    keep = far <= cut
    return nodes[keep], far[keep]


def nearest(table: DataFrame, queries: Column, k: int, id_col: str, code: Column, per_shard: int = 1 << 18,
            per_block: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: for the rows where ``queries`` holds, the ``k`` nearest other rows."""
    need(table, (id_col,))
    rows = table.select(F.col(id_col).cast("long").alias("id"), code.cast("long").alias("key"),
                        F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("key").isNotNull())

    def build(pdf: pd.DataFrame) -> dict:
        codes = pdf["key"].to_numpy(np.int64)
        order, first = build_tables(codes)
        return {"codes": codes.tobytes(), "order": order.tobytes(), "first": first.tobytes(), **vectors.flat_ids(pdf["ids"])}

    schema = "codes binary, order binary, first binary, ids binary, ends binary"
    index, n = vectors.shards(vectors.classes(rows.select("id", "key"), k + 1), per_shard, build, schema, "mih")

    def find(row: dict, keys: list) -> Iterator[tuple]:
        codes = np.frombuffer(row["codes"], np.int64)
        order = np.frombuffer(row["order"], np.int32).reshape(SEGMENTS, -1)
        first = np.frombuffer(row["first"], np.int32).reshape(SEGMENTS, -1)
        ids = vectors.split_ids(row)
        for place, key in enumerate(keys):
            nodes, far = top(codes, order, first, key, k + 1)
            # Codes at the last distance tie; their smallest k + 1 ids decide.
            best = sorted((d, i) for node, d in zip(nodes.tolist(), far.tolist()) for i in ids[node].tolist())[: k + 1]
            for d, i in best:
                yield place, d, [i]

    asked, members = vectors.distinct_queries(rows.where("q").select(F.col("id").alias("query_id"), F.col("key").alias("qkey")))
    hits = vectors.search(asked, index, n, per_block, find, "distance int")
    return vectors.answer(hits, members, F.col("distance"), k).select("query_id", "rank", "vec_id", "distance")
