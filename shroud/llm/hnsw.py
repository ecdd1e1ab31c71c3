"""Approximate nearest neighbours by largest inner product: an HNSW graph per shard.

Distinct vectors are dealt to shards of bounded size by a hash. One task builds
a shard's hierarchical navigable small-world graph and stores it as flat
arrays: the vectors, and for each layer one neighbour table (node x slots, -1
for none). Edges go by Euclidean distance with one more component,
sqrt(M^2 - |x|^2) with the largest norm M, under which nearest means largest
inner product. Searches go by the inner product itself, in double precision,
and start both from the upper layers and from the best of a shard's ``HEAD``
longest vectors. Blocks of distinct queries search every shard; the shards' results are merged
and scored on the original vectors in double precision.

Vectors that are null, empty, zero or hold a null or non-finite component take
no part, neither as queries nor as candidates; nor do rows with a null id or
with another length than the most common one. Rows that repeat a vector are
found through their common class; ties go to the smaller id. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import need

Near = list[tuple[float, int]]  # (squared distance or negative inner product, node)
At = tuple[float, float] | None  # a point's square and lift; None to go by inner product

HEAD = 1024


class Graph:
    """A navigable small-world graph over the rows of ``x``, by Euclidean distance.

    ``lift`` is one more component of every row. It is kept apart, so that its
    size does not drown the others' differences; a graph with it is searched by
    largest inner product.
    """

    def __init__(self, x: np.ndarray, slots: int, lift: np.ndarray | None = None):
        self.x, self.slots, self.lift = x, slots, lift
        self.square = (x * x).sum(axis=1)
        # Long vectors win many inner products, whatever their direction: a search starts from the best of them, too.
        self.long = None if lift is None else np.argsort(-self.square, kind="stable")[:HEAD]
        self.layers: list[np.ndarray] = []
        self.entry, self.height = -1, -1
        self._seen, self._turn = np.zeros(len(x), np.int32), 0

    def _far(self, q: np.ndarray, at: At, nodes: np.ndarray) -> np.ndarray:
        if at is None:
            return -(self.x[nodes] @ q)
        far = self.square[nodes] + at[0] - 2 * (self.x[nodes] @ q)
        return far if self.lift is None else far + (self.lift[nodes] - at[1]) ** 2

    def _at(self, node: int) -> At:
        return float(self.square[node]), 0.0 if self.lift is None else float(self.lift[node])

    def _walk(self, q: np.ndarray, at: At, start: Near, width: int, layer: int) -> Near:
        """The ``width`` nearest nodes that a best-first walk of the layer meets, nearest first."""
        table, seen = self.layers[layer], self._seen
        self._turn += 1
        turn = self._turn
        seen[[n for _, n in start]] = turn
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, n) for d, n in start]
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = table[node]
            near = near[(near >= 0) & (seen[near] != turn)]
            if not len(near):
                continue
            seen[near] = turn
            far = self._far(q, at, near)
            if len(best) >= width:
                close = far < -best[0][0]
                near, far = near[close], far[close]
            for dist, n in zip(far.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-dist, n))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, n))
                else:
                    continue
                heapq.heappush(todo, (dist, n))
        return sorted((-d, n) for d, n in best)

    def _descend(self, q: np.ndarray, at: At, down_to: int) -> Near:
        near = [(float(self._far(q, at, np.array([self.entry]))[0]), self.entry)]
        for layer in range(self.height, down_to, -1):
            near = self._walk(q, at, near[:1], 1, layer)
        return near

    def _spread(self, nodes: np.ndarray, far: np.ndarray, count: int) -> np.ndarray:
        """``count`` neighbours in different directions, from ``nodes`` sorted by distance ``far``.

        A node is passed over if it is nearer to one chosen before than to the
        centre; nodes passed over fill places that are left.
        """
        if len(nodes) <= count:
            return nodes
        square = self.square[nodes]
        apart = square[:, None] + square[None, :] - 2 * (self.x[nodes] @ self.x[nodes].T)
        if self.lift is not None:
            apart += (self.lift[nodes][:, None] - self.lift[nodes][None, :]) ** 2
        shorter = apart < far[:, None]
        blocked, chosen = np.zeros(len(nodes), bool), []
        for i in range(len(nodes)):
            if not blocked[i]:
                chosen.append(i)
                if len(chosen) == count:
                    return nodes[chosen]
                blocked |= shorter[:, i]
        rest = np.ones(len(nodes), bool)
        rest[chosen] = False
        return nodes[chosen + np.flatnonzero(rest)[: count - len(chosen)].tolist()]

    def insert(self, node: int, level: int, width: int) -> None:
        while len(self.layers) <= level:
            self.layers.append(np.full((len(self.x), self.slots if self.layers else 2 * self.slots), -1, np.int32))
        if self.entry < 0:
            self.entry, self.height = node, level
            return
        q, at = self.x[node], self._at(node)
        near = self._descend(q, at, level)
        for layer in range(min(level, self.height), -1, -1):
            near = self._walk(q, at, near, width, layer)
            table = self.layers[layer]
            mine = self._spread(np.array([n for _, n in near]), np.array([d for d, _ in near]), self.slots)
            table[node, :len(mine)] = mine
            for other in mine.tolist():
                row = table[other]
                free = int((row >= 0).sum())
                if free < len(row):
                    row[free] = node
                    continue
                pool = np.append(row, node)
                far = self._far(self.x[other], self._at(other), pool)
                order = np.argsort(far, kind="stable")
                table[other] = self._spread(pool[order], far[order], len(row))
        if level > self.height:
            self.entry, self.height = node, level

    def nearest(self, q: np.ndarray, count: int, width: int) -> list[int]:
        at = (float(q @ q), 0.0) if self.lift is None else None
        start = self._descend(q, at, 0)
        if self.long is not None:
            far = self._far(q, at, self.long)
            best = np.argsort(far, kind="stable")[:max(width, count)]
            # One entry a node: its product may round differently beside other nodes.
            both = {n: d for d, n in [*start, *zip(far[best].tolist(), self.long[best].tolist())]}
            start = sorted((d, n) for n, d in both.items())[:max(width, count)]
        near = self._walk(q, at, start, max(width, count), 0)
        return [n for _, n in near[:count]]


def build_graph(x: np.ndarray, slots: int, width: int, seed: int = 1, lift: np.ndarray | None = None) -> Graph:
    """Insert all rows; a node's top layer is geometric, as usual for these graphs."""
    g = Graph(x, slots, lift)
    drawn = np.random.default_rng(seed).random(len(x))
    for node, level in enumerate(np.floor(-np.log(1 - drawn) / math.log(slots)).astype(int).tolist()):
        g.insert(node, level, width)
    return g


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))


def _load(row: dict, slots: int) -> tuple[Graph, np.ndarray]:
    x = np.frombuffer(row["vecs"], np.float64).reshape(-1, row["dim"])
    g = Graph(x, slots, _lift(x, row["norm"]))
    g.layers = [np.frombuffer(t, np.int32).reshape(len(x), -1) for t in row["layers"]]
    g.entry, g.height = row["entry"], row["height"]
    return g, x


def nearest(table: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            per_shard: int = 8192, slots: int = 16, build_width: int = 64, search_width: int = 64,
            per_block: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows where ``queries`` holds, the ``k`` nearest other rows found."""
    need(table, (id_col, vec_col))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("key"),
                        F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & vectors.usable(F.col("key")))
    shape = rows.groupBy(F.size("key").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("key") == (shape["d"] if shape else 0))
    length = F.sqrt(F.aggregate("key", F.lit(0.0), lambda s, x: s + x * x))
    norm = float(rows.agg(F.max(length).alias("m")).first()["m"] or 0.0)

    def build(pdf: pd.DataFrame) -> dict:
        x = np.stack(pdf["key"].to_numpy()).astype(np.float64)
        g = build_graph(x, slots, build_width, lift=_lift(x, norm))
        return {"vecs": x.tobytes(), "dim": x.shape[1], "norm": norm, "entry": g.entry, "height": g.height,
                "layers": [t.tobytes() for t in g.layers], **vectors.flat_ids(pdf["ids"])}

    schema = "vecs binary, dim int, norm double, entry int, height int, layers array<binary>, ids binary, ends binary"
    index, n = vectors.shards(vectors.classes(rows.select("id", "key"), k + 1), per_shard, build, schema, "hnsw")

    def find(row: dict, keys: list) -> Iterator[tuple]:
        g, x = _load(row, slots)
        ids = vectors.split_ids(row)
        for place, key in enumerate(keys):
            q = np.array(key)
            found = g.nearest(q, k + 1, search_width)
            for node, score in zip(found, (x[found] * q).sum(axis=1).tolist()):
                yield place, score, ids[node].tolist()

    asked, members = vectors.distinct_queries(rows.where("q").select(F.col("id").alias("query_id"), F.col("key").alias("qkey")))
    hits = vectors.search(asked, index, n, per_block, find, "score double")
    return vectors.answer(hits, members, F.desc("score"), k).select("query_id", "rank", "vec_id", "score")
