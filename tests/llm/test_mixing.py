"""Mixing: targets, apportionment and taken words against plain re-computation."""

import collections
import heapq
import re

from pyspark.sql import functions as F
from shroud.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def filled(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(limit * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def highest_quotients(claims, seats):
    """Seats one by one to the highest claim / (2 k + 1), ties to the smaller key."""
    heap = [(-c, k, 0) for k, c in claims.items() if c > 0]
    heapq.heapify(heap)
    got = collections.Counter()
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-claims[k] / (2 * n + 3), k, n + 1))
    return got


def test_targets(spark):
    for sizes in ({"a": 10, "b": 4000, "c": 0, "d": 700, None: 90}, {"x": 5}, {"a": 0, "b": 0}, {"b": 1000, "B": 1, "é": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, words long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = filled(sizes) if sum(sizes.values()) else {s: 0 for s in sizes}
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (sizes, got, want)


def test_sainte_lague(spark):
    for seats, claims in ((0, {1: 5.0}), (1, {1: 1.0, 2: 1.0}), (10, {1: 53.0, 2: 24.0, 3: 23.0}), (37, {i: 1.7 ** i for i in range(9)}),
                          (5, {i: 1.0 for i in range(20)}), (200, {1: 1e6, 2: 3.0, 3: 0.0, 4: 17.5})):
        df = spark.createDataFrame([(k, c, seats) for k, c in claims.items()], "key long, claim double, seats long")
        got = {r.key: r.won for r in mixing.sainte_lague(df, [], ["key"], "claim", "seats", "won").collect()}
        want = highest_quotients(claims, seats)
        assert got == {k: want[k] for k in claims}


def test_query_on_documents(spark):
    rows = queries.op3_mix_sources(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for i, d in docs.items()}
    per, took, goal = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        per[s] += r.size
        took[s] += r.taken
        goal[s] = r.target
    assert len(rows) == len(docs) and {r.doc_id: r.source_size for r in rows} == {i: per[d.source] for i, d in docs.items()}
    want = filled(dict(per))
    assert all(abs(goal[s] - want[s]) < 1e-6 for s in want)
    assert all(abs(took[s] - want[s]) <= max(2 * mixing.BLOCK_WORDS, 0.01 * want[s]) for s in want)
    assert sorted(rows) == sorted(queries.op3_mix_sources(spark, SF).collect())


def edge_docs(spark):
    rows = [(1, "a b  c\td\n" * 50, "s"), (1, "a b  c\td\n" * 50, "s"), (2, None, "s"), (3, "", None), (None, "x y z " * 40, None),
            (5, "  lead words here ", "t"), (6, "w " * 5000, "t")]
    return spark.createDataFrame([(i, t, s, "k", 9, 8) for i, t, s in rows],
                                 "doc_id long, text string, source string, row_hash string, start long, quota long")


def test_mixed_texts_hold_the_taken_words(spark):
    docs = edge_docs(spark)
    planned = mixing.taken(mixing.plan(docs, block=8), block=8)
    taken = collections.Counter()
    for r in planned.collect():
        taken[str(r.doc_id)] += r.taken
    out = mixing.mix(docs, block=8)
    assert out.columns == docs.columns
    got = collections.Counter()
    originals = {str(r.doc_id): r.text for r in docs.collect()}
    for r in out.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        got[str(r.doc_id)] += len(words)
        whole = re.findall(r"[^\x20\x09-\x0D]+", originals[str(r.doc_id)])
        assert r.text == originals[str(r.doc_id)] or len(words) < len(whole)
    assert +got == +taken


def test_empty_and_wordless(spark):
    docs = edge_docs(spark)
    assert mixing.taken(mixing.plan(docs.where("doc_id < 0"))).count() == 0
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    rows = mixing.taken(mixing.plan(docs.where("doc_id IN (2, 3)"))).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.taken(mixing.plan(docs)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.05 * r.g for r in rows)


def test_small_sources_reach_their_targets_beside_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rows = [("big", 400)] * 300 + [("tens", 10)] * 40 + [("fifties", 50)] * 8 + [("long", 400)] * 2 + [("one", 10), ("b", 130), ("c", 65), (None, 7)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.taken(mixing.plan(docs)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert len(got) == 8
    for r in got:
        slack = 0.01 * r.g if r.source == "big" else mixing.BLOCK_WORDS / 2 + 1
        assert abs(r.t - r.g) <= slack, r


def test_short_last_block_counts_with_its_size(spark):
    cells = [(c, -(-c // 64)) for c in (0, 7, 64, 65, 100, 130, 640)]
    rows = [(c, n, s, m, owed) for c, n in cells for s in range(max(n, 1)) for m in {1 % max(n, 1), (n - 1) % max(n, 1)}
            for owed in range(2 * c + 1)]
    df = spark.createDataFrame(rows, "cell long, blocks long, shift long, multiplier long, owed long")

    def words(r, quota):
        if r.blocks == 0:
            return 0
        again = [b for b in range(r.blocks) if (r.multiplier * b + r.shift) % r.blocks < quota % r.blocks]
        return quota // r.blocks * r.cell + sum(min(64, r.cell - 64 * b) for b in again)

    for r in df.withColumn("quota", F.expr(mixing._quota(64, 2.0))).collect():
        assert abs(words(r, r.quota) - r.owed) == min(abs(words(r, n) - r.owed) for n in range(2 * r.blocks + 1)), r
