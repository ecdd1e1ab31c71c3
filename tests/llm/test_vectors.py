"""Nearest neighbours: HNSW recall, exact Hamming search, and their shared parts."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from shroud.llm import hamming, hnsw, oracles, queries, vectors

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def by_query(rows, value):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r[value])
    return out


def test_hnsw_query_recall_and_scores(spark, table):
    ids, x = table
    rows = queries.op2_hnsw_search(spark, SF).collect()
    got, place = by_query(rows, "vec_id"), {i: n for n, i in enumerate(ids)}
    assert set(got) == {i for i in ids if i % 20 == 0} and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = x @ x[place[q]]
        hits += len(set(found) & set([int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]))
    assert hits >= 0.95 * 20 * len(got)
    assert all(abs(r.score - x[place[r.query_id]] @ x[place[r.vec_id]]) < 1e-12 for r in rows)
    for q, s in by_query(rows, "score").items():
        assert s == sorted(s, reverse=True)


def test_graph_recall_on_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 24))).astype(np.float32)
    g = hnsw.build_graph(x, 16, 64)
    hits = sum(len(set(g.nearest(x[i], 10, 64)) & set(np.argsort(((x - x[i]) ** 2).sum(1))[:10].tolist())) for i in range(100))
    assert hits >= 950


def odd_vectors(spark):
    rng = np.random.default_rng(1)
    hot = [1.0, 0.5, -0.25, 2.0]
    rows = [(i, hot) for i in range(0, 300)] + [(300 + i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 1.0]), (1060, [1.0, float("nan"), 0.0, 1.0]),
             (1080, [1.0, float("inf"), 0.0, 1.0]), (1100, []), (1120, [1.0, 2.0]), (None, hot)]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, qnum int, ids int").repartition(4)


def test_hnsw_hot_vector_and_odd_rows(spark):
    rows, df = odd_vectors(spark)
    usable = {i: np.array(v) for i, v in rows[:360]}
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0, 5, per_shard=40).collect()
    assert {r.query_id for r in got} == {i for i in usable if i % 20 == 0}
    for q, found in by_query(got, "vec_id").items():
        want = sorted((i for i in usable if i != q), key=lambda i: (-float(usable[i] @ usable[q]), i))[:5]
        assert found == want
    assert hnsw.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 5).count() == 0
    few = hnsw.nearest(df.where("vec_id IN (300, 301)"), F.col("vec_id") % 20 == 0, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(300, 1, 301)]


def test_hamming_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.execute(oracles.oracle_sql()["op4_hamming_topk"]).fetchall())
    assert sorted(tuple(r) for r in queries.op4_hamming_topk(spark, SF).collect()) == want


def brute_hamming(codes, q, k):
    near = sorted((int(c ^ codes[q]).bit_count() if c >= 0 or codes[q] >= 0 else (c ^ codes[q]).bit_count(), i)
                  for i, c in codes.items() if i != q)
    return [(i, d) for d, i in near[:k]]


def test_hamming_ties_hot_codes_and_nulls(spark):
    rng = np.random.default_rng(2)
    codes = {i: 77 for i in range(200)} | {200 + i: int(c) for i, c in enumerate(rng.integers(0, 2 ** 62, 40))} | {300 + i: 77 ^ (1 << i) for i in range(40)}
    rows = [(i, c, "x") for i, c in codes.items()] + [(400, None, "x"), (None, 77, "x")]
    df = spark.createDataFrame(rows, "vec_id long, code long, shard string").repartition(3)
    got = hamming.nearest(df, F.col("vec_id") % 20 == 0, 7, "vec_id", F.col("code"), per_shard=30)
    found, far = by_query(got.collect(), "vec_id"), by_query(got.collect(), "distance")
    assert set(found) == {i for i in codes if i % 20 == 0}
    for q in found:
        assert list(zip(found[q], far[q])) == brute_hamming(codes, q, 7)
    assert hamming.nearest(df.where("vec_id < 0"), F.lit(True), 3, "vec_id", F.col("code")).count() == 0


def test_search_stops_only_when_covered():
    rng = np.random.default_rng(3)
    codes = rng.integers(-2 ** 63, 2 ** 63, 3000, dtype=np.int64)
    order, first = hamming.build_tables(codes)
    for q in rng.integers(-2 ** 63, 2 ** 63, 20, dtype=np.int64).tolist() + codes[:5].tolist():
        d = np.bitwise_count(codes.view(np.uint64) ^ np.array([q], np.int64).view(np.uint64)).astype(int)
        nodes, far = hamming.top(codes, order, first, q, 10)
        cut = np.sort(d)[9]
        assert set(nodes.tolist()) == set(np.flatnonzero(d <= cut).tolist()) and (far == d[nodes]).all()


def test_classes_keep_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "id long, key long")
    assert {r.key: r.ids for r in vectors.classes(df, 4).collect()} == {k: [k, k + 3, k + 6, k + 9] for k in range(3)}


@pytest.mark.parametrize("norms", ["one long", "very long", "heavy tail"])
def test_hnsw_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 24))[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "heavy tail":
        x *= np.exp(1.5 * rng.normal(size=1500))[:, None]
    else:
        x[7] *= {"one long": 1e4, "very long": 1e8}[norms]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = by_query(hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20, per_shard=1000).collect(), "vec_id")
    hits = sum(len(set(found) & set([j for j in np.argsort(-(x @ x[q])) if j != q][:20])) for q, found in got.items())
    assert len(got) == 75 and hits >= 0.95 * 20 * 75
