"""Resolution of findings tables over range borders against a sequential greedy walk."""

import random

import pytest
from shroud import policy as P
from shroud.operators import resolve as R


def greedy(rows):
    out = []
    for key in {r[0] for r in rows}:
        last = None
        mine = [r for r in rows if r[0] == key]
        for r in sorted(mine, key=lambda r: (r[1], r[1] - r[2], P.PRIORITY.get(r[3], P.UNKNOWN_PRIORITY), r[2], r[3], r[4])):
            if last is None or r[1] >= last:
                out.append(r)
                last = r[2]
    return out


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_against_a_sequential_walk(spark, partitions):
    rng, rows = random.Random(partitions), []
    for key, n, room in ((1, 600, 3000), (2, 5, 20), (None, 120, 300), (7, 1, 9), (8, 300, 900)):
        for _ in range(n):
            start = rng.randrange(room)
            rows.append((key, start, start + rng.randrange(1, 14), rng.choice(["email", "secret", "ip", "other"]), f"v{rng.randrange(9)}"))
    rows += rows[:20]  # equal rows: only one of them can stay
    df = spark.createDataFrame(rows, "k long, start int, `end` int, category string, value string").repartition(5)
    got = R.resolve_exploded(df, "k", partitions)
    assert got.dtypes == [("k", "bigint"), ("start", "int"), ("end", "int"), ("category", "string"), ("value", "string")]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(greedy(rows), key=order)


def test_one_key_spreads_over_its_ranges(spark):
    """Windows run inside ranges, never over a whole key; offsets may be longs."""
    rows = spark.range(4000).selectExpr("'all' AS k", "id * 5000000000 AS start", "id * 5000000000 + 10 + id % 3 AS `end`", "'ip' AS category", "'x' AS value")
    got = R.resolve_exploded(rows, "k", 8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k#" not in plan and "windowspecdefinition(__pid#" in plan
    assert got.count() == 4000 and got.agg({"start": "max"}).first()[0] == 3999 * 5000000000


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, start int, `end` int, category string, value string")
    assert R.resolve_exploded(empty).count() == 0
