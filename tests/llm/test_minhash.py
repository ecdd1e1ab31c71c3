"""MinHash near-dedup against brute force on full shingle sets."""

import random
import re

import numpy as np
import pytest
from shroud.llm import minhash, queries

ODD = [None, "", " \t\n", "One", "one  TWO", "ONE\x0btwo", "a b c", "A b\x0bC", "c é É d", "a a a a a a", "漢 字 x"]


def brute_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def brute(rows, k, part, whole):
    sets = [brute_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    out = [(i, len(sets[n]), low.get(find(n)) if sets[n] else i) for n, (i, _) in enumerate(rows)]
    return [(*r, r[0] is not None and r[0] == r[2]) for r in out]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def near_groups(rng, groups, copies, words=60, changes=2):
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        yield " ".join(base)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(changes + 1)):
                text[rng.randrange(words)] = f"v{rng.randrange(500)}"
            yield " ".join(text)


def test_shingle_sets(monkeypatch):
    for size in (1 << 22, 4):
        monkeypatch.setattr(minhash, "CHUNK_BYTES", size)
        for k in (1, 3, 5):
            for t in [*ODD, "x y z " * 50 + "end of it"]:
                assert len(minhash.shingle_set(t.encode() if t is not None else None, k)) == len(brute_set(t, k))
    one = minhash.shingle_set(b"a b c d e")
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 1 << 22)
    assert np.array_equal(one, minhash.shingle_set(b"A B\tc d  E"))


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_estimates_are_corrected_for_chance(bits):
    rng, hasher = np.random.default_rng(bits), minhash.MinHasher(bits=bits)
    for true in (0.0, 0.5, 0.85):
        got = []
        for _ in range(60):
            both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (int(400 * true), *(2 * [int(400 * (1 - true) / 2)])))
            low = np.stack([hasher.minima(np.concatenate([both, x])) for x in (a, b)])
            sig = hasher.packed(low)
            far = hasher.differing(sig[0], sig[1])
            mixed = low * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            assert far == np.count_nonzero((mixed[0] ^ mixed[1]) & np.uint32(2 ** bits - 1))
            if true == 0.85:
                assert far <= hasher.most_differing(0.85, 6.0)
            got.append(hasher.similarity(far))
        assert abs(np.mean(got) - true) < 0.03


def test_band_keys_find_similar_sets():
    rng, hasher, missed = np.random.default_rng(3), minhash.MinHasher(), 0
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (85, 8, 7))
        keys = hasher.band_keys(np.stack([hasher.minima(np.concatenate([both, x])) for x in (a, b)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0
    assert len(np.unique(keys[0])) == hasher.bands


def similar_block(seed=5):
    rng, hasher = np.random.default_rng(seed), minhash.MinHasher()
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.unique(np.concatenate([base[4 * i:], rng.integers(0, 1 << 63, 4 * i, np.uint64)])) for i in range(12)]
    return hasher, sets, minhash.Block(np.arange(12) * 10, np.full(12, 200), hasher.packed(np.stack([hasher.minima(s) for s in sets])))


def all_of(pairs):
    return {(a, b) for i, j in pairs for a, b in zip(i.tolist(), j.tolist())}


def test_candidates_of_runs_and_blocks(monkeypatch):
    hasher, sets, block = similar_block()
    search = minhash.Candidates(hasher, (85, 100), 5.5)
    est = lambda i, j: hasher.similarity(hasher.differing(block.sig[i], block.sig[j]))
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if hasher.differing(block.sig[i], block.sig[j]) <= search.limit}
    assert {(0, 1), (1, 2), (0, 3)} <= want and (0, 11) not in want
    assert all(est(i, j) > 0.7 for i, j in want)
    runs = np.array([1, 3, 0, 3, 5])
    ends = np.cumsum(runs)
    inside = {(i, j) for i, j in want if np.searchsorted(ends, i, "right") == np.searchsorted(ends, j, "right")}
    for small in (64, 2):  # all at once, and one by one
        monkeypatch.setattr(minhash, "SMALL", small)
        assert all_of(search.in_runs(block, np.array([12]))) == want
        assert all_of(search.in_runs(block, runs)) == inside
    halves = all_of(search.between(block.slice(0, 6), block.slice(6, 12)))
    assert {(i, j + 6) for i, j in halves} == {(i, j) for i, j in want if i < 6 <= j}
    block.part = np.arange(12) % 2
    assert all_of(search.in_runs(block, np.array([12]))) == {(i, j) for i, j in want if (j - i) % 2}


def test_forest_and_common_sizes():
    forest = minhash.Forest(np.array([50, 10, 30, 20, 10]))
    forest.join(np.array([50, 30]), np.array([20, 50]))
    assert forest.joined(np.array([20, 10]), np.array([30, 20])).tolist() == [True, False]
    assert sorted(zip(*(x.tolist() for x in forest.edges()))) == [(30, 20), (50, 20)]
    _, sets, _ = similar_block(3)
    i, j = np.triu_indices(12, 1)
    got = minhash.common_sizes(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), i, j)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = list(near_groups(rng, 12, 8)) + ODD + ["One", "one two"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "only here"), (5, texts[5]), (5, texts[20]), (None, None), (900, texts[4].upper())]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, key string, cls int").repartition(3)
    for part, k in ((85, 3), (60, 2)):
        want = sorted(brute(rows, k, part, 100), key=key)
        got = sorted(map(tuple, minhash.near_duplicates(docs, k=k, threshold=(part, 100)).collect()), key=key)
        assert got == want
    assert len({r[2] for r in want}) < len(rows)


def test_large_group_over_many_blocks(spark, monkeypatch):
    """A bucket of several blocks: the blocks' size reaches the plan, so it can be made small here."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SMALL", 5)
    monkeypatch.setattr(minhash, "SLOT_SHINGLES", 2000)  # a cluster over several slots
    rows = list(enumerate(near_groups(random.Random(9), 2, 90, words=80, changes=4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, minhash.near_duplicates(docs, k=3, threshold=(85, 100)).collect()), key=key)
    assert got == sorted(brute(rows, 3, 85, 100), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert minhash.near_duplicates(docs.where("doc_id > 9")).count() == 0
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_columns(spark):
    df = queries.op13_minhash_dedup(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
