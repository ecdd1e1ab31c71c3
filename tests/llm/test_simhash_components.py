"""SimHash near-dedup and connected components against brute force."""

import random
import re

import numpy as np
import xxhash
from shroud.llm import queries, simhash
from shroud.llm.components import connected_components


def brute_fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint_definition(monkeypatch):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "A b\x0bC d\x1ce é É", "x " * 500 + "y z " * 300, "Ünï cödé ÀB " * 40]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == want
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 7)  # words in many chunks
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == want


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 6, dtype=np.int64)
    near = np.concatenate([base] + [base ^ (1 << rng.integers(0, 63, 6)) for _ in range(30)])
    prints = np.unique(np.concatenate([near, rng.integers(0, 2 ** 63, 100, dtype=np.int64)]))
    prints = prints[np.argsort(np.bitwise_count(prints.view(np.uint64)), kind="stable")]
    a, b = prints[::2].copy(), prints[1::2].copy()
    for left, right, same in ((a, b, False), (a, a, True)):
        far = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :])
        pairs = [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(far <= 3))]
        u, v = simhash.forest(left, right, 3, same)
        nodes = set(left.tolist()) | set(right.tolist())
        assert classes(nodes, pairs) == classes(nodes, zip(u.tolist(), v.tolist()))
        assert len(u) < len(nodes)


def docs_frame(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    long = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(4)]
    texts = [(i, t) for i, t in enumerate(long * 3)]
    texts += [(20 + i, t.replace("w7 ", "w8 ", 1)) for i, t in enumerate(long)]
    texts += [(40, None), (41, ""), (42, "Hello"), (43, "hello"), (None, long[0]), (None, "only here with no id"), (42, "Hello")]
    return spark.createDataFrame([(i, t, "a", "b", 1) for i, t in texts],
                                 "doc_id long, text string, fp string, root string, n_chars long").repartition(3)


def test_components_match_brute_force(spark):
    docs = docs_frame(spark)
    rows = simhash.near_duplicates(docs, tile_rows=4).collect()
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in texts})
    comp = classes(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    low = {}
    for i, f in texts:
        if i is not None:
            low[comp[f]] = min(low.get(comp[f], i), i)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.id, r.fp % 2 ** 64, r.component_id) for r in rows), key=key) == sorted(
        ((i, f, low.get(comp[f])) for i, f in texts), key=key)


def kept_by_hand(rows):
    """How many rows stay of each component, and which ids and components they may have."""
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = classes(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 3])
    low = {}
    for (i, _), f in zip(rows, prints):
        low.setdefault(comp[f], []).append(i)
    return sorted((c, min((i for i in ids if i is not None), default=-1)) for c, ids in low.items()), comp


def test_one_of_each_group_stays(spark):
    docs = docs_frame(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want, comp = kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((comp[brute_fingerprint(r.text)], -1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == want


def test_repeated_ids_with_different_texts_lose_nothing(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(300)]) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (5, b), (3, b), (5, b), (None, c), (None, c), (None, d), (9, d), (5, d), (3, b), (None, None), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(i, t, n % 2) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(4)
    want, comp = kept_by_hand(rows)
    got = simhash.keep_one(docs, tile_rows=2).collect()
    assert sorted((comp[brute_fingerprint(r.text)], -1 if r.doc_id is None else r.doc_id) for r in got) == want
    assert {(r.doc_id, r.text) for r in got} >= {(5, a), (3, b), (None, c), (5, d)}
    assert set(map(tuple, got)) == set(map(tuple, simhash.keep_one(docs.repartition(2)).collect()))


def test_empty_documents(spark):
    none = docs_frame(spark).where("doc_id < 0")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_query_columns(spark):
    df = queries.op5_simhash_dedup(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in df.limit(50).collect())


def test_connected_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1080)]
    star = [(2000, i) for i in range(2001, 2100)]
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + chain + star + [(5, 5), (9, 8), (8, 9), (8, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == classes(nodes, [(a, b) for a, b in edges if a != b])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
