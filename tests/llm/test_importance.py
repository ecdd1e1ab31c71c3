"""Importance resampling against a plain version of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from shroud.llm import importance, queries

TEXTS = [None, "", " \t", "One", "one TWO", "Don't stop-now 3.5 x_y", "É è ünïcode ÀB 漢字 a b", "x " * 60 + "y z " * 40, "a\x00b\x7fc"]


def brute_features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in brute_features(t)[1])
    t = Counter(bucket(f) for x in target for f in brute_features(x)[1])
    total_s, total_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (total_s + 10000) / ((s[b] + 1.0) * (total_t + 10000))))
    out = []
    for i, text in docs:
        words, features = brute_features(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = able[:len(able) * percent // 100]
    ranks = [(*r, n + 1) for n, r in enumerate(drawn)]
    return ranks + [(*r, None) for r in able[len(drawn):] + [r for r in out if r[1] < min_words]]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_features(monkeypatch):
    for size in (1 << 22, 3):  # whole texts, and words in many chunks
        monkeypatch.setattr(importance, "CHUNK_BYTES", size)
        for text in TEXTS:
            for order in (1, 2, 3):
                words, _ = brute_features(text)
                want = Counter(zlib.crc32(" ".join(words[i:i + k]).encode()) for k in range(1, order + 1) for i in range(len(words) - k + 1))
                got = list(importance.feature_chunks((text or "").encode(), order))
                assert sum(n for n, _ in got) == len(words)
                assert Counter(x for _, sums in got for x in sums.tolist()) == want


def frames(spark, docs, target):
    docs = spark.createDataFrame([(i, t, 5, "b", 1.0) for i, t in docs], "doc_id long, text string, n long, bucket string, weight double")
    return docs.repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")


def test_whole_result(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choices(words[:50 if i % 4 else 200], k=rng.randrange(5, 80)))) for i in range(200)]
    docs += [(500 + i, t) for i, t in enumerate(TEXTS)] + [(None, docs[3][1]), (None, None), docs[7], docs[7], (900, docs[7][1])]
    target = [" ".join(rng.choices(words[:20], k=30)) for _ in range(10)] + [None, ""]
    for percent, min_words in ((25, 20), (100, 1), (0, 0)):
        got = importance.resample(*frames(spark, docs, target), percent=percent, min_words=min_words).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, target, percent, min_words), key=key)


def test_draws_lean_to_the_target(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["apple", "pear", "plum"] if i % 4 == 0 else ["iron", "zinc", "lead"], k=60))) for i in range(400)]
    rows = importance.resample(*frames(spark, docs, ["apple pear plum plum pear apple"] * 50)).collect()
    drawn = [r.id for r in rows if r.rank is not None]
    assert len(drawn) == 100 and np.mean([i % 4 == 0 for i in drawn]) > 0.9


def test_empty_tables(spark):
    docs, target = frames(spark, [(1, "a b c")], ["a"])
    assert importance.resample(docs.where("doc_id < 0"), target).count() == 0
    rows = importance.resample(docs, target.where("doc_id < 0"), min_words=1, percent=100).collect()
    assert [(r.id, r.n_features, r.rank) for r in rows] == [(1, 5, 1)]


def test_query_columns(spark):
    df = queries.op11_importance_resampling(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
