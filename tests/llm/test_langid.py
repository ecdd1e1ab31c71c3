"""Language ID: held-out accuracy, spans, Viterbi against brute force, edge cases."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F
from shroud.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        scores = -rng.random((n, 3)) * 6
        got = langid.viterbi(scores, np.array([0]), np.array([n]), 2.0)
        cost = lambda p: sum(scores[t, s] for t, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert np.isclose(cost(got), max(map(cost, itertools.product(range(3), repeat=n))))


def test_viterbi_windows_are_independent():
    rng = np.random.default_rng(4)
    scores = -rng.random((30, 3)) * 6
    starts, stops = np.array([0, 4, 19]), np.array([4, 19, 30])
    got = langid.viterbi(scores, starts, stops, 1.5)
    for a, z in zip(starts, stops):
        assert (got[a:z] == langid.viterbi(scores[a:z], np.array([0]), np.array([z - a]), 1.5)).all()


def test_held_out_accuracy(spark):
    rows = queries.op7_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def model_of(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"), docs_per_lang=100)


def test_mixed_text_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.lang: r.text[:600] for r in docs.where("n_chars > 700").dropDuplicates(["lang"]).collect()}
    found = langid.spans(model_of(spark), f"{text['de']}\n{text['fr']}\n{text['en']}")
    main = [lang for a, z, lang in found if z - a > 200]
    assert main == ["de", "fr", "en"]


def test_edge_cases(spark, monkeypatch):
    model = model_of(spark)
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 ½ ² --- 日", "x"), (3, "42 !!", "x"), (None, "the and of the that", "x"), (5, "the " * 9000, "x")],
        "doc_id long, text string, __other string")
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 3)) for r in langid.detect(docs, model).collect())
    assert [g for g in got if g[0] in "12"] == [("1", "und", 0.0), ("2", "und", 0.0)]
    assert ("3", "und", 0.0) in got and len([g for g in got if g[0] == "3"]) == 2
    assert ("None", "en", 1.0) in got and ("5", "en", 1.0) in got
    assert langid.detect(docs.where("doc_id = 99"), model).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [(r.lang_pred, r.score) for r in langid.detect(docs, model).collect()] == [("und", 0.0)]


def test_scripts_narrow_candidates():
    words = ["abc", "Γαμμα".lower(), "слово", "日本", "ñandú"]
    assert langid.scripts(words).tolist() == [1, 2, 3, 19, 1]
    starts = langid.SCRIPT_STARTS
    assert (np.diff(starts) > 0).all() and len(starts) == len(langid.SCRIPT_IDS)


def test_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    model = model_of(spark)
    plain = langid.detect(docs.select("doc_id", "text"), model)
    odd = langid.detect(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).select(*plain.columns)
    assert sorted(plain.drop("text").collect()) == sorted(odd.drop("text").collect())


def test_one_path_at_any_length(monkeypatch, spark):
    """Long texts go word by word in pieces, short ones together: the same letters either way, borders of pieces included."""
    model, rng = model_of(spark), np.random.default_rng(6)
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").limit(60).collect() for w in r.text.split()]
    text = " ".join(rng.choice(words, 5000))
    texts = [text, None, "", text[:400], "123", text * 3]
    monkeypatch.setattr(langid, "TOGETHER_WORDS", 10 ** 9)
    monkeypatch.setattr(langid, "BATCH_WORDS", 10 ** 9)
    whole = langid._letters(model, texts)
    for together, batch in ((0, 700), (0, 4999), (100, 1000), (2048, 100_000)):
        monkeypatch.setattr(langid, "TOGETHER_WORDS", together)
        monkeypatch.setattr(langid, "BATCH_WORDS", batch)
        assert np.array_equal(langid._letters(model, texts), whole)


def test_a_text_of_millions_of_characters(spark):
    model = model_of(spark)
    text = "the and of that with this " * 170_000  # 4.4 million characters
    docs = spark.createDataFrame([(1, text, "a"), (2, text[:500], "b")], "doc_id long, text string, lang_pred string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(docs, model).collect()}
    assert rows == {1: ("en", 1.0), 2: ("en", 1.0)}
