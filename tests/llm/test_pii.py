"""Personal data: base spans against plain Python, added spans, redaction, boosted trees."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from shroud.llm import boosting, pii, queries

SF = "/root/testdata/sf0.01"


def base(text):
    text, out = text or "", []

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
              ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
              ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
              ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))
    for kind, pattern, ok in checks:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m[0])]
    return ",".join(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


def found(spark, texts, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    out = pii.detect(df, model)
    cols = [F.expr(pii.listing("pii_base")).alias("base"), F.expr(pii.listing("pii")).alias("spans")]
    return {r.doc_id: r for r in pii.redact(out.select("*", *cols)).collect()}


ALL_SENTINELS = "".join(chr(c) for c in range(0xFDD0, 0xFDF0))
CASES = ["a@b.com_x@y.org é1.2.3.4.5", "x%+-@a-.b 00000000255.1.1.1 256.1.1.1 4-1 1 1", "+++12345678901 ()", None, "", "a@b..c a@b.c..d @ a@@b.c",
         "4111 1111-1111 1111", "5-5-5 4111111111111111", "+1 415 555 2671 x", ALL_SENTINELS + " a@b.co 1.2.3.4", "😀 1.2.3.4 😀 a@b.co"]


def test_base_spans_on_odd_and_random_texts(spark, model):
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("0123456789 .-+()@ab_%\ufdd0é😀") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    got = found(spark, texts, model)
    assert [got[i].base for i in range(len(texts))] == [base(t) for t in texts]
    for i, t in enumerate(texts):
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_added_spans_and_redaction(spark, model):
    got = found(spark, ["pay 4465758382889437 4465758382889437 now", "+1 (564) 555-4526 227.5.221.1", None, "clean words only"], model)
    assert got[0].spans == "card:4:20,card:21:37" and got[0].base == ""
    assert got[0].text == "pay [CARD] [CARD] now"
    assert "227" not in got[1].text and "555" not in got[1].text
    assert got[2].text is None and got[3].text == "clean words only"


def test_other_ways_of_writing_are_found(spark, model):
    cases = {"call (415) 555-2671 now": "phone:5:19", "abroad 0049 30 1234567 ok": "phone:7:22", "so 415-555-2671.": "phone:3:15",
             "host 10[.]0[.]0[.]1 up": "ip:5:19", "jane (at) corp (dot) com": "email:0:24", "4111.1111.1111.1111 x": "card:0:19",
             "Tel.: 030 1234 567 x": "phone:6:18"}
    got = found(spark, list(cases), model)
    assert {t: got[i].spans for i, t in enumerate(cases)} == cases


def test_look_alikes_are_left_alone(spark, model):
    """Planted numbers that are nobody's: at most one in fifty is taken for personal data."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [lambda: f"order {digits(8)} shipped", lambda: f"id {digits(4)} {digits(4)} {digits(3)} done", lambda: f"version {rng.randrange(300, 999)}[.]1[.]2[.]3",
              lambda: f"build {digits(10)} ok", lambda: f"sum {digits(3)} {digits(3)} {digits(4)} total", lambda: f"look at (dot) {digits(3)}"]
    texts = [rng.choice(makers)() for _ in range(600)]
    got = found(spark, texts, model)
    wrong = [t for i, t in enumerate(texts) if len(got[i].spans.split(",")) > len(got[i].base.split(",")) or (got[i].spans and not got[i].base)]
    assert len(wrong) <= len(texts) // 50, wrong[:9]


def test_overlapping_kinds_are_hidden_whole(spark, model):
    got = found(spark, ["to +4111111111111 1 x"], model)  # a phone whose digits may also be a card
    assert not re.search("[0-9]{4}", got[0].text)


def test_query(spark):
    rows = queries.op6_pii(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [sum(s[0] == k for s in spans) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_empty_table_repeats_and_extra_columns(spark, model):
    df = spark.createDataFrame([(1, "a@b.com", 5, "v"), (1, "a@b.com", 5, "v"), (None, "a@b.com", 6, "w")],
                               "doc_id long, text string, start int, value string")
    out = pii.detect(df, model)
    assert out.columns == df.columns + ["pii_base", "pii"]
    assert [len(r.pii) for r in out.collect()] == [1, 1, 1]
    assert pii.detect(df.where("start = 9"), model).count() == 0
    none = pii.train(df.where("start = 9"))
    assert all(v is None for v in none.kinds.values())
    assert [len(r.pii) for r in pii.detect(df, none).collect()] == [1, 1, 1]


def test_long_text(spark, model):
    text = "x a@b.com 4111111111111111 " * 2000 + "0" * 50_000 + " " + "a." * 50_000
    assert found(spark, [text], model)[0].base == base(text)


def test_plan_is_native(spark, model):
    df = pii.detect(spark.read.parquet(f"{SF}/documents.parquet"), model)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_boosting_learns_and_scores_as_sql(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (800, 3))
    y = ((x[:, 0] > 2) & (x[:, 1] < 4)).astype(float)
    w = rng.integers(1, 4, 800).astype(float)
    m = boosting.calibrate(boosting.fit(x[:600], y[:600], w[:600]), x[600:], y[600:], w[600:])
    p = m.probability(x[600:])
    assert ((p > 0.5) == (y[600:] > 0.5)).mean() > 0.98
    cut = boosting.threshold(p, y[600:], w[600:], 0.99)
    assert 0.5 <= cut < 1 and (y[600:][p >= cut]).mean() >= 0.99
    df = spark.createDataFrame([tuple(map(int, r)) for r in x[600:]], "a int, b int, c int")
    got = [r.p for r in df.selectExpr(f"{m.probability_sql(['a', 'b', 'c'])} AS p").collect()]
    assert np.allclose(got, p)


def test_query_counts_the_base_spans(spark, tmp_path):
    """Added spans are in the list of all spans only: counts and digest are the base patterns' own."""
    cases = ["call (415) 555-2671 now", "host 10[.]0[.]0[.]1 up", "jane (at) corp (dot) com", "+49 30 1234567 and 030 1234 567", None, "a@b.co 1.2.3.4"]
    texts = [*cases, *(f"tel 0049 30 {n:07d}, mail u{n}@corp.com, pay 4111 1111 1111 {n % 10000:04d}, sum {n} {n}" for n in range(1, 40_000, 131))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in b.split(",")) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
    assert any(len(r.spans) > len(base(texts[r.doc_id])) for r in rows)  # the method has added some
