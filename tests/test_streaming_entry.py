"""Streaming operators, policy serialisation and the driver contract."""

import os

from pyspark.sql import functions as F

from shroud import policy as P
from shroud.session import scratch_path
from shroud.streaming import stream as S


def _write_batches(spark, rows_per_file):
    path = scratch_path(spark, "stream-src")
    for i, rows in enumerate(rows_per_file):
        spark.createDataFrame(rows, "k long, seq long, text string").coalesce(1).write.mode("append").parquet(path)
    return path


def test_mask_stream(spark):
    src = _write_batches(spark, [[(1, 1, "mail a@b.com"), (2, 1, None)], [(3, 1, "ip 10.0.0.1")]])
    stream = S.read_stream(spark, src, "k long, seq long, text string", max_files_per_trigger=1)
    out = S.mask_stream(stream, "text", P.Policy(), keep=("k",))
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    S.run_available(out, sink, ck)
    got = {r.k: r.masked_text for r in spark.read.parquet(sink).collect()}
    assert got == {1: "mail [EMAIL]", 2: None, 3: "ip [IP]"}


def _run_repeats(spark, batches, **options):
    src = _write_batches(spark, batches)
    stream = S.read_stream(spark, src, "k long, seq long, text string", max_files_per_trigger=1)
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    S.run_without_repeats(stream, "k", "seq", "text", sink, ck, **options)
    return sorted((r.k, r.seq, r.text) for r in spark.read.parquet(sink).collect()), ck


def test_repeats_over_gaps_and_late_rows(spark):
    got, _ = _run_repeats(spark, [[(1, 1, "a"), (1, 3, "a"), (2, 9, "z")], [(1, 10, "a"), (1, 20, "b")], [(2, 4, "z"), (1, 30, "b")]])
    assert got == [(1, 1, "a"), (1, 20, "b"), (2, 9, "z")]  # (2, 4) comes after (2, 9) was processed


def test_repeat_state_is_compacted_and_expires(spark):
    import os as _os

    got, ck = _run_repeats(spark, [[(1, i, "a"), (5, 100 + i, "t" if i < 2 else "u")] for i in range(7)] + [[(9, 1, "a")], [(1, 8, "a")]],
                           compact_every=2, expire_after=1)
    names = {n for n in _os.listdir(ck.replace("file:", "") + "/repeat-state") if not n.startswith(".")}
    assert "b=7" in names and "d=0" not in names and "d=8" in names
    assert [g for g in got if g[0] == 5] == [(5, 100, "t"), (5, 102, "u")]
    assert (1, 0, "a") in got and (1, 8, "a") in got  # key 1 was forgotten after its pause


def test_hot_key_in_one_batch_equals_lag(spark):
    import random

    rng = random.Random(2)
    rows = [(1 if i % 3 else 2, i * 3, rng.choice("ab")) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [(None, 1, "a"), (None, 2, "a")], "k long, seq long, text string").repartition(6)
    want, last = [], {}
    for k, s, t in sorted(rows):
        if last.get(k) != t:
            want.append((k, s, t))
        last[k] = t
    got = [tuple(r) for r in S.drop_repeats_batch(df, "k", "seq").collect()]
    assert sorted(g for g in got if g[0] is not None) == want and [g for g in got if g[0] is None] == [(None, 1, "a")]


def test_drop_repeats_batch(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "a")],
                               "k long, seq long, text string")
    got = sorted(tuple(r) for r in S.drop_repeats_batch(df, "k", "seq").collect())
    assert got == [(1, 1, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "a")]


def test_window_report(spark):
    from shroud.operators.detect import find

    rows = [(0, "a@b.com c@d.com"), (1, "ssn 123-45-6789"), (2, "x@y.org")]
    src = scratch_path(spark, "win-src")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(src)
    stream = S.read_stream(spark, src, "doc_id long, text string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 400))
    rep = S.window_report(find(stream, "text", P.Policy()), "ts", "10 minutes", "1 hour")
    sink, ck = scratch_path(spark, "win"), scratch_path(spark, "win-ck")
    S.run_updates(rep, sink, ck)
    got = sorted((r.window_start.isoformat(), r.category, r.n_findings)
                 for r in S.latest_updates(spark, sink, ("window_start", "category")).collect())
    assert [(c, n) for _, c, n in got] == [("email", 2), ("email", 1), ("ssn", 1)] or \
        sorted((c, n) for _, c, n in got) == [("email", 1), ("email", 2), ("ssn", 1)]


def test_stored_policy_is_read_field_by_field(spark, tmp_path):
    from shroud.sources import policy_store as PS

    def read(text):
        (tmp_path / "p.json").write_text(text)
        return PS.load_policy(spark, str(tmp_path / "p.json"))

    p = read('{"enabled_categories": ["email", "bogus"], "replacements": {"email": 5},\n "keywords": ["a", " ", 3]}')
    assert p.enabled == {"email"} and p.token("email") == "5" and p.token("ssn") == "[SSN]" and p.keywords == ("a", "3")
    assert read("not json") == P.Policy() and read("[1, 2]") == P.Policy()
    assert read('{"enabled_categories": "email", "keywords": {}}') == P.Policy()
    assert PS.load_policy(spark, str(tmp_path / "missing.json")) == P.Policy()
    assert P.label_for("ip", 2) == "2 IP addresses" and P.label_for("zzz", 1) == "1 zzz"


def test_policy_store_roundtrip(spark):
    from shroud.sources import policy_store as PS

    path = scratch_path(spark, "policy")
    p = P.Policy(enabled={"email", "ssn"}, keywords=("Titan",)).with_tokens(ssn="<n>")
    PS.save_policy(spark, p, path)
    assert PS.load_policy(spark, path) == p


def test_policy_from_tables(spark):
    from shroud.sources.policy_store import policy_from_tables

    p = policy_from_tables(spark.createDataFrame([("ip", True, None), ("ip", False, "<i>"), ("email", None, "x"), ("q", True, "y")],
                                                 "category string, enabled boolean, replacement string"))
    assert p.enabled == {"ip"} and p.token("ip") == "<i>" and p.token("email") == "x" and p.token("ssn") == "[SSN]"


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert set(df.columns) == {"doc_id", "masked_text", "n_findings", "summary"}
    assert df.count() == 200
    assert set(E.oracle_sql()) <= set(E.queries())


def test_text_files_and_dotenv_routing(spark, tmp_path):
    from shroud.operators.mask import mask
    from shroud.sources.tables import read_text_files

    (tmp_path / "prod.env").write_text("API=abc\nPORT=80\n")
    (tmp_path / "notes.txt").write_text("API=abc mail a@b.com\n")
    df = read_text_files(spark, str(tmp_path))
    out = {os.path.basename(r.path): r.masked_text
           for r in mask(df, "text", P.Policy(), dotenv=F.col("dotenv")).collect()}
    assert out["prod.env"] == "API=[SECRET]\nPORT=80\n"
    assert out["notes.txt"] == "API=abc mail [EMAIL]\n"


def test_hidden_files_are_named_or_staged(spark, tmp_path):
    import pytest

    from shroud.operators.mask import mask
    from shroud.sources.tables import read_text_files

    src = tmp_path / "src"
    src.mkdir()
    for name in (".env", ".env.local", "prod.env", "plain.txt"):
        (src / name).write_text("NAME=value\n")
    with pytest.raises(ValueError, match=r"2 hidden files.*\.env"):
        read_text_files(spark, str(src))
    df = read_text_files(spark, [str(src)], stage_dir=str(tmp_path / "stage"))
    got = {r.file_name: r.masked_text for r in mask(df, "text", P.Policy(), dotenv=F.col("dotenv")).collect()}
    assert got == {".env": "NAME=[SECRET]\n", ".env.local": "NAME=[SECRET]\n", "prod.env": "NAME=[SECRET]\n", "plain.txt": "NAME=value\n"}
    one = read_text_files(spark, str(src / ".env"), stage_dir=str(tmp_path / "stage2")).collect()
    assert [r.file_name for r in one] == [".env"] and one[0].path.endswith("/src/.env")


def test_drop_repeats_with_state_table_across_batches(spark):
    src = _write_batches(spark, [[(1, 1, "a"), (1, 2, "a")], [(1, 3, "b"), (1, 4, "a"), (2, 1, "a")],
                                 [(1, 5, "a"), (2, 2, "a"), (3, 1, None), (3, 2, None)]])
    stream = S.read_stream(spark, src, "k long, seq long, text string", max_files_per_trigger=1)
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    S.run_without_repeats(stream, "k", "seq", "text", sink, ck)
    got = sorted((r.k, r.seq, r.text) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 1, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "a"), (3, 1, None)]
