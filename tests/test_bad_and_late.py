"""Bad records and late rows: nothing is lost, and replays change nothing."""

import gzip
import os

from pyspark.sql import functions as F
from shroud import policy as P
from shroud.operators.detect import find
from shroud.streaming import late as L
from shroud.streaming import quarantine as Q
from shroud.streaming import stream as S

LINES = [b'{"id":1,"text":"mail a@b.com"}', b'{"id":2,"text":"cut', b'{"id":3,"text":"\xff\xfe"}', b'{"id":4}', b'{"id":"x","text":"t"}', b"",
         b'{"id":5,"text":"","extra":[1]}', b'[1,2]', b'{"id":6,"text":"caf\xc3\xa9 \\n 10.0.0.1"}', b'{"id":6,"text":null}', None]


def test_lines_of_every_kind(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "b binary").select(F.col("b").cast("string").alias("value"))
    checked = Q.checked_lines(df, "id long, text string", ("id", "text"))
    rows = checked.collect()
    assert [r[Q.REASON] for r in rows] == [None, Q.CORRUPT, Q.INVALID_UTF8, Q.MISSING, Q.CORRUPT, Q.CORRUPT, None, Q.CORRUPT, None, Q.MISSING, Q.CORRUPT]
    assert [bytes(r[Q.RAW]) if r[Q.RAW] is not None else None for r in rows] == LINES
    assert Q.good(checked).columns == ["id", "text"] and Q.good(checked).count() == 3
    assert Q.dead_letters(checked).count() == len(LINES) - 3


def test_whole_files(spark, tmp_path):
    files = {"a.txt": b"plain", "b.txt": b"\xc3\x28", "c.gz": gzip.compress("gepackt ä".encode()), "d.gz": gzip.compress(b"x" * 1000)[:20], "e.gz": b"no gzip"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {os.path.basename(r.path): r for r in Q.checked_files(spark, str(tmp_path)).collect()}
    assert {n: (r.text, r[Q.REASON]) for n, r in rows.items()} == {
        "a.txt": ("plain", None), "b.txt": (None, Q.INVALID_UTF8), "c.gz": ("gepackt ä", None), "d.gz": (None, Q.DAMAGED), "e.gz": (None, Q.DAMAGED)}
    assert all(bytes(rows[n][Q.RAW]) == data for n, data in files.items())


def test_stream_goes_on_and_replays(spark, tmp_path):
    src, sink, dead = (str(tmp_path / n) for n in ("in", "out", "dead"))
    os.mkdir(src)
    for n in range(3):
        with open(f"{src}/{n}.txt", "wb") as f:
            f.write(b"\n".join(x.replace(b'"id":1', b'"id":%d' % (10 + n)) for x in LINES if x is not None))
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", "1").load(src)
    for ck in ("ck", "ck2"):  # a second run over the same sinks is a replay of every batch
        Q.run_checked(stream, "id long, text string", ("id", "text"), Q.mask_checked(keep=("id",)), sink, dead, str(tmp_path / ck))
        got = spark.read.parquet(sink)
        assert sorted(r.masked_text for r in got.where("id >= 10").collect()) == ["mail [EMAIL]"] * 3 and got.count() == 9
        assert spark.read.parquet(dead).count() == 3 * 7


def rows_of(spark, times, start=0):
    return spark.createDataFrame([(start + n, t, "mail a@b.com, c@d.org") for n, t in enumerate(times)], "id long, s long, text string").select(
        "id", F.timestamp_seconds("s").alias("ts"), "text")


def test_windows_close_once_and_late_rows_stay(spark, tmp_path):
    src, sink, aside, ck = (str(tmp_path / n) for n in ("in", "out", "late", "ck"))
    schema = rows_of(spark, [1]).schema
    batches = [[0, 59, 61, 130], [10, 65, 200], [None, 119, 121, 400], [5, 399, 1000]]
    rows_of(spark, []).write.parquet(src)
    for b, times in enumerate(batches):
        rows_of(spark, times, 10 * b).write.mode("append").parquet(src)
        found = find(S.read_stream(spark, src, schema), "text", P.Policy())
        L.run_window_report(found, "ts", sink, aside, ck, "1 minute", "60 seconds")
    # Watermarks before the batches: none, 70, 140, 340.
    final = {(r.window_start.timestamp() % 86400, r.category): r.n_findings for r in spark.read.parquet(sink).collect()}
    assert final == {(0, "email"): 2 * 2, (60, "email"): 2 * 2, (120, "email"): 2 * 2, (180, "email"): 2, (360, "email"): 2 * 2}
    assert sorted(r.id for r in spark.read.parquet(aside).collect()) == [10, 20, 21, 30]


def test_a_batch_is_detected_once(spark, tmp_path):
    src, sink, aside, ck = (str(tmp_path / n) for n in ("in", "out", "late", "ck"))
    runs = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<category:string>>")
    def detect(text):
        runs.add(1)
        return [("email",)] * text.count("@") if text else None

    rows_of(spark, []).write.parquet(src)
    for b, times in enumerate([[0, 61, 130], [10, 65, None, 400]]):
        rows = rows_of(spark, times, 10 * b)
        rows.write.mode("append").parquet(src)
        found = S.read_stream(spark, src, rows.schema).withColumn("findings", detect("text"))
        L.run_window_report(found, "ts", sink, aside, ck, "1 minute", "60 seconds")
    assert runs.value == 7
    assert sorted((r.window_start.timestamp() % 86400, r.n_findings) for r in spark.read.parquet(sink).collect()) == [(0, 2), (60, 4), (120, 2)]
    late = spark.read.parquet(aside)
    assert late.columns == ["id", "ts", "text", "batch_id"] and sorted(r.id for r in late.collect()) == [10, 12]
    assert not os.listdir(f"{ck}/report/rows") or all(n.endswith(".crc") for n in os.listdir(f"{ck}/report/rows"))
