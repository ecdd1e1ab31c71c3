"""Findings per event-time window over many micro-batches, with late rows kept aside.

A batch's watermark is the latest event time of all earlier batches less the
allowed delay. A row whose window had ended by then is late: it goes to a side
table instead of silently out of the count. All other rows add to the partial
counts of their windows; a window is final, and written once, when the
watermark after a batch has passed its end, and open ones are carried on to the
next batch. Everything is written per batch id (late rows, counts, finished and
open windows, the watermark), so a replayed batch replaces what it wrote. Counts
are pre-aggregated: a batch adds one row for each window and category. A batch
is read once, into a table that holds each row's counts instead of its findings;
everything else reads that table, so detection runs once for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import counts_sql
from .stream import _delete_paths, _path_exists

MARK_SCHEMA = "watermark timestamp"
PART_SCHEMA = "window_start timestamp, window_end timestamp, category string, n_findings long"


def watermark_before(spark: SparkSession, root: str, batch_id: int):
    """The watermark that holds for a batch (None for the first)."""
    if batch_id == 0:
        return None
    path = f"{root}/watermark/b={batch_id - 1}"
    if not _path_exists(spark, path):
        raise RuntimeError(f"the watermark of batch {batch_id - 1} is missing under {root}")
    return spark.read.schema(MARK_SCHEMA).parquet(path).first()["watermark"]


def run_window_report(found: DataFrame, ts: str, sink: str, late_sink: str, checkpoint: str, window: str = "10 minutes",
                      delay: str = "1 hour", findings: str = "findings"):
    """Drain a stream with a findings column; ``sink`` gets final counts, ``late_sink`` the late rows (all columns but the findings).

    A null event time belongs to no window: such rows count as late.
    """
    root = checkpoint.rstrip("/") + "/report"

    def step(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        mark = watermark_before(spark, root, batch_id)
        put = lambda df, place: df.write.mode("overwrite").parquet(place)
        # A micro-batch is computed anew, detection included, by every action on it.
        counted = batch.withColumn("__n", F.expr(counts_sql(findings))).drop(findings)
        put(counted, f"{root}/rows/b={batch_id}")
        batch = spark.read.schema(counted.schema).parquet(f"{root}/rows/b={batch_id}")
        rows = batch.withColumn("__w", F.window(ts, window))  # leaves out rows without a time
        late = F.lit(False) if mark is None else F.col("__w.end") <= F.lit(mark)
        aside = rows.where(late).drop("__w").unionByName(batch.where(F.col(ts).isNull())).drop("__n")
        put(aside, f"{late_sink.rstrip('/')}/batch_id={batch_id}")
        parts = rows.where(~late).select("__w", F.explode("__n").alias("category", "n"))
        parts = parts.groupBy("__w", "category").agg(F.sum("n").cast("long").alias("n_findings"))
        put(parts.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), "category", "n_findings"),
            f"{root}/parts/b={batch_id}")
        # The watermark never goes back; null until a row with a time has come.
        latest = batch.agg((F.max(ts) - F.expr(f"INTERVAL {delay}")).cast("timestamp").alias("w"))
        put(latest.select(F.greatest("w", F.lit(mark).cast("timestamp")).alias("watermark")), f"{root}/watermark/b={batch_id}")
        now = watermark_before(spark, root, batch_id + 1)
        counts = spark.read.schema(PART_SCHEMA).parquet(f"{root}/parts/b={batch_id}")
        if batch_id:
            counts = counts.unionByName(spark.read.schema(PART_SCHEMA).parquet(f"{root}/open/b={batch_id - 1}"))
        counts = counts.groupBy("window_start", "window_end", "category").agg(F.sum("n_findings").cast("long").alias("n_findings"))
        ended = F.lit(False) if now is None else F.col("window_end") <= F.lit(now)
        put(counts.where(ended), f"{sink.rstrip('/')}/batch_id={batch_id}")
        put(counts.where(~ended), f"{root}/open/b={batch_id}")
        _delete_paths(spark, [f"{root}/rows/b={batch_id}"])
        # The tables of the batch before stay: this batch may be replayed.
        _delete_paths(spark, [f"{root}/{kind}/b={batch_id - 2}" for kind in ("parts", "open", "watermark") if batch_id >= 2])

    q = found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
