"""Structured Streaming: continuous masking, repeat suppression, windowed reports.

* :func:`mask_stream` — stateless: every micro-batch is masked with the same
  narrow plan as batch masking (the watch loop, with source and sink apart).
* :func:`run_without_repeats` — a row is processed only when its text differs
  from the previous row of the same key in true order (consecutive repeats
  only), over gaps and across micro-batches. Rows are range-partitioned by
  (key, sequence) and compared with their neighbour; only one row per range
  crosses a border, so a hot key spreads over all tasks. The last row per key
  is kept in a state table.
* :func:`window_report` — findings per category per event-time window with a
  watermark bounding the state.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..operators.detect import guard
from ..operators.mask import mask
from ..operators.report import counts_sql
from ..session import materialize


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                fmt: str = "parquet", glob: str | None = None, spread_to: int | None = None) -> DataFrame:
    """File stream of a folder (optionally only files matching ``glob``).

    ``spread_to`` deals each micro-batch round-robin over that many tasks; use
    it when micro-batches hold few large files (e.g. one row group each).
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.load(path)
    return df.repartition(spread_to) if spread_to else df


def mask_stream(stream: DataFrame, text: str = "text", policy: P.Policy | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """Masked stream ``(keep..., masked_text, n_findings, summary)``; null text passes."""
    from ..operators.report import with_report

    out = with_report(mask(stream, text, policy or P.Policy()))
    return out.select(*keep, "masked_text", "n_findings", "summary")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                  fmt: str = "parquet", processing_time: str | None = None):
    """Drain what is available (or run every ``processing_time``) into ``sink``."""
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start(sink)
    if not processing_time:
        q.awaitTermination()
    return q


def run_updates(df: DataFrame, sink: str, checkpoint: str):
    """Update-mode stream drained into an append-only log ``(batch_id, ...)``.

    Each micro-batch appends the rows it updated; :func:`latest_updates` keeps
    the last version per key. Batch ids make a replayed batch harmless.
    """
    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(sink)

    q = (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_updates(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    log = spark.read.parquet(sink)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "batch_id")


def _changed(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """``(key, seq, __hash, __old)`` -> the new rows (``__old`` false) whose hash differs from the row before them.

    The range partition ids are frozen by writing the small table. Inside a
    range a window compares neighbours; the first row of a range is compared
    with the last row of the nearest range before it (one row per range).
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [key, seq, "__new", "__hash"]  # state rows sort before new ones
    ranged = rows.select(key, seq, "__hash", (~F.col("__old")).alias("__new")).repartitionByRange(n, *order)
    ranged = materialize(ranged.withColumn("__pid", F.spark_partition_id()), "repeat-ranges")
    own = Window.partitionBy("__pid").orderBy(*order)
    here = F.struct(F.col(key).alias("k"), F.col("__hash").alias("h"))
    marked = ranged.withColumns({"__prev": F.lag(here).over(own), "__first": F.row_number().over(own) == 1})
    ends = ranged.groupBy("__pid").agg(F.max_by(here, F.struct(*order)).alias("__end"))
    border = ends.select("__pid", F.lag("__end").over(Window.orderBy("__pid")).alias("__before"))
    joined = marked.join(F.broadcast(border), "__pid")
    prev = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev"))
    repeat = prev.isNotNull() & prev["k"].eqNullSafe(F.col(key)) & (prev["h"] == F.col("__hash"))
    return joined.where(F.col("__new") & ~F.coalesce(repeat, F.lit(False))).select(key, seq, "__hash")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__hash", F.sha2(F.coalesce(F.col(text), F.lit("\u0000null")), 256))


def _keep(df: DataFrame, changed: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of ``df`` that are in ``changed``; of rows equal in key, sequence and text, one."""
    c = changed.select(F.col(key).alias("__k"), F.col(seq).alias("__s"), F.col("__hash").alias("__h")).distinct()
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col(seq).eqNullSafe(F.col("__s")) & (F.col("__hash") == F.col("__h"))
    return df.join(c, same, "left_semi").dropDuplicates([key, seq, "__hash"])


def drop_repeats_batch(df: DataFrame, key: str, seq: str, text: str = "text") -> DataFrame:
    """Rows whose text differs from the previous row of the same key in order of ``seq`` (gaps are fine)."""
    h = _hashed(df, text)
    rows = h.select(key, seq, "__hash", F.lit(False).alias("__old"))
    return _keep(h, _changed(rows, key, seq), key, seq).select(*df.columns)


def window_report(masked_findings: DataFrame, ts: str, window: str = "10 minutes",
                  watermark: str = "1 hour") -> DataFrame:
    """Finding counts per (event-time window, category), watermarked."""
    per_row = guard(masked_findings.select(ts, "findings")).select(ts, F.explode(F.expr(counts_sql("findings"))).alias("category", "n"))
    return (per_row.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), "category")
            .agg(F.sum("n").cast("long").alias("n_findings"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "category", "n_findings"))


def run_without_repeats(stream: DataFrame, key: str, seq: str, text: str, sink: str, checkpoint: str,
                        then=None, processing_time: str | None = None, compact_every: int = 20, expire_after: int | None = None):
    """Repeat suppression over micro-batches, with the last row per key as a state table.

    Each micro-batch is compared in true order, state rows first: a row is
    compared with the row before it in the batch, or with the key's last row of
    earlier batches. Rows that arrive after a later row of their key was
    processed are compared by arrival, with that last row. ``then`` transforms
    the kept rows before they are written to ``sink/batch_id=N``.

    A batch writes only the keys it changed (``repeat-state/d=N``); every
    ``compact_every`` batches the state becomes one table (``repeat-state/b=N``)
    and older versions are deleted. Keys not seen for ``expire_after`` batches
    are forgotten then (None: never). All writes are per batch id, so a
    replayed batch is harmless; a missing state version is an error.
    """
    root = checkpoint.rstrip("/") + "/repeat-state"

    def state_before(spark: SparkSession, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        at = batch_id - 1
        parts = []
        while at >= 0:
            full = f"{root}/b={at}"
            if _path_exists(spark, full):
                parts.append(spark.read.parquet(full))
                break
            delta = f"{root}/d={at}"
            if not _path_exists(spark, delta):
                raise RuntimeError(f"repeat state of batch {at} is missing under {root}")
            parts.append(spark.read.parquet(delta))
            at -= 1
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        newest = F.max_by(F.struct("__seq", "__hash", "__batch"), "__batch").alias("s")
        return rows.groupBy(key).agg(newest).select(key, "s.__seq", "s.__hash", "s.__batch")

    def step(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        cur = _hashed(batch, text).withColumn("__seq", F.col(seq).cast("long"))
        state = state_before(spark, batch_id)
        rows = cur.select(key, "__seq", "__hash", F.lit(False).alias("__old"))
        if state is not None:
            # The key's state stands before its first row of this batch, whatever its own sequence was.
            first = rows.groupBy(key).agg(F.min("__seq").alias("__low"))
            old = state.join(first, state[key].eqNullSafe(first[key])).select(state[key], F.col("__low").alias("__seq"), "__hash")
            rows = rows.unionByName(old.withColumn("__old", F.lit(True)))
        kept = _keep(cur, _changed(rows, key, "__seq"), key, "__seq").select(*batch.columns)
        out = then(kept) if then else kept
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        last = cur.groupBy(key).agg(F.max_by(F.struct("__seq", "__hash"), F.struct("__seq", "__hash")).alias("l"))
        last = last.select(key, "l.__seq", "l.__hash", F.lit(batch_id).cast("long").alias("__batch"))
        last.write.mode("overwrite").parquet(f"{root}/d={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            whole = state_before(spark, batch_id + 1)
            if expire_after is not None:
                whole = whole.where(F.col("__batch") > batch_id - expire_after)
            whole.write.mode("overwrite").parquet(f"{root}/b={batch_id}")
            # The last version stays until the next compaction: the last batch may be replayed.
            _delete_paths(spark, [f"{root}/{k}={n}" for n in range(max(0, batch_id - 2 * compact_every), batch_id - 1)
                                  for k in ("b", "d") if not (k == "b" and n >= batch_id - compact_every)])

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    if not processing_time:
        q.awaitTermination()
    return q


def run_lock(stream: DataFrame, vault, key, sink: str, checkpoint: str, text: str = "text", policy: P.Policy | None = None):
    """Lock a stream batch by batch into ``sink/batch_id=N``; all tokens are in the vault before a batch's text is written.

    A batch is a named run of the vault: if it is replayed, it takes the ids it
    had and replaces its entries and its output.
    """
    import hashlib

    from ..operators.vault import lock

    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, batch_id: int):
        res = lock(batch, vault, key, text, policy, owner=f"{name}-{batch_id}")
        res.locked.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        res.release()

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete_paths(spark: SparkSession, paths) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
