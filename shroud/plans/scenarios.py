"""Multi-step queries: vault round trips and streaming runs over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P
from ..operators import vault as V
from ..session import scratch_path
from ..sources.tables import read_table, read_texts
from ..streaming import stream as S
from . import oracles as O

PASSPHRASE = "seven lanterns over a quiet harbour"
EPOCH0 = 1704067200  # 2024-01-01T00:00:00Z, start of the derived event clock
SECONDS_PER_DOC = 7


def _locked(spark: SparkSession, sf: str):
    vault = V.new_scratch_vault(spark, PASSPHRASE)
    res = V.lock(read_texts(spark, sf, "documents"), vault, "doc_id", "text", P.Policy())
    return vault, res


def lock_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lock every document into a fresh vault: ``(doc_id, locked_text, n_replaced)``."""
    _vault, res = _locked(spark, sf)
    return res.locked


def vault_status_after_lock(spark: SparkSession, sf: str) -> DataFrame:
    vault, _res = _locked(spark, sf)
    return vault.status().select("n_entries", "max_token")


def unlock_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lock, reload the vault from storage, unlock: ``(doc_id, unlocked_text, n_restored)``."""
    vault, res = _locked(spark, sf)
    path = scratch_path(spark, "locked")
    res.locked.write.parquet(path)
    reloaded = V.Vault.load(spark, vault.path).open(PASSPHRASE)
    locked = spark.read.parquet(path).select("doc_id", F.col("locked_text").alias("text"))
    return V.unlock(locked, reloaded)


def lock_unlock_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: spans locked, tokens restored, and whether text round-trips."""
    vault, res = _locked(spark, sf)
    path = scratch_path(spark, "locked")
    res.locked.write.parquet(path)
    locked = spark.read.parquet(path)
    un = V.unlock(locked.select("doc_id", F.col("locked_text").alias("text")), vault)
    orig = read_table(spark, sf, "documents").select("doc_id", "text")
    j = un.join(locked.select("doc_id", "n_replaced"), "doc_id").join(orig, "doc_id")
    return j.select("doc_id", "n_replaced", "n_restored",
                    F.coalesce(F.col("unlocked_text") == F.col("text"), F.lit(True)).alias("roundtrip_ok"))


def _doc_stream(spark: SparkSession, sf: str, table: str = "documents") -> DataFrame:
    """A stream of all files of a table, whether it is one file or a folder of them.

    The files hold rows in no order of time or turn, so they are one
    micro-batch: in one after another, rows would count as late or as changed
    by the file they lie in.
    """
    whole = read_table(spark, sf, table)
    cores = spark.sparkContext.defaultParallelism
    # small tables are single-row-group files: spread the micro-batch
    spread = cores * 4 if whole.rdd.getNumPartitions() < cores else None
    # The braces make it a pattern: a plain path must name a folder.
    return S.read_stream(spark, f"{sf.rstrip('/')}/{{{table}.parquet}}", whole.schema, spread_to=spread)


def stream_mask(spark: SparkSession, sf: str) -> DataFrame:
    """File stream of documents masked with availableNow into a parquet sink."""
    out = S.mask_stream(_doc_stream(spark, sf).select("doc_id", "text"), "text", P.Policy(), keep=("doc_id",))
    sink, ck = scratch_path(spark, "stream-mask"), scratch_path(spark, "stream-mask-ck")
    S.run_available(out, sink, ck)
    return spark.read.parquet(sink).select("doc_id", "masked_text", "n_findings")


def stream_gazetteer_find(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of documents searched for tens of thousands of terms, in the same narrow plan as a batch."""
    from ..operators.detect import find
    from ..operators.report import explode_findings
    from .queries import large_gazetteer

    policy = P.Policy(enabled={P.PERSON, P.LOCATION}, gazetteer=large_gazetteer(spark, sf))
    out = explode_findings(find(_doc_stream(spark, sf).select("doc_id", "text"), "text", policy), ("doc_id",))
    sink, ck = scratch_path(spark, "stream-terms"), scratch_path(spark, "stream-terms-ck")
    S.run_available(out.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "category", "value"), sink, ck)
    return spark.read.parquet(sink)


def stream_window_report(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per 10-minute event-time window (derived clock) and category."""
    from ..operators.detect import find

    src = _doc_stream(spark, sf).select(
        "doc_id", "text", F.timestamp_seconds(F.lit(EPOCH0) + F.col("doc_id") * SECONDS_PER_DOC).alias("ts"))
    rep = S.window_report(find(src, "text", P.Policy()), "ts", "10 minutes", "1 hour")
    sink, ck = scratch_path(spark, "stream-win"), scratch_path(spark, "stream-win-ck")
    S.run_updates(rep, sink, ck)
    out = S.latest_updates(spark, sink, ("window_start", "category"))
    return out.select(F.unix_timestamp("window_start").alias("window_start_epoch"), "category", "n_findings")


def stream_dedup_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns whose text differs from the previous turn, masked."""
    return _stream_without_repeats(spark, _doc_stream(spark, sf, "conversations").select("conv_id", "turn", "text"))


def _stream_without_repeats(spark: SparkSession, src: DataFrame, arrivals=(None,)) -> DataFrame:
    """Run the stream after each of ``arrivals`` (functions that add files to its source)."""
    from ..operators.mask import mask

    def masked(kept):
        out = mask(kept, "text", P.Policy())
        return out.select("conv_id", "turn", "masked_text", F.size("findings").cast("long").alias("n_findings"))

    sink, ck = scratch_path(spark, "stream-dedup"), scratch_path(spark, "stream-dedup-ck")
    for arrive in arrivals:
        if arrive:
            arrive()
        S.run_without_repeats(src, "conv_id", "turn", "text", sink, ck, then=masked)
    return spark.read.parquet(sink).select("conv_id", "turn", "masked_text", "n_findings")


#: Each turn is repeated one to three times with gaps in the sequence; SQL that Spark and DuckDB read alike.
COPIES_SQL = "1 + (conv_id + turn) % 3"
BATCHES = 4


def repeated_turns(spark: SparkSession, sf: str) -> DataFrame:
    from .planted import planted

    df = planted(spark, sf).withColumn("copy", F.explode(F.expr(f"sequence(1L, {COPIES_SQL})")))
    return df.select("conv_id", (F.col("turn") * 10 + F.col("copy") * 2).alias("turn"), "text")


def stream_dedup_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with repeats and gaps in several micro-batches: only changes are processed."""
    rows = repeated_turns(spark, sf)
    src = scratch_path(spark, "stream-repeats")

    def arrival(b: int):
        """The turns of one micro-batch, written by as many tasks as there are."""
        last = b == BATCHES - 1
        part = rows.where((F.col("turn") >= 10 * b) & (F.lit(last) | (F.col("turn") < 10 * (b + 1))))
        return lambda: part.write.mode("append").parquet(src)

    rows.limit(0).write.parquet(src)
    return _stream_without_repeats(spark, S.read_stream(spark, src, rows.schema), [arrival(b) for b in range(BATCHES)])


def dedup_repeats_batch(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.mask import mask

    out = mask(S.drop_repeats_batch(repeated_turns(spark, sf), "conv_id", "turn", "text"), "text", P.Policy())
    return out.select("conv_id", "turn", "masked_text", F.size("findings").cast("long").alias("n_findings"))


def dedup_repeats_sql() -> str:
    from .planted import piece_sql

    src = (f"SELECT conv_id, turn * 10 + copy * 2 AS turn, text FROM (SELECT conv_id, turn, text || ' ' || {piece_sql('VARCHAR')} "
           f"|| ' end' AS text, unnest(generate_series(1, {COPIES_SQL})) AS copy FROM conversations)")
    changed = (f"SELECT conv_id, turn, text FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, "
               f"row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({src})) WHERE n = 1 OR prev IS DISTINCT FROM text")
    return O.mask_sql("conversations", ("conv_id", "turn"), "text", P.Policy(), changed)


def stream_dedup_conversations_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same result by another name: state is a table (kept for earlier users of the query)."""
    src = _doc_stream(spark, sf, "conversations").select("conv_id", "turn", "text")
    return _stream_without_repeats(spark, src)


def dedup_conversations_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Batch form: each turn is compared with its neighbour inside a range, borders with the range before."""
    from ..operators.mask import mask

    df = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    changed = S.drop_repeats_batch(df, "conv_id", "turn", "text")
    out = mask(changed, "text", P.Policy())
    return out.select("conv_id", "turn", "masked_text", F.size("findings").cast("long").alias("n_findings"))


def oracles() -> dict:
    return {
        "lock_documents": O.lock_sql(),
        "vault_status_after_lock": O.vault_status_sql(),
        "unlock_documents": O.unlock_sql(),
        "lock_unlock_roundtrip": O.roundtrip_sql(),
        "stream_mask": O.mask_sql("documents", ("doc_id",), "text", P.Policy()),
        "stream_gazetteer_find": O.gazetteer_sql(),
        "stream_window_report": O.window_report_sql(EPOCH0, SECONDS_PER_DOC),
        "stream_dedup_conversations": O.dedup_sql(),
        "dedup_conversations_batch": O.dedup_sql(),
        "stream_dedup_conversations_table": O.dedup_sql(),
        "stream_dedup_repeats": dedup_repeats_sql(),
        "dedup_repeats_batch": dedup_repeats_sql(),
    }
