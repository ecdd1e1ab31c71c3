"""Going on after bad input: records that cannot be read go to a dead-letter table, the rest is processed.

Lines are read as bytes and checked one by one, in the same narrow plan for
batches and streams: bytes that are no UTF-8, lines that are no JSON record of
the schema, and records without a required field each get a reason. Whole files
are read as bytes too; a packed file that is cut off or damaged is a bad record
like any other. Nothing is dropped: every record is either processed or listed.
"""

from __future__ import annotations

from typing import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P

REASON = "__reason"
RAW = "__raw"
INVALID_UTF8, CORRUPT, MISSING, DAMAGED = "invalid UTF-8", "corrupt record", "missing field", "damaged file"
DEAD_SCHEMA = "raw binary, reason string"
_BAD = "__corrupt"


def checked_lines(lines: DataFrame, schema: str, required: Sequence[str], line: str = "value") -> DataFrame:
    """The fields of JSON lines, with the raw bytes (``__raw``) and the reason why a line is bad (``__reason``, null if it is good).

    ``schema`` is a DDL string. Null lines count as empty ones, which are corrupt.
    """
    valid = F.is_valid_utf8(F.col(line))
    text = F.when(valid, F.col(line))
    record = F.from_json(text, f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = lines.select(F.col(line).cast("binary").alias(RAW), valid.alias("__valid"), record.alias("__r"))
    missing = F.lit(False)
    for field in required:
        missing = missing | F.col(f"__r.`{field}`").isNull()
    bad = F.col("__r").isNull() | F.col(f"__r.{_BAD}").isNotNull()
    reason = F.when(~F.coalesce("__valid", F.lit(False)) & F.col(RAW).isNotNull(), INVALID_UTF8).when(bad, CORRUPT).when(missing, MISSING)
    return rows.select("__r.*", RAW, reason.alias(REASON)).drop(_BAD)


def checked_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Whole files as rows ``(path, text, __raw, __reason)``; ``.gz`` files are unpacked (Spark leaves out files of no bytes)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", "content")

    @F.pandas_udf("text string, reason string")
    def unpack(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        import gzip
        import zlib

        out = []
        for p, data in zip(paths, contents):
            text, reason = None, None
            try:
                text = (gzip.decompress(data) if p.endswith(".gz") else data).decode("utf-8")
            except UnicodeDecodeError:
                reason = INVALID_UTF8
            except (OSError, EOFError, zlib.error):
                reason = DAMAGED
            out.append((text, reason))
        return pd.DataFrame(out, columns=["text", "reason"])

    found = files.withColumn("__u", unpack("path", "content"))
    return found.select("path", "__u.text", F.col("content").alias(RAW), F.col("__u.reason").alias(REASON))


def good(checked: DataFrame) -> DataFrame:
    """The records that can be processed."""
    return checked.where(F.col(REASON).isNull()).drop(RAW, REASON)


def dead_letters(checked: DataFrame, *keep: Column | str) -> DataFrame:
    """The bad records as they came, with their reasons (and the columns ``keep``)."""
    return checked.where(F.col(REASON).isNotNull()).select(*keep, F.col(RAW).alias("raw"), F.col(REASON).alias("reason"))


def run_checked(stream: DataFrame, schema: str, required: Sequence[str], then: Callable[[DataFrame], DataFrame], sink: str, dead: str,
                checkpoint: str, line: str = "value"):
    """Process a stream of lines: ``then`` of the good records to ``sink``, bad ones to ``dead``.

    Both are written per batch id, so a replayed batch replaces what it wrote.
    """

    def step(batch: DataFrame, batch_id: int):
        checked = checked_lines(batch, schema, required, line)
        then(good(checked)).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        dead_letters(checked).write.mode("overwrite").parquet(f"{dead.rstrip('/')}/batch_id={batch_id}")

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def mask_checked(policy: P.Policy | None = None, keep: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A ``then`` that masks column ``text`` and keeps ``keep``, the masked text and the number of findings."""
    from ..operators.mask import mask

    return lambda df: mask(df, "text", policy or P.Policy()).select(*keep, "masked_text", F.size("findings").cast("long").alias("n_findings"))
