"""Helpers shared by the training-data operators.

Column names that start with two underscores are the operators' own work
columns; any other column of an input may have any name.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.session import remove_tables, scratch_path


def materialize(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage and survives lost executors. ``files`` bounds the number
    of files of a table known to be small. Zstandard keeps the codec's buffers
    on the heap, where many small files would pile up direct memory.
    """
    path = scratch_path(df.sparkSession, label)
    out = df if files is None else df.coalesce(files)
    out.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    remove_tables(df.sparkSession, [df.written_to])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail with a plain message when an input column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing input columns: {', '.join(missing)}")


def blocks_of(n_rows: int, per_block: int) -> int:
    return max(1, -(-n_rows // per_block))
