"""Readers for the corpus tables and text files, and the writers for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dotenv import is_dotenv_name

# Text column of each corpus table and its key columns.
TEXT_TABLES = {
    "documents": (("doc_id",), "text"),
    "pages": (("page_id",), "html"),
    "conversations": (("conv_id", "turn"), "text"),
    "benchmark": (("item_id",), "text"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, factor: int = 4) -> DataFrame:
    """Give a scan at least ``factor`` x the cluster's cores worth of tasks.

    Large inputs already arrive as many file splits and are left alone (no
    shuffle). A table stored as a single row group would otherwise put every
    document into one task; only then are rows dealt round-robin.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        return df.repartition(target)
    return df


def read_texts(spark: SparkSession, sf_dir: str, name: str, spread_out: bool = True) -> DataFrame:
    """``(keys..., text)`` of a corpus table; only those columns are scanned."""
    keys, col = TEXT_TABLES[name]
    df = read_table(spark, sf_dir, name).select(*keys, F.col(col).alias("text"))
    return spread(df) if spread_out else df


def read_text_files(spark: SparkSession, paths, recursive: bool = False, stage_dir: str | None = None) -> DataFrame:
    """Whole files as rows ``(path, file_name, dotenv, text)``.

    ``dotenv`` is true for ``.env``, ``.env.*`` and ``*.env`` names, so one plan
    masks mixed inputs, each file in its own mode. Spark's file sources never
    read names starting with ``.`` or ``_``. If such files are there, this
    fails and names them, unless ``stage_dir`` (a folder all executors see) is
    given: then they are copied there under visible names and read from there,
    with their own path and name in the result. The copies hold the originals
    in clear; the caller deletes the folder after use.
    """
    paths = list(paths) if isinstance(paths, (list, tuple)) else [paths]
    hidden, shown = _split_hidden(spark, paths, recursive)
    if hidden and stage_dir is None:
        raise ValueError(f"{len(hidden)} hidden files would not be read (give stage_dir): {', '.join(hidden[:5])}")
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    cols = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")]
    out = reader.text(shown, wholetext=True).select(*cols) if shown else None
    if hidden:
        names = _stage(spark, hidden, stage_dir)
        staged = spark.read.text(sorted(names), wholetext=True).select(
            F.col("_metadata.file_name").alias("staged"), F.col("value").alias("text"))
        # One row per hidden file: a listing, not contents.
        rows = [(copy.rsplit("/", 1)[1], original, original.rsplit("/", 1)[1]) for copy, original in names.items()]
        listing = spark.createDataFrame(rows, "staged string, path string, file_name string")
        staged = staged.join(listing, "staged").select("path", "file_name", "text")
        out = staged if out is None else out.unionByName(staged)
    return out.withColumn("dotenv", is_dotenv_name(F.col("file_name")))


def _split_hidden(spark: SparkSession, paths, recursive: bool) -> tuple[list[str], list[str]]:
    """Hidden files that the paths name or hold, and the paths without those that are hidden themselves."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hidden, shown = [], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        todo = [s for s in fs.globStatus(path) or ()]
        if any(not _is_hidden(s) for s in todo) or not todo:
            shown.append(p)
        hidden += [s.getPath().toString() for s in todo if _is_hidden(s) and s.isFile()]
        folders = [s.getPath() for s in todo if s.isDirectory()]
        while folders:
            for s in fs.listStatus(folders.pop()):
                if s.isFile() and _is_hidden(s):
                    hidden.append(s.getPath().toString())
                elif s.isDirectory() and recursive and not _is_hidden(s):
                    folders.append(s.getPath())
    return hidden, shown


def _is_hidden(status) -> bool:
    """Names that Spark skips; its own marker and checksum files are no texts."""
    name = status.getPath().getName()
    return name[:1] in "._" and name != "_SUCCESS" and not name.endswith(".crc")


def _stage(spark: SparkSession, files: list[str], stage_dir: str) -> dict[str, str]:
    """Copy hidden files to visible names; copy -> original."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for n, f in enumerate(files):
        source, copy = jvm.org.apache.hadoop.fs.Path(f), f"{stage_dir.rstrip('/')}/hidden-{n:06d}.txt"
        target = jvm.org.apache.hadoop.fs.Path(copy)
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        out[copy] = f
    return out


def write_texts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write results to a new location (inputs are never overwritten in place)."""
    df.write.mode(mode).format(fmt).save(path)
