"""Training-data pipeline over ``documents``: each stage calls one operator of ``shroud.llm``.

Every stage takes the documents its predecessor kept and returns the columns
of ``documents``; the last one returns packed sequences. A stage that changes
a text sets ``n_chars`` to its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import langid, mixing, packing, pii, simhash
from shroud.llm.common import discard, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; a missing language is filled in.

    Rejected are texts without letters (``und``) and texts whose main language
    has less than half of the letters.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.detect(docs, model, lang_out="__lang", score_out="__score")
    kept = found.where((F.col("__lang") != langid.UND) & (F.col("__score") >= 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs, k=3, radius=3)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``."""
    found = pii.detect(docs, pii.train(docs), base_out="__base", out="__pii")
    out = pii.redact(found, "__pii").withColumn(
        "n_chars", F.when(F.size("__pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of 150% of all words, sources weighing 5, 2, 1 in turn: what a pass takes of a document is a row."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, limit=2.0).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents in sequences of at most 4096 tokens."""
    placed = packing.pack_documents(docs, capacity=4096)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         "sequence_id", "offset")


STAGES = [("language_id", language), ("simhash_dedup", near_dedup), ("pii", redact), ("mix_sources", mix),
          ("best_fit_packing", pack)]

#: Learned models, tiled components and the packing search are beyond SQL; a brute-force version tests each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; each result is written and reread before the next."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "written_to"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
