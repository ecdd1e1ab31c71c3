"""The registered ``opN_<name>`` queries: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, hamming, hnsw, importance, langid, minhash, mixing, packing, pii, quality, simhash, templates, urls
from . import vectors
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its segmented words."""
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op2_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found, by inner product, for every vec_id divisible by 20."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of 150% of all words takes, sources weighing 5, 2, 1 in turn."""
    planned = mixing.plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, limit=2.0)
    return mixing.taken(planned).select("doc_id", "size", "source_size", "target", "taken")


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 10 nearest sign codes, by Hamming distance, for every vec_id divisible by 20."""
    vec = F.col("embedding")
    code = F.when(vectors.usable(vec), hamming.sign_code(vec))
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 10, "vec_id", code)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (3-word shingles, 3 bits)."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.train(docs))
    counts = [F.expr(f"CAST(size(filter(pii_base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{kind}")
              for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.listing("pii_base")), 256).alias("base_sha256"),
                        F.expr(pii.listing("pii")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = templates.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality score of every document; ``keep`` at a probability of 0.5."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces packed into sequences of at most 4096 tokens."""
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), capacity=4096)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         "sequence_id", "offset")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the benchmark's distribution of words and word pairs."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment between the byte-level and the piece tokenizer."""
    found = alignment.alignment(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.col("groups").alias("groups_sha256"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (3-word shingles, similarity from 0.85 on)."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=(85, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def queries() -> dict:
    """Every ``opN_<name>`` query of this subpackage."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
