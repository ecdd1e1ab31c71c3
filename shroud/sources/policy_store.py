"""Policies as tables: load, save, and edit keyword tables.

A stored policy is one JSON record with a fixed schema; anything missing or of
another type reads as null and leaves its default. Category settings may also
come as a table. Keyword tables ``(pos, keyword)`` keep their order and are
edited by joins, never collected.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import ALL_CATEGORIES, DEFAULT_TOKENS, Policy

# FIXED VALUES: field names of a stored policy.
SCHEMA = "enabled_categories array<string>, replacements map<string,string>, keywords array<string>"
KEYWORD_SCHEMA = "pos long, keyword string"


def categories(spark: SparkSession) -> DataFrame:
    """The known categories with their default tokens."""
    return spark.createDataFrame([(c, DEFAULT_TOKENS[c]) for c in ALL_CATEGORIES], "category string, token string")


def policy_from_tables(settings: DataFrame, keywords: DataFrame | None = None) -> Policy:
    """A policy from ``(category, enabled, replacement)`` and an optional keyword table.

    Unknown categories drop out in the join with the known ones (so at most
    one row per known category reaches the driver); a null replacement keeps
    the default. A category that is listed several times is on if any row is,
    and takes its last replacement in order.
    """
    given = settings.groupBy("category").agg(F.max(F.coalesce(F.col("enabled"), F.lit(False))).alias("enabled"),
                                             F.max("replacement").alias("replacement"))
    known = categories(settings.sparkSession).join(given, "category", "left").select(
        "category", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("replacement", "token").alias("token")).collect()
    return Policy(enabled=frozenset(r["category"] for r in known if r["enabled"]),
                  replacements={r["category"]: r["token"] for r in known}, keyword_table=keywords)


def load_policy(spark: SparkSession, path: str) -> Policy:
    """Read a stored policy; a missing or unreadable one gives the defaults."""
    try:
        record = spark.read.schema(SCHEMA).option("multiLine", True).json(path).first()
    except AnalysisException:
        record = None
    policy = Policy()
    if record is None:
        return policy
    if record["enabled_categories"] is not None:
        policy = replace(policy, enabled=frozenset(ALL_CATEGORIES) & set(record["enabled_categories"]))
    if record["replacements"] is not None:
        policy = policy.with_tokens(**{k: v for k, v in record["replacements"].items() if v is not None})
    words = [w for w in record["keywords"] or () if w and w.strip()]
    return policy.with_keywords(words) if words else policy


def save_policy(spark: SparkSession, policy: Policy, path: str) -> None:
    row = (sorted(policy.enabled), dict(policy.replacements), list(policy.keywords))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def keyword_table(spark: SparkSession, keywords) -> DataFrame:
    """``(pos, keyword)`` of the trimmed, non-blank keywords in the given order."""
    rows = [(n, w) for n, w in enumerate(k.strip() for k in keywords) if w]
    return spark.createDataFrame(rows, KEYWORD_SCHEMA)


def add_keywords(table: DataFrame, new: DataFrame) -> DataFrame:
    """Append the keywords of ``new (pos, keyword)``: trimmed, not blank, not there in any case; first of equals wins."""
    fold = F.lower("keyword").alias("k")
    fresh = new.select("pos", F.trim("keyword").alias("keyword")).where(F.length("keyword") > 0)
    fresh = fresh.groupBy(fold).agg(F.min_by(F.struct("pos", "keyword"), "pos").alias("x")).select("k", "x.pos", "x.keyword")
    fresh = fresh.join(table.select(fold), "k", "left_anti")
    last = table.agg(F.max("pos").alias("at")).first()["at"]
    after = 0 if last is None else last + 1
    return table.select("pos", "keyword").unionByName(fresh.select((F.col("pos") + after).alias("pos"), "keyword"))


def remove_keywords(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the keywords of ``gone (keyword)``, whatever their case."""
    drop = gone.select(F.lower(F.trim("keyword")).alias("k"))
    return table.withColumn("k", F.lower("keyword")).join(drop, "k", "left_anti").select("pos", "keyword")


def list_keywords(table: DataFrame) -> DataFrame:
    """The keywords in stored order."""
    return table.orderBy("pos").select("keyword")
