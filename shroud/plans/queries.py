"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

All of them read the corpus tables (or text Spark derives from them) in
full. Offsets are code points; integer outputs are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.scalar import shannon_entropy
from ..functions.sql import add
from ..operators import catalog as C
from ..operators.detect import find, scan_pattern
from ..operators.mask import mask
from ..operators.report import changed_rows, counts_by, explode_findings, with_report
from ..sources.tables import read_table, read_texts

DEFAULT = P.Policy()

# Parameters of the keyword and gazetteer queries (policy inputs, like a
# user's keyword list); the work still covers every document.
KEYWORDS = ("License", "Eriner", "Pour")
GAZETTEER = (("Orre", P.PERSON), ("Nicht", P.LOCATION), ("That", P.PERSON), ("Anon", P.LOCATION))


def _spans(df: DataFrame, keys, spec: C.PatternSpec, validate: bool = True) -> DataFrame:
    out = scan_pattern(df, "text", spec, "spans", validate=validate)
    return out.select(*keys, F.inline("spans")).select(
        *keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


def find_single(name: str, table: str = "documents"):
    spec = C.by_name(name)

    def q(spark: SparkSession, sf: str) -> DataFrame:
        keys = ("doc_id",) if table == "documents" else ("page_id",)
        return _spans(read_texts(spark, sf, table), keys, spec)

    return q


def find_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every secret pattern on its own (unresolved), documents and pages.

    One combined scan per table computes all patterns; each span carries its
    pattern name.
    """
    from ..functions.scan import Scan, metric_barrier, with_tagged_spans
    from ..functions.sql import ident, q

    names = "CASE s.id " + " ".join(f"WHEN {i} THEN {q(spec.name)}" for i, spec in enumerate(C.SECRETS)) + " END"
    out = None
    for table, key in (("documents", "doc_id"), ("pages", "page_id")):
        df = read_texts(spark, sf, table).withColumnRenamed(key, "id").withColumn("__lc", F.lower("text")) \
            .withColumn("__lc__cf", F.expr(C.special_chars("text")))
        scans = [Scan(f"__s{i}", spec.regex, spec.grouped, spec.gate(ident("text"), "__lc"))
                 for i, spec in enumerate(C.SECRETS)]
        df = with_tagged_spans(df, "text", scans, "__spans")
        tagged = (f"transform(__spans, s -> named_struct('pattern', {names}, 'start', CAST(s.start AS BIGINT), "
                  f"'end', CAST(s.`end` AS BIGINT), 'value', s.value))")
        df = metric_barrier(df, ["__spans"])
        part = df.select(F.lit(table).alias("source_table"), "id", F.inline(F.expr(tagged)))
        out = part if out is None else out.unionByName(part)
    return out


def find_card_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Card-shaped digit runs with their Luhn verdict."""
    from ..functions.scalar import luhn_valid

    df = _spans(read_texts(spark, sf, "documents"), ("doc_id",), C.CREDIT_CARD, validate=False)
    return df.withColumn("luhn_ok", F.expr(luhn_valid("value")))


def find_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy candidates with their entropy (6 places) and verdict."""
    from ..functions.scalar import looks_secret

    df = _spans(read_texts(spark, sf, "documents"), ("doc_id",), C.ENTROPY_CANDIDATE)
    return add(df, {"entropy": f"round({shannon_entropy('value')}, 6)", "is_secret": looks_secret("value")})


def find_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved findings of every default detector over raw HTML pages."""
    df = find(read_texts(spark, sf, "pages"), "text", DEFAULT)
    return _flat(df, ("page_id",))


def _flat(df: DataFrame, keys) -> DataFrame:
    return explode_findings(df, keys).select(
        *keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        "category", "value")


def resolve_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(find(read_texts(spark, sf, "documents"), "text", DEFAULT), ("doc_id",))


def resolve_documents_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Resolution on the exploded findings table (window islands), the form
    used when findings arrive as a table rather than per-row arrays."""
    from ..operators.detect import with_raw_findings
    from ..operators.resolve import resolve_exploded

    raw = with_raw_findings(read_texts(spark, sf, "documents"), "text", DEFAULT, "raw")
    table = explode_findings(raw, ("doc_id",), "raw")
    out = resolve_exploded(table, "doc_id")
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                      "category", "value")


def mask_table(table: str, policy: P.Policy = DEFAULT):
    keys = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"),
            "benchmark": ("item_id",)}[table]

    def q(spark: SparkSession, sf: str) -> DataFrame:
        df = mask(read_texts(spark, sf, table), "text", policy)
        return df.select(*keys, "masked_text", F.size("findings").cast("long").alias("n_findings"))

    return q


def summary_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = with_report(changed_rows(find(read_texts(spark, sf, "documents"), "text", DEFAULT)))
    return df.select("doc_id", "n_findings", "summary")


def counts_by_category(spark: SparkSession, sf: str) -> DataFrame:
    df = find(read_texts(spark, sf, "documents"), "text", DEFAULT)
    return counts_by(df, ())


def counts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    from ..sources.tables import spread

    return counts_by(find(spread(docs), "text", DEFAULT), ("source",))


def keyword_mask(spark: SparkSession, sf: str) -> DataFrame:
    policy = P.Policy(enabled={P.KEYWORD, P.EMAIL}, keywords=KEYWORDS)
    df = mask(read_texts(spark, sf, "documents"), "text", policy)
    return df.select("doc_id", "masked_text", F.size("findings").cast("long").alias("n_findings"))


def gazetteer_find(spark: SparkSession, sf: str) -> DataFrame:
    gaz = spark.createDataFrame(list(GAZETTEER), "term string, category string")
    policy = P.Policy(enabled={P.PERSON, P.LOCATION}, gazetteer=gaz)
    return _flat(find(read_texts(spark, sf, "documents"), "text", policy), ("doc_id",))


def gazetteer_large_find(spark: SparkSession, sf: str) -> DataFrame:
    """The same terms among tens of thousands."""
    policy = P.Policy(enabled={P.PERSON, P.LOCATION}, gazetteer=large_gazetteer(spark, sf))
    return _flat(find(read_texts(spark, sf, "documents"), "text", policy), ("doc_id",))


def gazetteer_scores_find(spark: SparkSession, sf: str) -> DataFrame:
    """External entity labels and scores: labels are mapped, low scores and categories that are off drop out."""
    rows = [("Orre", "PERSON", 0.9), ("Nicht", "LOCATION", 0.4), ("That", "PERSON", 0.39), ("Anon", "ORGANIZATION", 0.8),
            ("Pour", "DATE_TIME", 1.0)]
    gaz = spark.createDataFrame(rows, "term string, category string, score double")
    policy = P.Policy(enabled={P.PERSON, P.LOCATION, P.DATE}, gazetteer=gaz)
    return _flat(find(read_texts(spark, sf, "documents"), "text", policy), ("doc_id",))


KEYWORD_WORD = "^[A-Za-z]{9,}$"


def conversation_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of keywords: the long plain words of all conversations, in order of their first turn."""
    turns = read_table(spark, sf, "conversations")
    words = turns.select("conv_id", F.explode(F.split("text", " ")).alias("w"))
    words = words.where(F.col("w").rlike(KEYWORD_WORD)).groupBy(F.lower("w").alias("keyword")).agg(F.min("conv_id").alias("pos"))
    return words.select("pos", "keyword")


def keyword_table_find(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scanned with a keyword table, by joins: no regex per keyword."""
    policy = P.Policy(enabled={P.KEYWORD}, keyword_table=conversation_keywords(spark, sf))
    return _flat(find(read_texts(spark, sf, "documents"), "text", policy), ("doc_id",))


def mark_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Two keywords for each customer that hold no whole word: they may stand inside one."""
    customers = read_table(spark, sf, "customer")
    return customers.select(F.explode(F.array(F.concat(F.lit("_"), "c_custkey", F.lit("_")),
                                              F.concat(F.lit("->"), "c_custkey", F.lit("<-")))).alias("keyword"))


ORDER_NOTE = "'Note ' || o_orderkey || ': KEY_' || o_custkey || '_x, é->' || o_custkey || '<- _' || o_custkey || '.'"


def keyword_marks_find(spark: SparkSession, sf: str) -> DataFrame:
    """A note for every order scanned with thousands of keywords that are no whole words."""
    notes = read_table(spark, sf, "orders").select("o_orderkey", F.expr(ORDER_NOTE).alias("text"))
    policy = P.Policy(enabled={P.KEYWORD}, keyword_table=mark_keywords(spark, sf))
    return _flat(find(notes, "text", policy), ("o_orderkey",))


def large_gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """The short gazetteer among one term for each line item (tens of thousands)."""
    items = read_table(spark, sf, "lineitem").select(F.concat_ws(" ", F.lit("Item"), "l_orderkey", "l_linenumber").alias("term"))
    return items.distinct().withColumn("category", F.lit(P.LOCATION)).unionByName(
        spark.createDataFrame(list(GAZETTEER), "term string, category string"))


def keyword_table_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords added (duplicates in other case skipped) and removed by joins, with their length."""
    from ..sources import policy_store as PS

    base = conversation_keywords(spark, sf)
    upper = base.select((F.col("pos") + 1).alias("pos"), F.upper("keyword").alias("keyword"))
    added = PS.add_keywords(base, upper.unionByName(base.select("pos", F.concat(F.lit(" x"), "keyword", F.lit(" ")).alias("keyword"))))
    return PS.remove_keywords(added, base.where(F.length("keyword") > 11)).select("keyword")


def policy_tables_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A policy that comes as a table: e-mail with its own token, cards by default, an unknown category ignored."""
    rows = [("email", True, "<mail>"), ("credit_card", True, None), ("ip", False, "<ip>"), ("retina", True, "<eye>")]
    from ..sources.policy_store import policy_from_tables

    policy = policy_from_tables(spark.createDataFrame(rows, "category string, enabled boolean, replacement string"))
    df = mask(read_texts(spark, sf, "documents"), "text", policy)
    return df.select("doc_id", "masked_text", F.size("findings").cast("long").alias("n_findings"))


def customer_env_files(spark: SparkSession, sf: str) -> DataFrame:
    """One ``.env``-style text per customer, derived from the customer table."""
    c = read_table(spark, sf, "customer")
    text = F.concat(
        F.lit("# customer "), F.col("c_custkey").cast("string"), F.lit("\n"),
        F.lit("export C_NAME="), F.col("c_name"), F.lit("\n"),
        F.lit("C_BALANCE_CENTS="), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit("\n"),
        F.lit("C_SEGMENT=\""), F.col("c_mktsegment"), F.lit("\"  # market segment\n"),
        F.lit("C_ACTIVE=true\n"),
        F.lit("C_NATION = "), F.col("c_nationkey").cast("string"), F.lit("\n"),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def dotenv_customers(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import spread

    df = mask(spread(customer_env_files(spark, sf)), "text", DEFAULT, dotenv=True)
    return df.select("doc_id", "masked_text", F.size("findings").cast("long").alias("n_findings"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Mask every document; report per document."""
    df = with_report(mask(read_texts(spark, sf, "documents"), "text", DEFAULT))
    return df.select("doc_id", "masked_text", "n_findings", "summary")
