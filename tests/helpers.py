from shroud import policy as P
from shroud.operators.mask import mask
from shroud.operators.report import with_report

REGEX_POLICY = P.Policy(enabled=P.REGEX_AND_KEYWORD)


def run_mask(spark, texts, policy=REGEX_POLICY, dotenv=False):
    """Mask a list of texts; returns rows in input order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = with_report(mask(df, "text", policy, dotenv=dotenv))
    return sorted(out.collect(), key=lambda r: r.doc_id)


def masked(spark, text, policy=REGEX_POLICY, dotenv=False):
    return run_mask(spark, [text], policy, dotenv)[0]
