"""Evidence queries: every conversation turn gets a deterministic piece of sensitive data.

The corpus itself holds few kinds of findings. Here each turn's text is followed
by one of thirty pieces chosen by its key: each secret shape, an SSN, random
strings near the entropy cut, overlapping pairs, a row of forty findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.scan import Scan, metric_barrier, with_tagged_spans
from ..functions.sql import ident, q
from ..operators import catalog as C
from ..operators import vault as V
from ..operators.detect import find
from ..operators.mask import mask
from ..operators.report import counts_by, explode_findings
from ..session import scratch_path
from ..sources.tables import read_table, spread

KEYS = ("conv_id", "turn")
#: SQL that Spark and DuckDB read alike; ``h`` is the key's md5 in hex.
PIECES = (
    "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || h || chr(10) || '-----END RSA PRIVATE KEY-----'",
    "'sk-proj-' || h",
    "'AKIA' || substr(upper(h), 1, 16)",
    "'AIza' || h || substr(h, 1, 3)",
    "'ghp_' || h || substr(h, 1, 4)",
    "'github_pat_' || h",
    "'xoxb-' || h",
    "'sk_live_' || h",
    "'whsec_' || h",
    "'glpat-' || substr(h, 1, 20)",
    "'GOCSPX-' || substr(h, 1, 28)",
    "'SG.' || substr(h, 1, 22) || '.' || h || substr(h, 1, 11)",
    "'AC' || h",
    "'npm_' || h || substr(h, 1, 4)",
    "'pypi-' || h",
    "'hf_' || h || substr(h, 1, 2)",
    "'dop_v1_' || h || h",
    "'123456789:' || h || substr(h, 1, 3)",
    "'eyJ' || h || '.' || h || '.' || h",
    "'postgres://admin:' || substr(h, 1, 12) || '@db.example.com/app'",
    "'Authorization: Bearer ' || h",
    "'api_key = \"' || h || '\"'",
    "'SSN 123-45-6789 of ' || substr(h, 1, 5)",
    "substr(h, 1, 12) || substr(upper(h), 13, 12) || '+' || substr(h, 25, 8)",
    "'secret = jane' || substr(h, 1, 4) || '@corp.example.com'",
    "'token: AKIA' || substr(upper(h), 1, 16)",
    "repeat('u' || substr(h, 1, 3) || '@x.example.com ', 40)",
    "'phone 555-123-4567, card 4111 1111 1111 1111, host 10.0.0.1'",
    "repeat(substr(h, 1, 2), 14)",
    "'DSN=https://user:' || substr(h, 1, 10) || '@sentry.example.com/1'",
)


def piece_sql(text_type: str) -> str:
    """The piece of a row, over ``conv_id`` and ``turn``."""
    h = f"md5(CAST(conv_id AS {text_type}) || '-' || CAST(turn AS {text_type}))"
    cases = " ".join(f"WHEN {n} THEN {piece.replace('(h,', '(' + h + ',').replace('(h)', '(' + h + ')').replace('|| h', '|| ' + h)}"
                     for n, piece in enumerate(PIECES))
    return f"CASE (conv_id * 31 + turn) % {len(PIECES)} {cases} END"


def planted(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "conversations").select(*KEYS, "text")
    return spread(df).withColumn("text", F.concat("text", F.lit(" "), F.expr(piece_sql("STRING")), F.lit(" end")))


def find_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Every built-in shape on its own over the planted turns, validators aside."""
    specs = C.ALL_PATTERNS
    df = planted(spark, sf).withColumn("__lc", F.lower("text")).withColumn("__lc__cf", F.expr(C.special_chars("text")))
    scans = [Scan(f"__s{i}", s.regex, s.grouped, s.gate(ident("text"), "__lc")) for i, s in enumerate(specs)]
    df = metric_barrier(with_tagged_spans(df, "text", scans, "__spans"), ["__spans"])
    names = "CASE s.id " + " ".join(f"WHEN {i} THEN {q(s.name)}" for i, s in enumerate(specs)) + " END"
    row = (f"transform(__spans, s -> named_struct('shape', {names}, 'start', CAST(s.start AS BIGINT), "
           f"'end', CAST(s.`end` AS BIGINT), 'value', s.value))")
    return df.select(*KEYS, F.inline(F.expr(row)))


def entropy_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy candidates of the planted turns with entropy and verdict (both verdicts occur)."""
    from ..functions.scalar import looks_secret, shannon_entropy
    from ..functions.sql import add
    from ..operators.detect import scan_pattern

    df = metric_barrier(scan_pattern(planted(spark, sf), "text", C.ENTROPY_CANDIDATE, "spans"), ["spans"])
    df = df.select(*KEYS, F.inline("spans"))
    df = add(df, {"entropy": f"round({shannon_entropy('value')}, 6)", "is_secret": looks_secret("value")})
    return df.select(*KEYS, F.col("start").cast("long").alias("start"), "value", "entropy", "is_secret")


def resolve_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved findings of the planted turns (overlaps drop; some rows hold more than 32)."""
    return explode_findings(find(planted(spark, sf), "text", P.Policy()), KEYS).select(
        *KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "category", "value")


#: Room of one turn in the text that all turns make together.
ROOM = 10_000_000


def resolve_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """All findings of all planted turns as those of one text (one key): the same as resolved turn by turn."""
    from ..operators.detect import with_raw_findings
    from ..operators.resolve import resolve_exploded

    table = explode_findings(with_raw_findings(planted(spark, sf), "text", P.Policy(), "raw"), KEYS, "raw")
    at = (F.col("conv_id") * 1000 + F.col("turn")).cast("long") * ROOM
    one = table.select(F.lit("all").alias("corpus"), (F.col("start") + at).alias("start"), (F.col("end") + at).alias("end"), "category", "value")
    return resolve_exploded(one, "corpus")


def mask_planted(spark: SparkSession, sf: str) -> DataFrame:
    df = mask(planted(spark, sf), "text", P.Policy())
    return df.select(*KEYS, "masked_text", F.size("findings").cast("long").alias("n_findings"))


def counts_planted(spark: SparkSession, sf: str) -> DataFrame:
    return counts_by(find(planted(spark, sf), "text", P.Policy()), ("turn",))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Planted turns with findings; every fifth conversation has no source."""
    source = F.expr("CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 's' || (conv_id % 5) END")
    return find(planted(spark, sf), "text", P.Policy()).withColumn("source", source)


def rollup_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Findings and distinct values per source and category, per source, per category and in all."""
    from ..operators.report import rollup_report

    return rollup_report(_sources(spark, sf), "source")


def sketches_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The same report merged from sketch tables of two halves of the corpus; the estimate has to be within 5%."""
    from ..operators.report import merge_sketches, rollup_report, sketch_report

    turns = _sources(spark, sf)
    halves = [sketch_report(turns.where(F.col("conv_id") % 2 == n), "source") for n in (0, 1)]
    about = merge_sketches(halves[0].unionByName(halves[1]), "source")
    exact = rollup_report(turns, "source").withColumnRenamed("n_findings", "n")
    same = [about[c].eqNullSafe(exact[c]) for c in ("level", "source", "category")]
    close = F.abs(F.col("about_values") - F.col("n_values")) <= F.greatest(F.lit(1), F.col("n_values") * 0.05)
    return about.join(exact, same[0] & same[1] & same[2]).select(about["level"], about["source"], about["category"], "n_findings", close.alias("close"))


def _lock(spark: SparkSession, sf: str):
    from .scenarios import PASSPHRASE

    vault = V.new_scratch_vault(spark, PASSPHRASE)
    return vault, V.lock(planted(spark, sf), vault, KEYS)


def lock_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Locked turns, composite key; token ids follow (conv_id, turn, first occurrence)."""
    return _lock(spark, sf)[1].locked


def lock_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The totals that a lock run reports: new tokens, spans replaced, and the vault's status."""
    vault, res = _lock(spark, sf)
    return vault.status().select(F.lit(res.n_tokens).cast("long").alias("n_tokens"),
                                 F.lit(res.n_replaced).cast("long").alias("n_replaced"), "n_entries", "max_token")


def unlock_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Lock, write, reload the vault, unlock."""
    from .scenarios import PASSPHRASE

    vault, res = _lock(spark, sf)
    path = scratch_path(spark, "locked")
    res.locked.write.parquet(path)
    res.release()
    reloaded = V.Vault.load(spark, vault.path).open(PASSPHRASE)
    return V.unlock(spark.read.parquet(path).withColumnRenamed("locked_text", "text"), reloaded).drop("n_replaced")


def unlock_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Two locks on one vault, its entries then laid out by token ranges, and all turns unlocked from there."""
    from .scenarios import PASSPHRASE

    vault, turns, path = V.new_scratch_vault(spark, PASSPHRASE), planted(spark, sf), scratch_path(spark, "locked")
    for half in (0, 1):
        res = V.lock(turns.where(F.col("conv_id") % 2 == half), vault, KEYS)
        res.locked.write.mode("append").parquet(path)
        res.release()
    vault.compact(ids_per_bucket=100)
    return V.unlock(spark.read.parquet(path).withColumnRenamed("locked_text", "text"), vault).drop("n_replaced")


QUERIES = {f.__name__: f for f in (find_planted, entropy_planted, resolve_planted, resolve_one_key, mask_planted, counts_planted, rollup_planted, sketches_planted,
                                   lock_conversations, lock_totals, unlock_conversations, unlock_compacted)}


def oracles() -> dict:
    from . import oracles as O

    src = f"SELECT conv_id, turn, text || ' ' || {piece_sql('VARCHAR')} || ' end' AS text FROM conversations"
    src_t = f"src_t AS (SELECT *, conv_id * 1000000 + turn AS sid FROM ({src}))"
    keys = "CAST(id // 1000000 AS BIGINT) AS conv_id, CAST(id % 1000000 AS BIGINT) AS turn"
    raw = O.raw_findings_sql("src_t", "sid", "text", P.Policy())
    kept = f"WITH RECURSIVE {src_t},\n{O.resolved_cte(raw)}"
    shapes = "\nUNION ALL\n".join(
        f"SELECT {keys}, {O.sq(n)} AS shape, start, \"end\", value FROM "
        + O.spans_sql("src_t", "sid", "text", rx, n not in O._ANY_VALUE) for n, rx in O.SHAPES.items())
    cand = O.spans_sql("src_t", "sid", "text", O.ENTROPY_RE2, False)
    firsts = """firsts AS (SELECT id, value, min(start) AS first FROM kept GROUP BY id, value),
tokens AS (SELECT id, value, 'PMV_' || lpad(CAST(row_number() OVER (ORDER BY id, first) AS VARCHAR), 8, '0') AS token FROM firsts)"""
    sources = f"""{kept}, tagged AS (SELECT CASE WHEN id // 1000000 % 5 = 0 THEN NULL ELSE 's' || CAST(id // 1000000 % 5 AS BIGINT) END AS source, * FROM kept),
rolled AS (SELECT source, category, CAST(count(*) AS BIGINT) AS n_findings, count(DISTINCT category || chr(1) || value) AS n_values,
  CASE GROUPING(source, category) WHEN 0 THEN 'both' WHEN 1 THEN 'group' WHEN 2 THEN 'category' ELSE 'total' END AS level
  FROM tagged GROUP BY GROUPING SETS ((source, category), (source), (category), ()))"""
    unlocked = f"""{kept},
per AS (SELECT id, count(*) AS n FROM kept GROUP BY id)
SELECT s.conv_id, s.turn, s.text AS unlocked_text, CAST(coalesce(p.n, 0) AS BIGINT) AS n_restored
FROM src_t s LEFT JOIN per p ON p.id = s.sid"""
    return {
        "unlock_compacted": unlocked,
        "rollup_planted": f"{sources} SELECT level, source, category, n_findings, n_values FROM rolled",
        "sketches_planted": f"{sources} SELECT level, source, category, n_findings, true AS close FROM rolled",
        "find_planted": f"WITH {src_t}\n{shapes}",
        "entropy_planted": (f"WITH {src_t} SELECT {keys}, start, value, round({O.entropy_sql('value')}, 6) AS entropy, "
                            f"{O.looks_secret_sql('value')} AS is_secret FROM {cand}"),
        "resolve_planted": f"{kept} SELECT {keys}, start, \"end\", category, value FROM kept",
        "resolve_one_key": (f"{kept} SELECT 'all' AS corpus, start + (id // 1000000 * 1000 + id % 1000000) * {ROOM} AS start, "
                            f"\"end\" + (id // 1000000 * 1000 + id % 1000000) * {ROOM} AS \"end\", category, value FROM kept"),
        "mask_planted": O.mask_sql("conversations", KEYS, "text", P.Policy(), src),
        "counts_planted": f"{kept} SELECT CAST(id % 1000000 AS BIGINT) AS turn, category, CAST(count(*) AS BIGINT) AS n_findings "
                          "FROM kept GROUP BY id % 1000000, category",
        "lock_conversations": f"""{kept},
{firsts},
pieces AS (SELECT k.id, k.start, k."end", t.token, coalesce(lag(k."end") OVER (PARTITION BY k.id ORDER BY k.start), 0) AS prev_end
  FROM kept k JOIN tokens t ON t.id = k.id AND t.value = k.value),
agg AS (SELECT p.id, string_agg(substring(s.text, p.prev_end + 1, p.start - p.prev_end) || p.token, '' ORDER BY p.start) AS body,
  max(p."end") AS last_end, count(*) AS n FROM pieces p JOIN src_t s ON s.sid = p.id GROUP BY p.id)
SELECT s.conv_id, s.turn, CASE WHEN a.id IS NULL THEN s.text ELSE a.body || substring(s.text, a.last_end + 1) END AS locked_text,
  CAST(coalesce(a.n, 0) AS BIGINT) AS n_replaced FROM src_t s LEFT JOIN agg a ON a.id = s.sid""",
        "lock_totals": f"""{kept},
{firsts}
SELECT CAST(count(*) AS BIGINT) AS n_tokens, (SELECT CAST(count(*) AS BIGINT) FROM kept) AS n_replaced,
  CAST(count(*) AS BIGINT) AS n_entries, arg_max(token, CAST(substr(token, 5) AS BIGINT)) AS max_token FROM tokens""",
        "unlock_conversations": unlocked,
    }
