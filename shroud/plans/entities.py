"""Queries on names and dates that no list holds.

Each document gets a sentence with made-up names by a rule over the hash of its
id, each order a note with its date in one of many forms, valid or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P
from ..operators import tagger as T
from ..operators.mask import mask
from ..sources.tables import read_table, spread

HELD_OUT = 2  # documents whose id leaves this remainder by 5 are never learned from
_FIRST, _NEXT = "KaMoTeRuLiSaVeNoDaPiGuHeJoBiFaZu", "rinlasmokdunterolvikhanbelsorgimpazedottulwenfay"


def _syllable(source: str, width: int, digit: int) -> str:
    return f"substr('{source}', {width} * instr('0123456789abcdef', substr(md5(CAST(doc_id AS STRING)), {digit}, 1)) - {width - 1}, {width})"


def _name(at: int, parts: int) -> str:
    return " || ".join([_syllable(_FIRST, 2, at)] + [_syllable(_NEXT, 3, at + 1 + i) for i in range(parts)])


PERSON = f"({_name(1, 1)} || ' ' || {_name(4, 2)})"
PLACE = f"({_name(8, 1)} || substr('villburgfeldhafn', 4 * (doc_id % 4) + 1, 4))"
FIRM = f"({_name(12, 2)} || ' ' || substr('GroupWerkeWorksUnion', 5 * (doc_id % 4) + 1, 5))"
_KIND = {"P": (P.PERSON, PERSON), "L": (P.LOCATION, PLACE), "O": (P.ORG, FIRM)}
#: A sentence for each remainder of the id by 6; a letter stands for a name.
SENTENCES = (("Yesterday we called on ", "P", " again."), ("P", " moved to ", "L", " last year."), ("They met ", "P", " at ", "O", " near ", "L", "."),
             ("Our office in ", "L", " hired ", "P", "."), ("O", " announced a plan in ", "L", "."), ("Please write to ", "P", " of ", "O", "."))


def named_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, text, labels)``: every document followed by its sentence, and where the names stand."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts, labels = [], []
    for pieces in SENTENCES:
        at, sql, found = "length(text) + 1", [], []
        for piece in pieces:
            if piece in _KIND:
                kind, name = _KIND[piece]
                found.append(f"named_struct('start', {at}, 'end', {at} + length({name}), 'category', '{kind}', 'value', {name})")
                sql.append(name)
            else:
                sql.append(f"'{piece}'")
            at += f" + length({sql[-1]})"
        texts.append(f"text || ' ' || {' || '.join(sql)}")
        labels.append(f"array({', '.join(found)})")
    case = lambda xs: f"CASE doc_id % {len(xs)} " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(xs)) + " END"
    return spread(docs).select("doc_id", F.expr(case(texts)).alias("text"), F.expr(case(labels)).alias("labels"))


def entity_model(spark: SparkSession, sf: str) -> T.Tagger:
    learned = named_documents(spark, sf).where(F.col("doc_id") % 5 != HELD_OUT)
    return T.train_tagger(learned, "text", "labels")


def entities_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Persons, places and firms of every document with their scores, from a model that saw four in five of them."""
    docs = named_documents(spark, sf).select("doc_id", "text")
    found = T.with_tagged_entities(docs, "text", entity_model(spark, sf), "e")
    return found.select("doc_id", F.inline("e")).select("doc_id", F.col("start").cast("long").alias("start"),
                                                       F.col("end").cast("long").alias("end"), "category", "value", "score")


def mask_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every document masked with the learned tagger beside the default shapes."""
    policy = P.Policy(enabled=P.DEFAULT_ENABLED | {P.ORG}, tagger=entity_model(spark, sf))
    out = mask(named_documents(spark, sf).select("doc_id", "text"), "text", policy)
    return out.select("doc_id", "masked_text", F.size("findings").cast("long").alias("n_findings"))


# ------------------------------------------------------------------------ dates

#: SQL that Spark and DuckDB read alike. Days 29 and 31 stand in for some real ones, so that some of the dates do not exist.
_Y, _M = "CAST(year(o_orderdate) AS {text})", "month(o_orderdate)"
_D = "CASE o_orderkey % 3 WHEN 0 THEN day(o_orderdate) WHEN 1 THEN 29 ELSE 31 END"
_PAD = "lpad(CAST({x} AS {{text}}), 2, '0')"


def _month_name(names: str) -> str:
    return "CASE month(o_orderdate) " + " ".join(f"WHEN {n + 1} THEN '{w}'" for n, w in enumerate(names.split())) + " END"


def dated_note_sql(text: str) -> str:
    """The note of an order; ``text`` is the engine's name of the string type."""
    y, m, d = _Y, _PAD.format(x=_M), _PAD.format(x=f"({_D})")
    plain_d = "CAST((" + _D + ") AS {text})"
    english = _month_name("January February March April May June July August September October November December")
    german = _month_name("Januar Februar März April Mai Juni Juli August September Oktober November Dezember")
    french = _month_name("janvier février mars avril mai juin juillet août septembre octobre novembre décembre")
    spanish = _month_name("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre")
    forms = (f"{y} || '-' || {m} || '-' || {d}", f"{y} || '/' || {m} || '/' || {d}", f"{y} || '.' || {m} || '.' || {d}",
             f"{y} || '-' || {m} || '-' || {d} || 'T14:30:05.25Z'", f"{d} || '.' || {m} || '.' || {y}", f"{m} || '/' || {d} || '/' || {y}",
             f"{d} || '/' || {m} || '/' || {y}", f"{plain_d} || ' ' || {english} || ' ' || {y}", f"{english} || ' ' || {plain_d} || 'th, ' || {y}",
             f"{plain_d} || '. ' || {german} || ' ' || {y}", f"{plain_d} || ' ' || {french} || ' ' || {y}",
             f"{plain_d} || ' de ' || {spanish} || ' de ' || {y}", f"'nº 7/' || {y} || ', 1.2.3, 99/99/' || {y}")
    case = f"CASE o_orderkey % {len(forms)} " + " ".join(f"WHEN {n} THEN {f}" for n, f in enumerate(forms)) + " END"
    return f"'Order ' || CAST(o_orderkey AS {{text}}) || ' of ' || {case} || ' is here, é.'".format(text=text)


def find_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Every date of every document and of every order's note, with the day it names."""
    from ..operators.dates import with_dates

    notes = read_table(spark, sf, "orders").select(F.lit("orders").alias("source_table"), F.col("o_orderkey").alias("id"),
                                                   F.expr(dated_note_sql("STRING")).alias("text"))
    docs = read_table(spark, sf, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("id"), "text")
    from ..functions.scan import metric_barrier

    found = metric_barrier(with_dates(spread(notes.unionByName(docs)), "text", "dates"), ["dates"])
    return found.select("source_table", "id", F.inline("dates")).select(
        "source_table", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", "iso")


def find_dates_sql() -> str:
    """Shapes written out for this side; days read by ``try_strptime``."""
    from . import oracles as O

    names = {"january jan januar janvier enero": 1, "february feb februar fxvrier febrero": 2, "march mar mxrz mars marzo": 3,
             "april apr avril abril": 4, "may mai mayo": 5, "june jun juni juin junio": 6, "july jul juli juillet julio": 7,
             "august aug aoxt agosto": 8, "september sep sept septembre septiembre": 9, "october oct oktober octobre octubre": 10,
             "november nov novembre noviembre": 11, "december dec dezember dxcembre diciembre": 12}
    words = {w: n for ws, n in names.items() for w in ws.split()}
    month = "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
    time = r"(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
    shapes = {0: r"()(\b[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}" + time + r"\b)()",
              1: r"()(\b[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}\b)()",
              2: r"(?i)()(\b[0-9]{1,2}(?:st|nd|rd|th|\.|er)? (?:of |de )?" + month + r"\.?,?(?: de)? [0-9]{4}\b)()",
              3: r"(?i)()(\b" + month + r"\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}\b)()"}
    spans = "\nUNION ALL ".join(f"SELECT {n} AS shape, * FROM {O.spans_sql('src', 'k', 'text', rx, False)}" for n, rx in shapes.items())
    number = "CASE regexp_extract(" + O.ascii_view("lower(value)") + f", '{month}') " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in words.items()) + " ELSE 0 END"
    day = lambda y, m, d: f"try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d')"
    return f"""WITH src AS (
  SELECT 'orders' AS source_table, o_orderkey AS id, o_orderkey * 2 AS k, {dated_note_sql('VARCHAR')} AS text FROM orders
  UNION ALL SELECT 'documents', doc_id, doc_id * 2 + 1, text FROM documents
), found AS ({spans}
), parts AS (SELECT *, regexp_extract_all(value, '[0-9]+') AS n, CAST({number} AS VARCHAR) AS m FROM found
), days AS (
  SELECT *, CASE shape WHEN 0 THEN {day('n[1]', 'n[2]', 'n[3]')}
    WHEN 1 THEN (CASE WHEN contains(value, '/') THEN coalesce({day('n[3]', 'n[1]', 'n[2]')}, {day('n[3]', 'n[2]', 'n[1]')})
      ELSE {day('n[3]', 'n[2]', 'n[1]')} END)
    ELSE {day('n[2]', 'm', 'n[1]')} END AS day FROM parts
)
SELECT src.source_table, src.id, start, "end", value, strftime(day, '%Y-%m-%d') AS iso
FROM days JOIN src ON src.k = days.id WHERE day IS NOT NULL"""


QUERIES = {f.__name__: f for f in (entities_documents, mask_entities, find_dates)}


def oracles() -> dict:
    return {"find_dates": find_dates_sql()}
