"""Dates against Python's calendar."""

import datetime
import random

from shroud import policy as P
from shroud.operators.dates import MONTHS, with_dates
from shroud.operators.mask import mask


def real(y, m, d):
    try:
        return datetime.date(y, m, d).isoformat()
    except ValueError:
        return None


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return {r.id: [(x.value, x.iso) for x in r.dates] for r in with_dates(df, "text", "dates").collect()}


def test_every_form_against_the_calendar(spark):
    rng, texts, want = random.Random(3), [], []
    names = sorted(MONTHS)
    for _ in range(400):
        y, m, d, name = rng.randrange(0, 2400), rng.randrange(0, 15), rng.randrange(0, 34), rng.choice(names)
        form = rng.randrange(7)
        text, iso = [
            (f"{y:04d}-{m:02d}-{d:02d}", real(y, m, d)), (f"{y:04d}/{m}/{d} 23:59", real(y, m, d)), (f"{d}.{m}.{y:04d}", real(y, m, d)),
            (f"{m}/{d}/{y:04d}", real(y, m, d) or real(y, d, m)), (f"{d} {name} {y:04d}", real(y, MONTHS[name], d)),
            (f"{name.upper()} {d}th, {y:04d}", real(y, MONTHS[name], d)), (f"{d}. {name.title()} {y:04d}", real(y, MONTHS[name], d))][form]
        texts.append(f"Ünter 😀 am {text}, und")
        want.append([(text, iso)] if iso else [])
    got = found(spark, texts)
    assert [got[n] for n in range(len(texts))] == want


def test_leap_years_and_borders(spark):
    texts = ["1900-02-29 2000-02-29 2023-02-29 2024-02-29", "2024-04-31 and 30.04.2024", "x2024-01-01 2024-01-012 12024-01-01", "2024-01.02 1/2-2024",
             "2024-05-06T07:08:09.5+02:00 2024-05-06T25:00", None, "", "May I ask 5 May? May 5"]
    got = found(spark, texts)
    assert got[0] == [("2000-02-29", "2000-02-29"), ("2024-02-29", "2024-02-29")]
    assert got[1] == [("30.04.2024", "2024-04-30")]
    assert got[2] == got[3] == got[5] == got[6] == got[7] == []
    assert got[4] == [("2024-05-06T07:08:09.5+02:00", "2024-05-06")] or got[4][0][1] == "2024-05-06"


def test_masking_dates(spark):
    df = spark.createDataFrame([(1, "Born 3 March 1990, not 31 April 1990; jo@x.com")], "id int, text string")
    on = P.Policy(enabled={P.DATE, P.EMAIL}, dates=True)
    assert on.contextual_status == "active"
    assert mask(df, "text", on).first().masked_text == "Born [DATE], not 31 April 1990; [EMAIL]"
    assert mask(df, "text", P.Policy(enabled={P.EMAIL}, dates=True)).first().masked_text == "Born 3 March 1990, not 31 April 1990; [EMAIL]"
