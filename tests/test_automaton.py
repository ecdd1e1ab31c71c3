"""Term automata against one regular expression for each term."""

import random
import re

import pytest
from shroud.operators import automaton as A


def plain(terms, text, fold):
    out = set()
    for term, category in terms:
        term = term.strip(" ") if fold else term
        if not term:
            continue
        border = str.isalnum if fold else A.is_word
        low, want = (A.folded(text), A.folded(term)) if fold else (text, term)
        rx = (r"(?<!\w)" if border(want[0]) else "") + re.escape(want) + (r"(?!\w)" if border(want[-1]) else "")
        out |= {(m.start(), m.end(), category, text[m.start():m.end()]) for m in re.finditer(rx, low)}
    return sorted(out)


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("per", [1, 3, 50_000])
def test_against_regular_expressions(spark, fold, per):
    rng = random.Random(per + fold)
    terms = [(t, rng.choice(["a", "b"])) for t in ["so", "So so", "_x_", "->", "**", "@acme", "C++", "Straße", "ΣΟΦΙΑΣ", "İz", "x_y", "😀", " pad ", "#42", "so-so", "é"]]
    terms += [("so", "a"), ("so", "b"), (None, "a"), ("", "a"), ("  ", "b")]
    pieces = ["so", "SO so", "_x_", "__x__", "-->", "***", "****", "me@acme", "@ACME", "c++", "xC++y", "straße", "STRASSE", "σοφιας", "İZ", "iz", "X_Y", "😀😀", "pad", " ",
              "#421", "#42", "so-so-so", "É", "\n", "ﬁ"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(8))) + rng.choice(["", " "]) + "".join(rng.choices(pieces, k=2)) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(n, t, "q") for n, t in enumerate(texts)], "id int, text string, term string").repartition(3)
    files = A.build_terms(spark.createDataFrame(terms, "term string, category string"), fold, per)
    real = [(t, c) for t, c in terms if t]
    for r in A.with_terms(df, "text", files, "hits").collect():
        assert [tuple(x) for x in r.hits] == (plain(real, r.text, fold) if r.text else []), r.text


def test_no_terms(spark):
    df = spark.createDataFrame([("so",)], "text string")
    files = A.build_terms(spark.createDataFrame([], "term string, category string"), True)
    assert A.with_terms(df, "text", files, "hits").first().hits == []


def test_the_plan_has_no_shuffle(spark):
    files = A.build_terms(spark.createDataFrame([("so", "a")], "term string, category string"), True)
    plan = A.with_terms(spark.range(5).selectExpr("CAST(id AS STRING) AS text"), "text", files, "hits")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
