"""dotenv mode, keyword tables, contextual (gazetteer) detection, custom detectors."""

from pyspark.sql import functions as F

from helpers import REGEX_POLICY, masked, run_mask
from shroud import policy as P
from shroud.operators import contextual as CX
from shroud.operators.detect import find
from shroud.operators.dotenv import is_dotenv_name
from shroud.sources import policy_store as PS


def test_dotenv_cases(spark):
    env = ("# config\n" "LOG_LEVEL=info\n" "APP_PORT=8080\n" "DEBUG=true\n"
           "API_BASE=https://api.example.com\n" 'NAME="Jane Doe"\n')
    rows = run_mask(spark, [env, "export SECRET_THING=abcdef\n", "TOKEN=abcdef  # my token\n", "LOG_LEVEL=info"],
                    REGEX_POLICY, dotenv=True)
    out = rows[0].masked_text
    for kept in ("APP_PORT=8080", "DEBUG=true", "# config", "LOG_LEVEL=[SECRET]", "API_BASE=[SECRET]",
                 "NAME=[SECRET]"):
        assert kept in out
    assert "Jane Doe" not in out
    assert rows[1].masked_text.strip() == "export SECRET_THING=[SECRET]"
    assert "abcdef" not in rows[2].masked_text and "# my token" in rows[2].masked_text
    assert masked(spark, "LOG_LEVEL=info").masked_text == "LOG_LEVEL=info"


def test_dotenv_line_separators_and_values(spark):
    text = "A=1_000\rB=nan\x0bC=0x1F\u2028D= 'yes' \nE=b#c\r\nF=\"\"\x1cG=x y # z"
    r = masked(spark, text, P.Policy(enabled=set()), dotenv=True)
    # U+2028 ends a line (value "0x1F\u2028"); "nan\v", "'yes'" and '""' stay readable
    assert r.masked_text == "A=1_000\rB=nan\x0bC=[SECRET]D= 'yes' \nE=[SECRET]#c\r\nF=\"\"\x1cG=[SECRET] # z"


def test_dotenv_flag_per_row_from_file_name(spark):
    df = spark.createDataFrame([(".env", "K=v1"), ("prod.env", "K=v2"), ("notes.txt", "K=v3"), (".env.local", "K=v4")],
                               "file_name string, text string")
    out = find(df, "text", P.Policy(enabled=set()), dotenv=is_dotenv_name(F.col("file_name")))
    got = {r.file_name: len(r.findings) for r in out.collect()}
    assert got == {".env": 1, "prod.env": 1, "notes.txt": 0, ".env.local": 1}


def test_keyword_table_edits(spark):
    one = lambda *w: PS.keyword_table(spark, w)
    kw = PS.add_keywords(one("Zeta", " ", "Project Titan"), one("  project titan ", "Ace", "ACE", "Beta"))
    assert [r.keyword for r in PS.list_keywords(kw).collect()] == ["Zeta", "Project Titan", "Ace", "Beta"]
    kw = PS.remove_keywords(kw, one("ACE", "nothing"))
    assert [r.keyword for r in PS.list_keywords(kw).collect()] == ["Zeta", "Project Titan", "Beta"]
    assert PS.add_keywords(one(), one("x")).count() == 1


def test_keyword_table_equals_the_list(spark):
    import random

    rnd = random.Random(6)
    kws = ["Titan", "C++", "a.b", "straße", "ΣΟΦΙΑ", "@acme", "x_y", "so", "so so", "_u", "++", "Kelvin"]
    fillers = ["titan", "TITANS", "c++", "xC++y", "A.B", "aXb", "STRAßE", "σοφια", "@ACME", "me@acme", "X_Y", "so", "SO  so", "a_u", "_U",
               "+++", "\u212aelvin", "é"]
    texts = ["".join(rnd.choice(fillers) + rnd.choice([" ", "", ".", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(250)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None])], "doc_id long, text string").repartition(4)
    table = spark.createDataFrame([(k,) for k in kws], "keyword string")

    def run(policy):
        return {r.doc_id: [tuple(f) for f in r.findings] for r in find(df, "text", policy).collect()}

    listed = run(P.Policy(enabled={P.KEYWORD}, keywords=kws))
    assert run(P.Policy(enabled={P.KEYWORD}, keyword_table=table)) == listed


def _gazetteer(spark):
    return spark.createDataFrame([("Barack Obama", "PERSON", 0.9), ("Paris", "LOCATION", 0.8),
                                  ("John Smith", "person", 0.7), ("Springfield", "location", 0.2)],
                                 "term string, category string, score double")


def test_contextual_cases(spark):
    pol = P.Policy(enabled={P.PERSON, P.LOCATION, P.ORG, P.EMAIL}, gazetteer=_gazetteer(spark))
    assert pol.contextual_status == "active"
    rows = run_mask(spark, ["The tram took Barack Obama home.", "He has a flat in Paris now.",
                            "Send John Smith a note: john@mill.example.com", "Springfield is low score", "Parisian"], pol)
    assert "[NAME]" in rows[0].masked_text and "Obama" not in rows[0].masked_text
    assert "[LOCATION]" in rows[1].masked_text and "Paris" not in rows[1].masked_text
    assert "[NAME]" in rows[2].masked_text and "[EMAIL]" in rows[2].masked_text
    assert rows[3].masked_text == "Springfield is low score" and rows[4].masked_text == "Parisian"


def test_contextual_paths_agree(spark, monkeypatch):
    texts = ["The tram took Barack Obama across Paris.", "Barack Obamas Paris-Paris John Smith", None, "", "Paris", "Paris\u0301 é Paris"]
    ids = [0, 1, 2, 3, None, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    pol = P.Policy(enabled={P.PERSON, P.LOCATION}, gazetteer=_gazetteer(spark))

    def run():
        return sorted((str(r.doc_id), tuple(tuple(f) for f in r.findings)) for r in find(df, "text", pol).collect())

    whole = run()
    monkeypatch.setattr("shroud.operators.automaton.build_terms.__defaults__", (1,))  # one automaton for each term
    assert whole == run()
    assert [x for x in whole if x[0] == "1"][0][1] == ((14, 19, "location", "Paris"), (20, 25, "location", "Paris"), (26, 36, "person", "John Smith"))


def test_contextual_status_without_gazetteer(spark):
    assert P.Policy().contextual_status == "no_gazetteer"
    assert P.Policy(enabled={P.EMAIL}).contextual_status == "off"
    r = masked(spark, "Barack Obama a@b.com", P.Policy())
    assert r.masked_text == "Barack Obama [EMAIL]"


def test_custom_detector(spark):
    def find_upper_words(text):
        import re

        return [(m.start(), m.end(), "org") for m in re.finditer(r"\b[A-Z]{4,}\b", text)]

    det = CX.custom_detector(find_upper_words)
    r = run_mask(spark, ["ACME hired a@b.com"], P.Policy(enabled={P.EMAIL, P.ORG}))[0]
    assert r.masked_text == "ACME hired [EMAIL]"
    from shroud.operators.mask import mask

    df = spark.createDataFrame([(0, "ACME hired a@b.com")], "doc_id long, text string")
    out = mask(df, "text", P.Policy(enabled={P.EMAIL, P.ORG}), custom=[det]).first()
    assert out.masked_text == "[ORG] hired [EMAIL]"


def test_gazetteer_many_occurrences(spark):
    import re

    text = " ".join(("Paris John Smith Parisian Barack Obama's" if i % 2 else "x Paris-Paris y") for i in range(400))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    pol = P.Policy(enabled={P.PERSON, P.LOCATION}, gazetteer=_gazetteer(spark))
    got = [(f.start, f.end, f.value) for f in find(df, "text", pol).first().findings]
    want = sorted([(m.start(), m.end(), m.group()) for t in ("Barack Obama", "Paris", "John Smith")
                   for m in re.finditer(r"(?<!\w)" + re.escape(t) + r"(?!\w)", text)])
    assert got == want


def test_dotenv_random_against_python(spark):
    import random

    import pyref
    from shroud.operators.dotenv import with_dotenv_spans

    rnd = random.Random(11)
    keys = ["A", "export B", "  C_1", "d.e", "#F", "9G", "\tH", "export\tI"]
    vals = ["x", "1_000", "nan", " 'yes' ", '"q v"', "'u'", "", "a#b", "0x1F", "é😀", "true ", "  ", "1e5", "٣", "v w"]
    seps = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", " # c\n", ""]
    texts = []
    for _ in range(300):
        texts.append("".join(rnd.choice(keys) + rnd.choice(["=", " = ", "=\t"]) + rnd.choice(vals) + rnd.choice(seps)
                             for _ in range(rnd.randint(0, 8))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = with_dotenv_spans(df, "text", "env").collect()
    for r in rows:
        t = texts[r.doc_id]
        assert [(s.start, s.end, "secret", s.value) for s in r.env] == pyref.dotenv_findings(t), repr(t)


def test_keywords_random_against_python(spark):
    import random
    import re

    from shroud.operators.detect import with_raw_findings

    rnd = random.Random(5)
    words = ["Titan", "C++", "a.b", "straße", "ΣΟΦΙΑ", "@acme", "x_y", "Ünïcode", "NaN", "so"]
    fillers = ["titan", "TITAN", "Titans", "c++", "xC++y", "A.B", "aXb", "STRAßE", "σοφια", "@ACME", "me@acme",
               "X_Y", "ünïcode", "nan", "SO", "also", "so-so", " ", ", ", "\n", "é"]
    kws = ["Titan", "C++", "a.b", "straße", "ΣΟΦΙΑ", "@acme", "x_y", "Ünïcode", "so"]
    texts = ["".join(rnd.choice(fillers + words) + rnd.choice([" ", "", "."]) for _ in range(rnd.randint(0, 12)))
             for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pol = P.Policy(enabled={P.KEYWORD}, keywords=kws)
    rows = with_raw_findings(df, "text", pol, "raw").collect()

    def py(text):
        out = []
        for k in kws:
            w = k.strip()
            rx = (r"\b" if w[:1].isalnum() else "") + re.escape(w) + (r"\b" if w[-1:].isalnum() else "")
            out += [(m.start(), m.end(), "keyword", m.group()) for m in re.finditer(rx, text, re.I)]
        return sorted(out)

    for r in rows:
        assert sorted((f.start, f.end, f.category, f.value) for f in r.raw) == py(texts[r.doc_id]), texts[r.doc_id]


def test_gazetteer_many_heads(spark):
    import re

    terms = [(f"Name{i} Surname{i}", "person") for i in range(60)] + [("Paris", "location")]
    gaz = spark.createDataFrame(terms, "term string, category string")
    text = "Met Name7 Surname7 and Name70 Surname7 in Paris; Name59 Surname59. Name1 Surname10"
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = [(f.start, f.end, f.category) for f in
           find(df, "text", P.Policy(enabled={P.PERSON, P.LOCATION}, gazetteer=gaz)).first().findings]
    want = sorted([(m.start(), m.end(), c) for t, c in terms for m in re.finditer(r"(?<!\w)" + re.escape(t) + r"(?!\w)", text)])
    assert got == want and len(got) == 3, got
