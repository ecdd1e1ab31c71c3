"""Long runs of one character class: matches stay the same and time stays in proportion."""

import re
import time

import pytest
from pyref import SPEC
from shroud.functions.scan import metric_barrier
from shroud.operators import catalog as C
from shroud.operators.detect import find, scan_pattern
from shroud.operators.mask import mask
from shroud import policy as P

SHAPES = {"email": SPEC[0], "url_credentials": SPEC[20], "secret_assignment": SPEC[22]}
TEXTS = ["a." * 400 + "a@b.co", "a@b.com.x@y.org", ".é.a@b.co é@c.de %x@y.zz a@b.c1 @a@b.co", "x@" + "b1." * 300 + "com a@b.co",
         "_" * 500 + "token=v " + "_" * 300, "my_secret_token = 'a b' other_secret_key: x", "pwd=\"q\"my_password=r \"x\"password=s",
         "A__b_api_key=z token_x=1 ſecret=2 TO\u212aEN=3", "a.b+c://u:p@h x-y://u:@ é9a://u:pw@h 1a://q:r@ a://b://c:d@e", "1.2.3" * 300 + "http://u:pw@h"]


@pytest.mark.parametrize("name", SHAPES)
def test_same_matches_as_the_plain_shape(spark, name):
    import random

    rng = random.Random(8)
    alphabet = "ab1._%+-@:/ =_'\"éſ\n"
    words = ["token", "secret", "://", "password", "@x.com", "pwd", "api_key", "dsn"]
    texts = TEXTS + ["".join(rng.choice(words) if rng.random() < 0.2 else rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
                     for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4)
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in
           metric_barrier(scan_pattern(df, "text", C.by_name(name)), ["spans"]).collect()}
    _, rx, group, flags = SHAPES[name]
    for i, t in enumerate(texts):
        assert got[i] == [m.span(group) for m in re.finditer(rx, t, flags)], t


def test_megabyte_runs_finish_in_seconds(spark):
    big = 1_000_000
    texts = ["@" + "a." * (big // 2), "token=" + "_" * big, "://" + "a+" * (big // 2), "k=" + "secret_" * (big // 7),
             "@ = : // " + "x" * big, "a@" + "b." * (big // 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    t0 = time.time()
    assert mask(df, "text", P.Policy(enabled={P.EMAIL, P.SECRET})).select("id", "masked_text").count() == len(texts)
    find(df, "text", P.Policy(enabled={P.EMAIL, P.SECRET})).selectExpr("sum(size(findings))").first()
    assert time.time() - t0 < 60
