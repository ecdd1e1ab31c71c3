"""The sequence tagger: decoding against all paths, counts against a plain loop, accuracy on names never seen."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from shroud import policy as P
from shroud.operators import tagger as T
from shroud.operators.mask import mask
from shroud.plans import entities as E

SF = "/root/testdata/sf0.001"


def random_model(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros((T.SLOTS, T.TAGS))
    counts[:50] = rng.integers(0, 40, (50, T.TAGS))
    moves = rng.integers(0, 30, (T.TAGS, T.TAGS)).astype(float)
    for inside in range(2, T.TAGS, 2):  # an inside tag follows only its own category
        moves[[t for t in range(T.TAGS) if t not in (inside - 1, inside)], inside] = 0
    return T.Tagger(counts, moves), rng


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_decoding_against_all_paths(length):
    model, rng = random_model(length)
    emit = model.scores(rng.integers(0, 60, (5, length, len(T.KINDS))))
    path, ahead, behind, total = model.decode(emit)
    for n in range(5):
        weight = {}
        for tags in product(range(T.TAGS), repeat=length):
            steps = [0, *tags, 0]
            weight[tags] = sum(model.step[a, b] for a, b in zip(steps, steps[1:])) + sum(emit[n, i, t] for i, t in enumerate(tags))
        assert tuple(path[n]) == max(weight, key=weight.get)
        z = np.log(sum(np.exp(w) for w in weight.values()))
        assert np.isclose(total[n], z)
        for first, last, begin in T._spans(path[n].tolist()):
            share = sum(np.exp(w - z) for tags, w in weight.items() if (first, last, begin) in set(T._spans(list(tags))))
            assert np.isclose(model.span_score(emit[n], ahead[n], behind[n], total[n], first, last, begin), share)


def test_no_inside_tag_without_its_beginning():
    model, rng = random_model(9)
    for tags in product(range(T.TAGS), repeat=3):
        if any(b and b % 2 == 0 and a not in (b - 1, b) for a, b in zip((0, *tags), tags)):
            assert sum(model.step[a, b] for a, b in zip((0, *tags), tags)) == -np.inf


def test_runs_and_tags():
    text = "I saw Ludwig van Beethoven & Sons in Saint-Denis. ÉMILE d'Arc, 3 Ärzte."
    found = [[text[a:b] for a, b in r.spans] for r in T.runs(text)]
    assert found == [["I"], ["Ludwig", "van", "Beethoven", "&", "Sons"],
                     ["Saint", "Denis"], ["ÉMILE"], ["Arc"], ["Ärzte"]]
    run = list(T.runs(text))[1]
    assert T.tags_of(run, [(6, 26, P.PERSON)]) == [1, 2, 2, 0, 0]
    assert T.tags_of(run, [(6, 12, P.ORG), (13, 26, P.ORG), (6, 26, "email")]) == [5, 5, 6, 0, 0]
    assert list(T.runs("")) == [] and list(T.runs("no names 3 at all")) == []


def test_counts_match_a_plain_loop(spark):
    rows = [(0, "Anna met Bob Lee.", [(0, 4, P.PERSON, "x", 0.5), (9, 16, P.PERSON, "y", 0.5)]), (1, "In Rome. In Rome", [(3, 7, P.LOCATION, "", 0.1)]),
            (2, None, [(0, 3, P.ORG, "", 0.0)]), (3, "Nothing here", None), (4, "", []), (0, "Anna met Bob Lee.", [(0, 4, P.PERSON, "x", 0.5)])]
    df = spark.createDataFrame(rows, "slot long, text string, n array<struct<start:int,end:int,category:string,value:string,score:double>>").repartition(3)
    want = Counter()
    for _, text, labels in rows:
        for run in T.runs(text or ""):
            tags = T.tags_of(run, [x[:3] for x in labels or []])
            want.update((s, t) for slots, t in zip(run.slots, tags) for s in slots)
            want.update((T.SLOTS + a, b) for a, b in zip([0, *tags], [*tags, 0]))
    assert {(r.slot, r.tag): r.n for r in T.count_features(df, "text", "n").collect()} == dict(want)
    model = T.train_tagger(df, "text", "n")
    again = T.Tagger.from_table(model.table(spark))
    assert np.array_equal(again.counts, model.counts) and np.array_equal(again.moves, model.moves)


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame([("Anna met Bob.", [])], "text string, f array<struct<start:int,end:int,category:string,value:string>>")
    model = T.train_tagger(df, "text", "f")
    assert model.find(["Anna met Bob in Rome.", None, ""]) == [[], [], []]
    assert T.train_tagger(df.where("text IS NULL"), "text", "f").find(["Anna"]) == [[]]


def test_held_out_names(spark):
    """Names of the held-out fifth are in no training text; the prose around them is full of capitals at sentence starts."""
    sf = "/root/testdata/sf0.01"
    truth = {(r.doc_id, x.start, x.end, x.category) for r in E.named_documents(spark, sf).where(f"doc_id % 5 = {E.HELD_OUT}").collect() for x in r.labels}
    rows = E.entities_documents(spark, sf).where(f"doc_id % 5 = {E.HELD_OUT} AND score >= {P.CONTEXTUAL_MIN_SCORE}").collect()
    got = {(r.doc_id, r.start, r.end, r.category) for r in rows}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in rows)


def test_masking_with_a_tagger(spark):
    model = E.entity_model(spark, "/root/testdata/sf0.01")
    df = spark.createDataFrame([(1, "Yesterday we called on Tora Belimpu again. Mail tora@mill.example.com"), (2, None), (3, "")], "id long, text string")
    policy = P.Policy(enabled={P.PERSON, P.LOCATION, P.EMAIL}, tagger=model)
    assert policy.contextual_status == "active" and P.Policy().contextual_status == "no_gazetteer"
    rows = {r.id: r.masked_text for r in mask(df, "text", policy).collect()}
    assert rows == {1: "Yesterday we called on [NAME] again. Mail [EMAIL]", 2: None, 3: ""}
    off = mask(df, "text", P.Policy(enabled={P.EMAIL, P.LOCATION}, tagger=model)).where("id = 1").first()
    assert off.masked_text == "Yesterday we called on Tora Belimpu again. Mail [EMAIL]"
    strict = P.Policy(enabled={P.PERSON}, tagger=model, contextual_min_score=1.01)
    assert not mask(df, "text", strict).where("id = 1").first().findings
