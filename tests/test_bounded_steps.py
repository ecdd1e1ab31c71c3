"""Steps that hold little at a time, whatever they are given."""

import random
import tracemalloc

import numpy as np
import pandas as pd
from shroud.operators import tagger as T
from shroud.sources import files as FL


def test_files_go_to_spark_in_lists(tmp_path):
    paths = []
    for n in range(2500):
        (tmp_path / f"f{n}").write_bytes(b"\xff" if n == 7 else f"text {n}".encode())
        paths.append(str(tmp_path / f"f{n}"))
    frames = list(FL._read(iter([pd.DataFrame({"path": [*paths, str(tmp_path / "none")]})])))
    assert [len(f) for f in frames] == [FL.LISTED, FL.LISTED, 501]
    rows = pd.concat(frames)
    assert rows["path"].tolist()[:-1] == paths and rows["text"].iloc[9] == "text 9"
    assert rows["reason"].dropna().tolist() == ["invalid UTF-8", "unreadable: FileNotFoundError"]


def _texts(n, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choices("abcdefgh", k=6)).capitalize()
    return [f"{name()} {name()} met {name()} near {name()}-{name()}. " * 5 for _ in range(n)]


def _peak(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_counting_and_finding_hold_few_words(monkeypatch):
    texts = _texts(6000, 1)
    rows = [(t, [{"start": 0, "end": 13, "category": "person"}]) for t in texts]
    counted = T._counted(rows)
    model = T.Tagger(*_arrays(counted))
    whole = model.find(texts)
    monkeypatch.setattr(T, "HELD_WORDS", 300)
    assert counted.equals(T._counted(rows)) and model.find(texts) == whole and any(whole)
    monkeypatch.setattr(T, "HELD_WORDS", 50_000)
    assert _peak(lambda: T._counted(rows)) < 90 << 20 and _peak(lambda: [model.find(texts)]) < 120 << 20


def _arrays(rows):
    counts, moves = np.zeros((T.SLOTS, T.TAGS)), np.zeros((T.TAGS, T.TAGS))
    for slot, tag, n in rows.itertuples(index=False):
        (counts if slot < T.SLOTS else moves)[slot if slot < T.SLOTS else slot - T.SLOTS, tag] = n
    return counts, moves
