"""Names that no list holds: a sequence tagger for persons, places and organisations.

Candidates are runs of capitalised words (joined by a space, a hyphen, an
apostrophe or a particle such as ``van``); everything else is no entity for
certain, so a text falls apart into short runs that are decoded on their own,
whatever its length. Each word of a run emits one feature of each kind: itself,
its shape, its ending, its neighbours, its place. The model is a hidden Markov
model over begin/inside tags whose counts Spark adds up over labelled texts, in
tables of a fixed number of hashed slots, so its size does not grow with the
corpus. Viterbi finds a run's best tags; a finding's score is the exact
posterior probability of its span, by forward and backward sums.

Null and empty texts have no findings. Labels that are null, lie outside a
text or cover no candidate word teach nothing. Without any labelled entity the
model tags nothing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P

CATEGORIES = (P.PERSON, P.LOCATION, P.ORG)
#: Tag 0 is no entity; then a begin and an inside tag for each category.
TAGS = 1 + 2 * len(CATEGORIES)
KINDS = ("word", "shape", "ending", "before", "after", "place")
SLOTS = 1 << 18
SMOOTHING = 0.05
#: Words of runs that wait to be decoded or counted together.
HELD_WORDS = 50_000
#: Words that may stand inside a name (fixed values).
PARTICLES = "of the and de la del der den van von du di da le y und für et & zu".split()
SCORED_DDL = "array<struct<start:int,end:int,category:string,value:string,score:double>>"


def _capitals() -> str:
    """Character class of all upper and title case letters, as ranges."""
    ranges: list[list[int]] = []
    for cp in range(0x110000):
        if unicodedata.category(chr(cp)) in ("Lu", "Lt"):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[" + "".join(chr(a) + (f"-{chr(b)}" if b > a else "") for a, b in ranges) + "]"


_CAPITAL = _capitals()
_PARTICLE = "|".join(re.escape(p) for p in PARTICLES)
_RUN = re.compile(rf"(?<!\w){_CAPITAL}\w*(?:(?: (?:{_PARTICLE}) | |-|'|’){_CAPITAL}\w*)*")
_WORD = re.compile(r"\w+|&")
_BEFORE = re.compile(r"(\w+|[^\w\s])\s*\Z")
_AFTER = re.compile(r"\s*(\w+|[^\w\s])")
_NEAR = 48


def _shape(word: str) -> str:
    if word.isupper():
        return "XX" if len(word) > 1 else "X"
    if any(c.isdigit() for c in word):
        return "Xd"
    return "Xx" if word[0].isupper() and word[1:].islower() else "xx" if word.islower() else "XxX"


@dataclass
class Run:
    """Words of a run, as places in the text, and each word's features as slots."""

    spans: list[tuple[int, int]]
    slots: list[list[int]]


def runs(text: str) -> Iterator[Run]:
    for m in _RUN.finditer(text):
        start, end = m.span()
        spans = [(start + w.start(), start + w.end()) for w in _WORD.finditer(m[0])]
        words = [text[a:b] for a, b in spans]
        low = [w.lower() for w in words]
        left, right = _BEFORE.search(text[max(0, start - _NEAR):start]), _AFTER.match(text[end:end + _NEAR])
        before = left[1].lower() if left else "<"
        around = [before, *low, right[1].lower() if right else ">"]
        first = "s" if before in "<.!?\"" else "m"
        slots = []
        for i, w in enumerate(words):
            seen = (low[i], _shape(w), low[i][-3:], around[i], around[i + 2], f"{first}{min(i, 3)}{min(len(words), 4)}")
            slots.append([zlib.crc32(x.encode(), k) % SLOTS for k, x in enumerate(seen)])
        yield Run(spans, slots)


def tags_of(run: Run, labels: list[tuple[int, int, str]]) -> list[int]:
    """Begin and inside tags of a run's words under labelled spans ``(start, end, category)``."""
    out, last = [], None
    for a, b in run.spans:
        hit = next(((s, e, c) for s, e, c in labels if s <= a and b <= e and c in CATEGORIES), None)
        out.append(0 if hit is None else 1 + 2 * CATEGORIES.index(hit[2]) + (hit == last))
        last = hit
    return out


class Tagger:
    """Log probabilities of the counted model."""

    def __init__(self, counts: np.ndarray, moves: np.ndarray):
        """``counts[slot, tag]`` of features; ``moves[tag, tag]`` between words, with 0 also as the border of a run."""
        self.counts, self.moves = counts, moves
        words = moves.sum(axis=0)  # how often each tag was entered; tag 0 also at the end of runs
        total = np.maximum(words, 1.0)
        self.emit = np.log((counts + SMOOTHING) / (total + SMOOTHING * SLOTS))
        allowed = np.ones((TAGS, TAGS), bool)
        for inside in range(2, TAGS, 2):
            allowed[:, inside] = False
            allowed[inside - 1:inside + 1, inside] = True
        step = np.where(allowed, moves + 0.1, 0.0)
        step[:, words == 0] = 0.0  # tags that were never seen
        step[:, 0] += 0.1
        with np.errstate(divide="ignore"):
            self.step = np.log(step / np.maximum(step.sum(axis=1, keepdims=True), 1e-9))

    def scores(self, slots: np.ndarray) -> np.ndarray:
        """``(..., kinds)`` slots -> ``(..., tags)``: the features share one voice, so that they do not count their agreement twice."""
        return self.emit[slots].mean(axis=-2) * 2.0

    def decode(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(runs, words, tags)`` scores of runs of one length -> best tags, forward and backward sums, and the sum of all paths."""
        n, length, _ = emit.shape
        best, back = np.empty_like(emit), np.zeros(emit.shape, np.int64)
        ahead, behind = np.empty_like(emit), np.empty_like(emit)
        best[:, 0] = ahead[:, 0] = self.step[0] + emit[:, 0]
        for i in range(1, length):
            via = best[:, i - 1, :, None] + self.step
            back[:, i] = via.argmax(axis=1)
            best[:, i] = via.max(axis=1) + emit[:, i]
            ahead[:, i] = _log_sum(ahead[:, i - 1, :, None] + self.step, 1) + emit[:, i]
        behind[:, -1] = self.step[:, 0]
        for i in range(length - 2, -1, -1):
            behind[:, i] = _log_sum(self.step + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        path = np.empty((n, length), np.int64)
        path[:, -1] = (best[:, -1] + self.step[:, 0]).argmax(axis=1)
        for i in range(length - 1, 0, -1):
            path[:, i - 1] = back[np.arange(n), i, path[:, i]]
        return path, ahead, behind, _log_sum(ahead[:, -1] + self.step[:, 0], 1)

    def span_score(self, emit: np.ndarray, ahead: np.ndarray, behind: np.ndarray, total: float, first: int, last: int, begin: int) -> float:
        """Posterior probability that exactly the words ``first`` to ``last`` of one run form an entity of tag ``begin``."""
        inside, value = begin + 1, ahead[first, begin]
        for i in range(first + 1, last + 1):
            value += self.step[begin if i == first + 1 else inside, inside] + emit[i, inside]
        tag = begin if last == first else inside
        if last + 1 == len(emit):
            after = self.step[tag, 0]
        else:
            following = self.step[tag] + emit[last + 1] + behind[last + 1]
            after = _log_sum(np.delete(following, inside), 0)
        return float(np.exp(min(0.0, value + after - total)))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """``(start, end, category, score)`` of each text's entities, decoded together by length of run.

        At most ``HELD_WORDS`` words (or one run) wait to be decoded, however many the texts have.
        """
        out: list[list] = [[] for _ in texts]
        by_length: dict[int, list[tuple[int, Run]]] = {}
        waiting = 0
        for n, text in enumerate(texts):
            for run in runs(text or ""):
                by_length.setdefault(len(run.spans), []).append((n, run))
                waiting += len(run.spans)
                if waiting >= HELD_WORDS:
                    self._decode_into(out, by_length)
                    by_length, waiting = {}, 0
        self._decode_into(out, by_length)
        return [sorted(x) for x in out]

    def _decode_into(self, out: list[list], by_length: dict[int, list[tuple[int, Run]]]) -> None:
        for held in by_length.values():
            for at in range(0, len(held), 4096):
                part = held[at:at + 4096]
                emit = self.scores(np.array([r.slots for _, r in part]))
                path, ahead, behind, total = self.decode(emit)
                for k in np.flatnonzero(path.any(axis=1)):
                    n, run = part[k]
                    for first, last, begin in _spans(path[k].tolist()):
                        score = self.span_score(emit[k], ahead[k], behind[k], total[k], first, last, begin)
                        out[n].append((run.spans[first][0], run.spans[last][1], CATEGORIES[begin // 2], score))

    # -- as a table ----------------------------------------------------------
    def table(self, spark: SparkSession) -> DataFrame:
        """``(slot, tag, n)``; transitions stand behind the slots."""
        slot, tag = np.nonzero(self.counts)
        rows = [pd.DataFrame({"slot": slot, "tag": tag, "n": self.counts[slot, tag].astype(np.int64)})]
        a, b = np.nonzero(self.moves)
        rows.append(pd.DataFrame({"slot": SLOTS + a, "tag": b, "n": self.moves[a, b].astype(np.int64)}))
        return spark.createDataFrame(pd.concat(rows), "slot long, tag long, n long")

    @classmethod
    def from_table(cls, table: DataFrame) -> "Tagger":
        """The model of a table ``(slot, tag, n)`` of at most ``(SLOTS + TAGS) * TAGS`` rows."""
        counts, moves = np.zeros((SLOTS, TAGS)), np.zeros((TAGS, TAGS))
        rows = table.toPandas()
        slot, tag, n = (rows[c].to_numpy() for c in ("slot", "tag", "n"))
        word = slot < SLOTS
        counts[slot[word], tag[word]] = n[word]
        moves[slot[~word] - SLOTS, tag[~word]] = n[~word]
        return cls(counts, moves)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def _spans(tags: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(first, last, begin tag)`` of the entities of a run."""
    i = 0
    while i < len(tags):
        if tags[i]:
            begin, j = tags[i], i + 1
            while j < len(tags) and tags[j] == begin + 1:
                j += 1
            yield i, j - 1, begin
            i = j
        else:
            i += 1


def _counted(rows) -> pd.DataFrame:
    """``(slot, tag, n)`` of ``(text, labels)`` rows, added up in one array of fixed size."""
    size = (SLOTS + TAGS) * TAGS
    total, seen = np.zeros(size, np.int64), []
    for t, found in rows:
        spans = [(x["start"], x["end"], x["category"]) for x in found] if found is not None else []
        for run in runs(t or ""):
            tags = tags_of(run, spans)
            for slots, tag in zip(run.slots, tags):
                seen.extend([s * TAGS + tag for s in slots])
            seen.extend([(SLOTS + a) * TAGS + b for a, b in zip([0, *tags], [*tags, 0])])
            if len(seen) >= HELD_WORDS * len(KINDS):
                total += np.bincount(seen, minlength=size)
                seen = []
    total += np.bincount(np.array(seen, np.int64), minlength=size)
    at = np.flatnonzero(total)
    return pd.DataFrame({"slot": at // TAGS, "tag": at % TAGS, "n": total[at]})


def count_features(df: DataFrame, text: str, labels: str) -> DataFrame:
    """``(slot, tag, n)`` over labelled texts; each task sends at most ``(SLOTS + TAGS) * TAGS`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _counted(((t, found) for batch in batches for t, found in zip(batch["t"], batch["labels"])))

    spans = F.transform(labels, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["category"].alias("category")))
    counted = df.select(F.col(text).alias("t"), spans.alias("labels")).mapInPandas(count, "slot long, tag long, n long")
    return counted.groupBy("slot", "tag").agg(F.sum("n").alias("n"))


def train_tagger(df: DataFrame, text: str = "text", labels: str = "findings") -> Tagger:
    """Learn from texts with labelled spans (``labels``: findings of persons, locations and organisations)."""
    return Tagger.from_table(count_features(df, text, labels))


def with_tagged_entities(df: DataFrame, text: str, model: Tagger, out: str) -> DataFrame:
    """``out`` = the text's entities with their scores, ascending."""
    sent = df.sparkSession.sparkContext.broadcast((model.counts.astype(np.float32), model.moves))  # (SLOTS + TAGS) * TAGS numbers
    loaded: list = []

    @F.pandas_udf(SCORED_DDL)
    def tag(texts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(Tagger(*sent.value))
        found = loaded[0].find(list(texts))
        return pd.Series([[{"start": a, "end": b, "category": c, "value": t[a:b], "score": s} for a, b, c, s in spans]
                          for t, spans in zip(texts, found)], dtype=object)

    return df.withColumn(out, tag(F.col(text)))
