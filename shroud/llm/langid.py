"""Language identification: per-word scores, script ranges and a Viterbi pass.

Training counts hashed character n-grams (1 to 3, with word ends, plus the
whole word) of a bounded, hash-chosen sample of labelled documents per
language. A word's score per language is the log likelihood of its n-grams;
the script of the word first narrows the candidates to languages seen in that
script. A Viterbi pass over the words with a fixed penalty for each change of
language labels spans; the document gets the language with most letters.

Every text is decoded as one sequence, whatever its length. Short ones go step
by step together; a long one goes word by word in pieces of ``BATCH_WORDS``
words with the state carried from piece to piece, and keeps a few bytes for
each word until its best path is read back. Both give the same path.

Null text and text without letters give ``und`` with score 0 and no spans; so
does every text if nothing was learned. Rows with null text or null language
are not learned from. Ties go to the language that sorts first. Repeated rows
repeat; other columns pass through unread (a column named like an output is
replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, islice
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

UND = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TOGETHER_WORDS = 2048
BATCH_WORDS = 100_000
#: Nats that a change of language costs, and that a word out of script costs a language.
SWITCH, OUT_OF_SCRIPT = 8.0, 60.0
#: One word's evidence is cut at this many nats, so that one odd word can't outweigh its neighbours.
WORD_LIMIT = 12.0
_WORD = re.compile(r"[^\W\d_]+")

#: First code points of script ranges and their scripts (0 = other).
SCRIPT_STARTS = np.array([
    0x0000, 0x0041, 0x005B, 0x0061, 0x007B, 0x00C0, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900,
    0x0980, 0x0A00, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0,
    0x3100, 0x3400, 0xA000, 0xAC00, 0xD7A4, 0xF900, 0xFB00, 0x20000])
SCRIPT_IDS = np.array([
    0, 1, 0, 1, 0, 1, 0, 2, 3, 4, 5, 6, 0, 7,
    8, 9, 10, 11, 12, 13, 14, 15, 16, 1, 2, 0, 17, 18,
    0, 19, 0, 15, 0, 19, 0, 19])
N_SCRIPTS = 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _word_arrays(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all ``<word>`` strings in a row, each one's first index, and its length."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    joined = "\x02" + "\x03\x02".join(words) + "\x03"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return points, np.cumsum(size) - size, size


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, word index)`` of every n-gram of every word, the whole word included."""
    points, first, size = _word_arrays(words)
    owner = np.repeat(np.arange(len(words)), size)
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            break
        h = (h[:m] * _MIX[0]) ^ (points[n - 1:n - 1 + m] * _MIX[1] + np.uint64(n))
        inside = owner[:m] == owner[n - 1:n - 1 + m]
        buckets.append(h[inside])
        owners.append(owner[:m][inside])
    with np.errstate(over="ignore"):
        place = (np.arange(len(points)) - first[owner]).astype(np.uint64)
        mixed = (points + np.uint64(1)) * (_MIX[2] ^ (place * _MIX[0]))
        mixed ^= mixed >> np.uint64(29)
    buckets.append(np.add.reduceat(mixed, first))
    owners.append(np.arange(len(words)))
    h = np.concatenate(buckets)
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    return (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), np.concatenate(owners)


def scripts(words: list[str]) -> np.ndarray:
    """Script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, first, "right") - 1]


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` in code-point order; log probabilities per bucket; languages allowed per script."""

    langs: tuple[str, ...]
    logp: np.ndarray  # (BUCKETS, languages), float32
    allowed: np.ndarray  # (scripts, languages), bool

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): evidence in nats, the best language of each word at 0."""
        buckets, owner = ngram_buckets(words)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        score = np.add.reduceat(self.logp[buckets[order]], starts, axis=0).astype(np.float64)
        ok = self.allowed[scripts(words)]
        ok |= ~ok.any(axis=1, keepdims=True)
        score = np.where(ok, score, score.min(axis=1, keepdims=True) - OUT_OF_SCRIPT)
        floor = np.where(ok, -WORD_LIMIT, -OUT_OF_SCRIPT)
        return np.maximum(score - score.max(axis=1, keepdims=True), floor)

    def decode(self, docs: list[list[str]]) -> list[np.ndarray]:
        """A language index for each word of each document."""
        flat = list(chain.from_iterable(docs))
        if not flat:
            return [np.zeros(0, np.int64) for _ in docs]
        codes, unique = pd.factorize(np.array(flat, dtype=object))
        scores = self.word_scores(list(unique))[codes]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        stops = np.cumsum(sizes)
        some = sizes > 0
        path = viterbi(scores, (stops - sizes)[some], stops[some], SWITCH)
        return np.split(path, stops[:-1])

    def long_letters(self, pieces: Iterator[list[str]]) -> np.ndarray:
        """Letters by language of one text that comes in pieces."""
        state, held = [0.0] * len(self.langs), []
        for words in pieces:
            codes, unique = pd.factorize(np.array(words, dtype=object))
            stay, jump, state = forward(self.word_scores(list(unique))[codes], state, SWITCH)
            held.append((stay, jump, np.fromiter(map(len, words), np.int64, len(words))))
        now, letters = state.index(max(state)) if held else 0, np.zeros(len(self.langs))
        for stay, jump, sizes in reversed(held):
            path, now = backward(stay, jump, now)
            letters += np.bincount(path, sizes, len(self.langs))
        return letters


def forward(scores: np.ndarray, state: list[float], penalty: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """One text's next words: which labels go on at each word, the label that a switch comes from, and the state behind."""
    stay, jump = [], []
    for row in scores.tolist():
        top = max(state)
        switch = top - penalty
        jump.append(state.index(top))
        stay.append([b >= switch for b in state])
        state = [(b if b >= switch else switch) + s for b, s in zip(state, row)]
    return np.array(stay, bool), np.array(jump, np.uint8), state


def backward(stay: np.ndarray, jump: np.ndarray, now: int) -> tuple[np.ndarray, int]:
    """The best path through a piece that ends with label ``now``, and the label before the piece."""
    path = []
    for kept, before in zip(reversed(stay.tolist()), reversed(jump.tolist())):
        path.append(now)
        if not kept[now]:
            now = before
    return np.array(path[::-1], np.int64), now


def viterbi(scores: np.ndarray, starts: np.ndarray, stops: np.ndarray, penalty: float) -> np.ndarray:
    """Best label sequence of every text ``scores[start:stop]``, all texts step by step together."""
    order = np.argsort(starts - stops, kind="stable")  # longest first: the active ones are a prefix
    first, size = starts[order], (stops - starts)[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), "left")
    best = np.zeros((len(first), scores.shape[1]))
    keep, jump = [], []
    for t in range(longest):
        a = active[t]
        top = best[:a].argmax(axis=1)
        switch = best[np.arange(a), top][:, None] - penalty
        stay = best[:a] >= switch
        best[:a] = np.where(stay, best[:a], switch) + scores[first[:a] + t]
        keep.append(stay)
        jump.append(top)
    path = np.zeros(len(scores), np.int64)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        path[first[:a] + t] = now[:a]
        stay = keep[t][np.arange(a), now[:a]]
        now[:a] = np.where(stay, now[:a], jump[t])
    return path


# ------------------------------------------------------------------ training

def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id",
          docs_per_lang: int = 1500, seed: int = 7) -> LanguageModel:
    """Fit on about ``docs_per_lang`` whole documents of each language, chosen by a seeded hash of the key.

    The sample is the model's documented bound: counts per (language, n-gram
    bucket) reach the driver, at most ``BUCKETS`` rows for each language.
    """
    need(docs, (lang_col, text_col, key_col))
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("k"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    rank = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1_000_000))
    share = F.create_map(*chain.from_iterable(
        (F.lit(x), F.lit(-(-docs_per_lang * 1_000_000 // sizes[x]))) for x in langs))[F.col("lang")]
    sample = rows.where(rank < share).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                c = total.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                found = _WORD.finditer(text.lower())
                while words := [m[0] for m in islice(found, BATCH_WORDS)]:
                    codes, unique = pd.factorize(np.array(words, dtype=object))
                    times = np.bincount(codes)
                    buckets, owner = ngram_buckets(list(unique))
                    c[:BUCKETS] += np.bincount(buckets, times[owner], BUCKETS).astype(np.int64)
                    c[BUCKETS:] += np.bincount(scripts(list(unique)), times, N_SCRIPTS).astype(np.int64)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    counts = (sample.mapInPandas(count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    table[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(langs)})] = counts["n"]
    grams, by_script = table[:BUCKETS] + 0.5, table[BUCKETS:]
    logp = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    allowed = by_script >= 0.01 * np.maximum(by_script.sum(axis=0), 1)
    return LanguageModel(langs, logp, allowed & (by_script > 0))


# ---------------------------------------------------------------- prediction

def _letter_words(text: str, limit: int) -> Iterator[list[str]]:
    """The words of a text in lists of up to ``limit``."""
    found = (m[0] for m in _WORD.finditer(text.lower()))
    words = (w for w in found if w.isalpha() or any(c.isalpha() for c in w))
    while part := list(islice(words, limit)):
        yield part


def _letters(model: LanguageModel, texts) -> np.ndarray:
    """Letters by language of every text."""
    n = len(model.langs)
    out = np.zeros((len(texts), max(1, n)))

    def together(held: list[tuple[int, list[str]]]) -> None:
        for (row, words), path in zip(held, model.decode([w for _, w in held])):
            out[row] += np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), n)

    held, size = [], 0
    for row, text in enumerate(texts):
        pieces = _letter_words(text or "", BATCH_WORDS)
        first = next(pieces, [])
        if len(first) > TOGETHER_WORDS:
            out[row] = model.long_letters(chain([first], pieces))
        elif first:
            held.append((row, first))
            size += len(first)
            if size >= BATCH_WORDS:
                together(held)
                held, size = [], 0
    if held:
        together(held)
    return out


def detect(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred",
           score_out: str = "score") -> DataFrame:
    """Add the predicted language and the share of letters in its spans (0 to 1)."""
    need(docs, (text_col,))

    @F.pandas_udf("lang string, score double")
    def predict(col: pd.Series) -> pd.DataFrame:
        n = len(model.langs)
        letters = _letters(model, col) if n else np.zeros((len(col), 1))
        total, top = letters.sum(axis=1), letters.argmax(axis=1)
        names = np.array(model.langs or (UND,), dtype=object)
        share = letters[np.arange(len(col)), top] / np.maximum(total, 1)
        return pd.DataFrame({"lang": np.where(total > 0, names[top], UND), "score": np.where(total > 0, share, 0.0)})

    # Not to be evaluated again by a filter on its result that is pushed below it.
    out = docs.withColumn("__langid", predict.asNondeterministic()(F.col(text_col)))
    return out.withColumns({lang_out: F.col("__langid.lang"), score_out: F.col("__langid.score")}).drop("__langid")


def spans(model: LanguageModel, text: str | None) -> list[tuple[int, int, str]]:
    """Language spans ``(start, end, lang)`` of one text, in code points, from first to last letter of each."""
    found = list(_WORD.finditer(text or ""))
    if not found or not model.langs:
        return []
    out: list[list] = []
    for m, label in zip(found, model.decode([[m[0].lower() for m in found]])[0]):
        lang = model.langs[label]
        if out and out[-1][2] == lang:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end(), lang])
    return [tuple(x) for x in out]


def detect_spans(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "lang_spans") -> DataFrame:
    """Add ``array<struct<start,end,lang>>``: the labelled spans of mixed-language text."""
    need(docs, (text_col,))

    @F.pandas_udf("array<struct<start int, end int, lang string>>")
    def label(col: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "lang"), s)) for s in spans(model, t)] for t in col])

    return docs.withColumn(out, label(F.col(text_col)))
