"""Quality classifier by co-training of a text view and a metadata view.

The text view sees a hashed profile of byte trigrams and a few shape statistics
of the whole text; the metadata view sees source, language and length. Each
view has a logistic classifier fitted on a bounded, hash-chosen sample of
labelled documents. Over several rounds each classifier scores all unlabelled
documents on Spark; of those it is surest of, in the proportion of the classes,
a bounded hash sample joins the other view's training rows. Both are calibrated on held-out
labelled rows, a small logistic model combines the two calibrated views, and
every document is scored.

Null text counts as empty; null source, language or length are values of their
own. Documents without a label, or with labels that tie, are unlabelled. If
labels of both classes are lacking, every score is the share of good labels
(0.5 without any). Repeated rows repeat; an empty table gives no rows. Other
columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, need

PROFILE = 1024
CHUNK = 1 << 22
META_BUCKETS = 256
_KINDS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 mark, 7 beyond ASCII
_KINDS[ord("a"):ord("z") + 1], _KINDS[ord("A"):ord("Z") + 1], _KINDS[ord("0"):ord("9") + 1] = 1, 2, 3
_KINDS[[9, 32]], _KINDS[[10, 13]], _KINDS[128:] = 4, 5, 7
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
SHAPE = 16


def text_features(text: bytes | None) -> np.ndarray:
    """Whole-text profile: trigram shares (square roots) and shares of character kinds and kind changes."""
    text = text or b""
    grams, kinds, pairs = np.zeros(PROFILE), np.zeros(8), np.zeros(64)
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, len(text), CHUNK):
        b = np.frombuffer(text, np.uint8, min(CHUNK + 2, len(text) - at), at).astype(np.uint32)
        if len(b) >= 3:
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            grams += np.bincount((h >> np.uint32(11)) & np.uint32(PROFILE - 1), minlength=PROFILE)
        # One kind beyond the chunk, for the change of kind at its end.
        k = _KINDS[b[:CHUNK + 1]].astype(np.int64)
        kinds += np.bincount(k[:CHUNK], minlength=8)
        pairs += np.bincount(k[:-1] * 8 + k[1:], minlength=64) if len(k) > 1 else 0
        packed += len(packer.compress(text[at:at + CHUNK]))
    packed += len(packer.flush())
    n = max(len(text), 1)
    letters, words = kinds[1] + kinds[2] + kinds[7], kinds[4] + kinds[5] + 1
    shape = np.concatenate([kinds / n, [
        kinds[2] / max(letters, 1), letters / n, min(letters / words, 20) / 20, kinds[5] / words, pairs[6 * 8 + 6] / n,
        pairs[2 * 8 + 2] / n, np.log1p(n) / 15, packed / n if n > 64 else 1.0]])
    return np.concatenate([np.sqrt(grams / n), shape]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed source, language and length class, and the logarithm of the length."""
    out = np.zeros(META_BUCKETS + 2, np.float32)
    size = None if n_chars is None or n_chars != n_chars else max(float(n_chars), 0.0)
    for value in (f"s:{source}", f"l:{lang}", f"n:{None if size is None else int(np.log2(size + 1))}"):
        out[zlib.crc32(value.encode()) % META_BUCKETS] += 1.0
    out[-2], out[-1] = (0.0 if size is None else np.log1p(size) / 15), 1.0 if size is None else 0.0
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights (the last is the constant) by accelerated gradient steps on centred, scaled columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.concatenate([(x - mean) / sd / np.sqrt(x.shape[1]), np.ones((len(x), 1))], axis=1)
    w = v = np.zeros(z.shape[1])
    rate = 4.0 / max(1.0, float((z * z).sum(axis=1).mean()))
    total = weight.sum()
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        grad = z.T @ (weight * (p - y)) / total + ridge * np.append(v[:-1], 0.0)
        new = v - rate * grad
        v, w = new + (t / (t + 3)) * (new - w), new
    scale = w[:-1] / sd / np.sqrt(x.shape[1])
    return np.append(scale, w[-1] - (scale * mean).sum())


def _margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make margins log odds on held-out rows (Newton with a light pull to 1 and 0)."""
    a, b = 1.0, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, v = p - y, p * (1 - p) + 1e-6
        hess = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, [(r * m).sum() + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
    return float(max(a, 1e-3)), float(b)


@dataclass(frozen=True)
class QualityModel:
    """Per view: weights, scale and shift; and how the two calibrated log odds combine."""

    text: tuple | None
    meta: tuple | None
    blend: tuple[float, float, float]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, metadata, combined) probabilities of good quality."""
        sig = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        if self.text is None:
            flat = np.full(len(text), self.blend[2])
            return flat, flat, flat
        t = self.text[1] * _margin(self.text[0], text) + self.text[2]
        m = self.meta[1] * _margin(self.meta[0], meta) + self.meta[2]
        return sig(t), sig(m), sig(self.blend[0] * t + self.blend[1] * m + self.blend[2])


def co_train(views: list[np.ndarray], y: np.ndarray, pick: Callable, rounds: int) -> QualityModel:
    """``views``: the two feature tables of the labelled rows.

    ``pick(sides, good, turn)`` gives, for each view, the two feature tables and
    the pseudo-labels of the unlabelled rows it is surest of.
    """
    if not 0 < y.sum() < len(y):
        return QualityModel(None, None, (0.0, 0.0, float(y.mean()) if len(y) else 0.5))
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fit_x, fit_y, held_rows = [v[~held] for v in views], y[~held], held if held.any() else ~held
    extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # feature rows and pseudo-labels given to each view
    for turn in range(rounds + 1):
        weights = []
        for v in (0, 1):
            x = np.concatenate([fit_x[v], *(x for x, _ in extra[v])])
            label = np.concatenate([fit_y, *(p for _, p in extra[v])])
            weights.append(logistic(x, label, np.where(np.arange(len(label)) < len(fit_y), 1.0, 0.5)))
        if turn == rounds:
            break
        sides = [(w, *_platt(_margin(w, v[held_rows]), y[held_rows])) for w, v in zip(weights, views)]
        for v, (tables, label) in enumerate(pick(sides, float(fit_y.mean()), turn)):
            extra[1 - v].append((tables[1 - v], label))
    sides = [(w, *_platt(_margin(w, v[held_rows]), y[held_rows])) for w, v in zip(weights, views)]
    odds = np.stack([a * _margin(w, v[held_rows]) + b for (w, a, b), v in zip(sides, views)], axis=1)
    blend = logistic(odds, y[held_rows], np.ones(held_rows.sum()), ridge=1e-2)
    return QualityModel(sides[0], sides[1], (float(blend[0]), float(blend[1]), float(blend[2])))


def with_features(docs: DataFrame, text_col: str, source_col: str, lang_col: str, size_col: str, *keep: str) -> DataFrame:
    """``keep`` columns and the two feature rows as binary."""

    @F.pandas_udf("text binary, meta binary")
    def features(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": [text_features(t).tobytes() for t in text],
                             "meta": [meta_features(*x).tobytes() for x in zip(source, lang, size)]})

    cols = [F.col(text_col).cast("binary"), F.col(source_col).cast("string"), F.col(lang_col).cast("string"), F.col(size_col).cast("double")]
    return docs.select(*keep, features(*cols).alias("f")).select(*keep, "f.text", "f.meta")


def _stack(rows: list, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r[name]) for r in rows), np.float32).reshape(-1, width) if rows else np.zeros((0, width), np.float32)


def _picker(docs: DataFrame, votes: DataFrame, cols: tuple[str, ...], unlabelled: int, share: float, seed: int) -> Callable:
    """``pick`` of :func:`co_train` over all unlabelled rows of ``docs(k, <cols>)``.

    Every row is scored in every round. Of those among the surest ``share`` of
    all for each round so far, in the proportion of the classes, a view passes
    on at most ``unlabelled * share`` new ones in a round, by the order of a hash.
    """
    rows = docs.withColumn("row", F.xxhash64("k", *cols, F.lit(seed)))
    voted = materialize(votes.select("k"), "quality-voted")
    total = docs.select("k").join(voted, "k", "left_anti").count()
    taken: set[int] = set()
    widths = (PROFILE + SHAPE, META_BUCKETS + 2)

    def pick(sides: list[tuple], good: float, turn: int) -> list[tuple]:
        @F.pandas_udf("text double, meta double")
        def odds(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
            (wt, at, bt), (wm, am, bm) = sides
            return pd.DataFrame({"text": [at * float(_margin(wt, text_features(t))) + bt for t in text],
                                 "meta": [am * float(_margin(wm, meta_features(*x))) + bm for x in zip(source, lang, size)]},
                                dtype=float)

        args = [F.col(c).cast(t) for c, t in zip(cols, ("binary", "string", "string", "double"))]
        rated = materialize(rows.select("k", "row", odds(*args).alias("m")).select("k", "row", "m.text", "m.meta"), "quality-odds")
        free = rated.join(voted, "k", "left_anti")
        chosen: list[dict[int, float]] = []
        n = max(1, int(share * total))
        for view in ("text", "meta"):
            mine: dict[int, float] = {}
            for label, part, sure in ((0.0, 1 - good, -F.col(view)), (1.0, good, F.col(view))):
                # The place of the surest rows, to a hundredth of the log odds; p > 0.9 at least.
                ranked = free.select("row", F.floor(F.least(sure, F.lit(30.0)) * 100).alias("at")).where(sure > float(np.log(9)))
                want, cut = max(1, round((turn + 1) * n * part)), None
                for r in sorted(ranked.groupBy("at").count().collect(), reverse=True):
                    if want <= 0:
                        break
                    want, cut = want - r["count"], r["at"]
                if cut is None:
                    continue
                most = max(1, round(min(n, max(1, int(share * unlabelled))) * part))
                old = list(taken)
                fresh = ranked.where(F.col("at") >= cut).where(~F.col("row").isin(old)) if old else ranked.where(F.col("at") >= cut)
                got = [r["row"] for r in fresh.select("row").distinct().orderBy(F.xxhash64("row"), "row").limit(most).collect()]
                mine |= dict.fromkeys(got, label)
                taken.update(got)
            chosen.append(mine)
        discard(rated)
        every = [r for mine in chosen for r in mine]
        if not every:
            return []
        found = with_features(rows.where(F.col("row").isin(every)).dropDuplicates(["row"]), *cols, "row").collect()
        found = sorted(found, key=lambda r: r["row"])
        out = []
        for mine in chosen:
            part = [r for r in found if r["row"] in mine]
            tables = [_stack(part, name, w) for name, w in zip(("text", "meta"), widths)]
            out.append((tables, np.array([mine[r["row"]] for r in part])))
        return out

    return pick


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", labelled: int = 4000,
          unlabelled: int = 4000, rounds: int = 4, share: float = 0.05, seed: int = 9) -> QualityModel:
    """Co-train on about ``labelled`` labelled documents, chosen by a seeded hash of the id, and on all others (see :func:`_picker`)."""
    need(docs, (id_col, text_col, source_col, lang_col, size_col))
    need(labels, (id_col, label_col))
    votes = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(
        F.avg(F.col(label_col).cast("double")).alias("y")).where("y <> 0.5")
    n_votes = votes.count()
    rank = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1_000_000))
    cut = -(-labelled * 1_000_000 // max(n_votes, 1))
    cols = (text_col, source_col, lang_col, size_col)
    narrow = docs.select(F.col(id_col).alias("k"), *[F.col(c).alias(f"__{n}") for n, c in enumerate(cols)])
    cols = tuple(f"__{n}" for n in range(4))
    known = narrow.where(rank("k") < cut).join(votes.where(rank("k") < cut), "k")
    good = with_features(known, *cols, "k", "y").collect()
    good.sort(key=lambda r: zlib.crc32(str(r["k"]).encode()))
    widths = (PROFILE + SHAPE, META_BUCKETS + 2)
    views = [_stack(good, n, w) for n, w in zip(("text", "meta"), widths)]
    y = np.array([float(r["y"] > 0.5) for r in good])
    return co_train(views, y, _picker(narrow, votes, cols, unlabelled, share, seed), rounds)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          size_col: str = "n_chars") -> DataFrame:
    """Add ``text_score``, ``meta_score`` and ``score``: probabilities of good quality."""
    need(docs, (text_col, source_col, lang_col, size_col))

    @F.pandas_udf("text_score double, meta_score double, score double")
    def rate(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"text_score": [], "meta_score": [], "score": []}, dtype=float)
        out = []
        for at in range(0, len(text), 512):
            x = np.stack([text_features(t) for t in text[at:at + 512]])
            m = np.stack([meta_features(*r) for r in zip(source[at:at + 512], lang[at:at + 512], size[at:at + 512])])
            out.append(np.stack(model.score(x, m), axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["text_score", "meta_score", "score"])

    s = rate(F.col(text_col).cast("binary"), F.col(source_col).cast("string"), F.col(lang_col).cast("string"),
             F.col(size_col).cast("double"))
    out = docs.withColumn("__s", s)
    return out.withColumns({c: F.col("__s")[c] for c in ("text_score", "meta_score", "score")}).drop("__s")
