"""URL filters: allow and block rules, then host word segmentation and naive Bayes.

Hosts and paths are cut into runs of letters and of digits. Each distinct run
of letters is segmented into words by Viterbi over a unigram model: word
counts of the corpus's own hyphenated host names and paths, and a fixed list of
common words. Candidate words are found by an equi-join of a run's substrings
with the counts, so the vocabulary is never broadcast. Hosts that hold a strong
word are the positive examples of a multinomial naive Bayes over segmented host
words and path words; the word scores are joined back and summed per distinct
host and per distinct path. A url without a fitting rule is blocked if the sum
and the prior are above 0.

A null url, or one without ``://``, has an empty host and path and is judged by
the prior alone. Repeated rows repeat; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions.sql import let, q

from .common import materialize, need

#: (host and path prefix, verdict); a rule fits its host, all subdomains, and paths that start with its path.
Rules = Sequence[tuple[str, str]]
RULES: Rules = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
                ("com/de/", "block"))
LONGEST_WORD = 20
#: Words that mark a host on their own, words that often go with them, and plain words of host names.
STRONG = ("adult", "ads", "bet", "bets", "betting", "casino", "cialis", "dating", "escort", "gambling", "hentai", "jackpot",
          "loans", "lottery", "malware", "payday", "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam",
          "torrent", "viagra", "warez", "xxx")
ALONGSIDE = ("bonus", "cheap", "click", "crack", "deals", "easy", "fast", "free", "hot", "money", "offers", "online", "popup",
             "prize", "track", "tracker", "win", "winner")
PLAIN = ("about", "academy", "art", "article", "blog", "book", "books", "city", "club", "college", "com", "community", "daily",
         "data", "docs", "edu", "example", "farm", "film", "food", "forum", "garden", "gov", "green", "guide", "health", "help",
         "history", "home", "house", "info", "journal", "lab", "law", "library", "life", "local", "magazine", "mail", "map",
         "market", "media", "museum", "music", "net", "news", "office", "org", "page", "park", "paper", "photo", "press", "radio",
         "research", "review", "school", "science", "shop", "site", "sport", "store", "study", "team", "tech", "theatre", "time",
         "times", "today", "travel", "university", "video", "water", "weather", "web", "wiki", "work", "world", "www")
_FIXED_COUNT = 20


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest fitting rule (null if none); meant for short lists, as each is one condition of the plan."""
    out = None
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(text)) if out is None else out.when(fits, F.lit(text))
    return out if out is not None else F.lit(None).cast("string")


def runs_of(text: Column) -> Column:
    """Runs of letters, and ``#`` for each run of digits (lower case)."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+|[0-9]+"), F.lit(0)),
                       lambda r: F.when(r.rlike("^[0-9]"), F.lit("#")).otherwise(r))


def corpus_words(parts: DataFrame) -> DataFrame:
    """``(side, text)`` -> ``(word, n)``: counts of runs that stand in a name of several runs, and the fixed words.

    A host label that is a single run says nothing about how to split it.
    """
    label = F.explode(F.split("text", "[./]"))
    words = parts.select(label.alias("label")).select(runs_of(F.col("label")).alias("r")).where(F.size("r") > 1)
    words = words.select(F.explode("r").alias("word")).where("word <> '#'").where(F.length("word") <= LONGEST_WORD)
    fixed = F.array(*[F.lit(w) for w in (*STRONG, *ALONGSIDE, *PLAIN)])
    seed = parts.sparkSession.range(1).select(F.explode(fixed).alias("word"), F.lit(_FIXED_COUNT).cast("long").alias("n"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(seed).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(run: str, words: dict[int, list[tuple[int, float]]], total: float) -> list[str]:
    """Viterbi: the most likely split of ``run``; ``words`` gives (length, log probability) by start.

    A stretch that is no known word costs as one that gets ten times rarer with each letter.
    """
    n = len(run)
    unknown = math.log(10 / total)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            score = best[start] + unknown - (end - start) * math.log(10)
            if score > best[end]:
                best[end], back[end] = score, start
        for start, logp in words.get(end, ()):
            if best[start] + logp > best[end]:
                best[end], back[end] = best[start] + logp, start
    out, end = [], n
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def segment(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct ``(run)`` and ``(word, n)`` -> ``(run, words)``."""
    total = float(words.agg(F.sum("n").alias("n")).first()["n"] or 1)
    # Runs have numbers, frozen by writing the table; only these travel with the substrings, which are cut from short windows.
    runs = materialize(runs.withColumn("nr", F.monotonically_increasing_id()), "url-runs")
    windows = let({"c": "split(run, '')", "n": "length(run)"}, f"transform(sequence(1, v.n), i -> array_join(slice(v.c, i, {LONGEST_WORD}), ''))", "v")
    pieces = runs.select("nr", F.posexplode(F.expr(windows)).alias("at", "window"))
    pieces = pieces.select("nr", (F.col("at") + 1).alias("at"), "window", F.explode(F.sequence(F.lit(1), F.length("window"))).alias("len"))
    pieces = pieces.select("nr", "at", "len", F.expr("left(window, len)").alias("word"))
    known = pieces.join(words, "word").groupBy("nr").agg(F.collect_list(F.struct("at", "len", "n")).alias("k"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for r, found in zip(run, k):
            by_end: dict[int, list[tuple[int, float]]] = {}
            for x in (found if found is not None else ()):
                by_end.setdefault(x["at"] - 1 + x["len"], []).append((x["at"] - 1, math.log(x["n"] / total)))
            out.append(best_split(r, by_end, total))
        return pd.Series(out)

    return runs.join(known, "nr", "left").select("run", split("run", "k").alias("words"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Rules = RULES, clip: float = 4.0, alpha: float = 0.1) -> DataFrame:
    """``(id, host, path, rule, verdict, score, words)``; ``score`` is the log odds of block, ``words`` the host's."""
    need(pages, (id_col, url_col))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    sites = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "url-sites")
    hosts = sites.select(F.lit("h").alias("side"), F.col("host").alias("text")).distinct()
    paths = sites.select(F.lit("p").alias("side"), F.col("path").alias("text")).distinct()
    # Words carry the number of their host or path, not its text, however long that is.
    parts = materialize(hosts.unionByName(paths).withColumn("part", F.monotonically_increasing_id()), "url-parts")

    runs = parts.select("side", "part", F.explode(runs_of(F.col("text"))).alias("run"))
    split = segment(runs.where("run <> '#'").select("run").distinct(), corpus_words(parts))
    words = runs.join(split, "run", "left").select("side", "part", F.explode(
        F.coalesce("words", F.array("run"))).alias("word"))
    words = materialize(words, "url-words")

    strong = words.where((F.col("side") == "h") & F.col("word").isin(*STRONG)).select("part").distinct()
    bad = parts.where("side = 'h'").join(strong, "part", "left_semi").select(F.col("text").alias("host"))
    label = sites.select("host", "path").join(bad.withColumn("bad", F.lit(1)), "host", "left").withColumn(
        "bad", F.coalesce("bad", F.lit(0)))
    host_label = label.select("host", "bad").distinct()
    prior_row = host_label.agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    n_bad, n_all = (prior_row["bad"] or 0), prior_row["n"]
    prior = math.log((n_bad + 1) / (n_all - n_bad + 2))

    host_part = parts.where("side = 'h'").join(host_label, F.col("text") == F.col("host")).select("part", "bad")
    path_label = label.groupBy("path").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g"))
    path_part = parts.where("side = 'p'").join(path_label, F.col("text") == F.col("path")).select("part", "b", "g")
    host_words = words.where("side = 'h'").join(host_part, "part").select("side", "word", "bad")
    path_words = words.where("side = 'p'").join(path_part, "part")
    host_count = host_words.groupBy("side", "word").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g"))
    path_count = path_words.groupBy("side", "word").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    counts = host_count.unionByName(path_count).select("side", "word", "b", "g", F.lit(0).alias("sb"), F.lit(0).alias("sg"))
    fixed = [("h", w, 0, 0, 3, 0) for w in STRONG] + [("h", w, 0, 0, 1, 0) for w in ALONGSIDE] + [("h", w, 0, 0, 0, 1) for w in PLAIN]
    seeds = pages.sparkSession.createDataFrame(fixed, "side string, word string, b long, g long, sb int, sg int")
    counts = counts.unionByName(seeds).groupBy("side", "word").agg(*[F.sum(c).alias(c) for c in ("b", "g", "sb", "sg")])
    counts = materialize(counts, "url-counts")
    # The fixed words are extra counts of their own words only; they don't thin out the others.
    sums = counts.groupBy("side").agg(F.sum("b").alias("bs"), F.sum("g").alias("gs"), F.sum((F.col("b") + F.col("g") > 0).cast("int")).alias("v"))
    llr = (F.log((F.col("b") + F.col("sb") + alpha) / (F.col("bs") + alpha * F.col("v") + alpha))
           - F.log((F.col("g") + F.col("sg") + alpha) / (F.col("gs") + alpha * F.col("v") + alpha)))
    weight = counts.join(F.broadcast(sums), "side").select("side", "word", F.greatest(F.lit(-clip), F.least(F.lit(clip), llr)).alias("w"))

    # Sums in whole millionths do not depend on the order of rows.
    scored = words.join(weight, ["side", "word"]).groupBy("side", "part").agg(
        (F.sum(F.round(F.col("w") * 1e6).cast("long")) / 1e6).alias("s"), F.sort_array(F.collect_set("word")).alias("words"))
    scored = materialize(scored.join(parts.select("part", "text"), "part"), "url-scores")
    h = scored.where("side = 'h'").select(F.col("text").alias("host"), F.col("s").alias("hs"), "words")
    p = scored.where("side = 'p'").select(F.col("text").alias("path"), F.col("s").alias("ps"))
    out = rows.join(h, "host", "left").join(p, "path", "left")
    score = F.lit(prior) + F.coalesce("hs", F.lit(0.0)) + F.coalesce("ps", F.lit(0.0))
    out = out.withColumn("score", score).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") > 0, "block").otherwise("allow")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, F.lit(what)).otherwise(verdict)
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), "score",
                      F.coalesce("words", F.array().cast("array<string>")).alias("words"))
