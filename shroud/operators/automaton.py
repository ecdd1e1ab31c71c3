"""Term lists of any size: an index of terms by their first words, built once and looked up per row.

A hit counts where the ends of the term that are word characters stand at word
borders; marks may touch anything. So a term's runs of letters and digits are
whole runs of the text, and a term can only stand where its first run does. Two
tables are cut into parts of bounded size by a hash and written in the shared
folder, whose files Spark hands to every executor: the shapes (marks before, runs,
marks after) that terms with a certain first run have, and the categories of
each term. A row's runs are looked up in the one, the few places that have a
shape in the other. The files are mapped, not loaded, so neither time nor memory of a
row grows with the number of terms. Terms of marks alone become Aho-Corasick
automata of at most ``PER_AUTOMATON`` terms, walked one after the other.

Detection is a narrow Arrow step: nothing is shuffled, and the same plan serves
batches and streams of any size.

Occurrences of one term do not overlap (leftmost first), those of different
terms may. Null and empty texts, null, blank and repeated terms and empty
tables give nothing.
"""

from __future__ import annotations

import os
import re
from collections import OrderedDict
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import FINDING_T
from ..session import materialize, remove_tables, scratch_path, table_path

PER_AUTOMATON = 50_000
KEPT_AUTOMATA = 4
#: Parts of the index hold this many times as many rows as an automaton.
PER_PART = 10
GROUP_CHARS = 1 << 20
CACHED_WORDS = 200_000

# FIXED VALUES: four letters that case-fold onto ASCII ones, and the final sigma, which case-folds onto the other one.
_FOLDS = str.maketrans({"ı": "i", "ſ": "s", "K": "k", "İ": "i"})


def folded(text: str) -> str:
    """Lower case letter by letter, so that places stay the same."""
    low = text.translate(_FOLDS).lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text.translate(_FOLDS))
    return low.replace("ς", "σ")


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


#: Letters and digits, as ``str.isalnum`` has them; :func:`folded` never changes which characters these are.
_WORD_RUN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class TermFiles:
    """Names of the files that every executor gets, by part (index tables) or in a list (automata), and how terms are compared."""

    heads: tuple[str, ...]
    terms: tuple[str, ...]
    files: tuple[str, ...]
    fold: bool


def _keys(texts) -> np.ndarray:
    return pd.util.hash_array(np.array(texts, object), categorize=False).view(np.int64)


def build_terms(terms: DataFrame, fold: bool, per_automaton: int = PER_AUTOMATON) -> TermFiles:
    """``(term, category)`` -> index and automata; ``fold`` ignores case and blanks around a term."""

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            compared = [folded(t) if fold else t for t in batch["term"]]
            heads, shapes = [], []
            for t in compared:
                runs = [m.span() for m in _WORD_RUN.finditer(t)]
                heads.append(t[slice(*runs[0])] if runs else None)
                shapes.append(f"{runs[0][0]},{len(runs)},{len(t) - runs[-1][1]}" if runs else None)
            yield pd.DataFrame({"term": compared, "category": batch["category"], "head": heads, "shape": shapes,
                                "term_key": _keys(compared), "head_key": _keys([h or "" for h in heads])})

    rows = terms.select((F.trim("term") if fold else F.col("term")).alias("term"), "category").where(F.length("term") > 0).distinct()
    rows = materialize(rows.mapInPandas(prepare, "term string, category string, head string, shape string, term_key long, head_key long"), "terms")
    worded = rows.where("head IS NOT NULL")
    heads = worded.select(F.col("head").alias("text"), F.col("shape").alias("value"), F.col("head_key").alias("key")).distinct()
    whole = worded.select(F.col("term").alias("text"), F.col("category").alias("value"), F.col("term_key").alias("key"))
    marks = rows.where("head IS NULL").select("term", "category")
    out = TermFiles(_write_index(heads, per_automaton * PER_PART), _write_index(whole, per_automaton * PER_PART),
                    _write_automata(marks, fold, per_automaton), fold)
    remove_tables(terms.sparkSession, [table_path(rows)])
    return out


def _write_index(rows: DataFrame, per_part: int) -> tuple[str, ...]:
    """``(text, value, key)`` -> for each part, by key, the file of a table ``(key, text, values)`` sorted by key."""
    spark = rows.sparkSession
    parts = -(-rows.count() // per_part)
    if not parts:
        return ()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow as pa

        pdf = pdf.drop_duplicates(["text", "value"]).sort_values(["key", "text", "value"], kind="stable")
        one = pdf.groupby(["key", "text"], sort=False)["value"].agg("\n".join).reset_index() if pdf.duplicated("text").any() else pdf
        values = pa.array(one["value"], pa.string()).dictionary_encode()
        table = pa.record_batch([pa.array(one["key"], pa.int64()), pa.array(one["text"], pa.large_string()), values], ["key", "text", "values"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as f:
            f.write_batch(table)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "data": [sink.getvalue().to_pybytes()]})

    path = scratch_path(spark, "term-index")
    placed = rows.withColumn("part", F.pmod("key", F.lit(parts)))
    placed.groupBy("part").applyInPandas(make, "part long, data binary").write.option("maxRecordsPerFile", 1).parquet(path)
    files = [""] * parts  # a part that got no rows has no file
    for r in spark.read.schema("part long").parquet(path).select("part", F.col("_metadata.file_path").alias("file")).collect():
        spark.sparkContext.addFile(r["file"])
        files[r["part"]] = os.path.basename(r["file"])
    return tuple(files)


def _write_automata(terms: DataFrame, fold: bool, per_automaton: int) -> tuple[str, ...]:
    """Automata of ``(term, category)``, terms in compared form."""
    spark = terms.sparkSession
    parts = -(-terms.count() // per_automaton)
    if not parts:
        return ()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        import ahocorasick

        machine, by_term = ahocorasick.Automaton(), {}
        for term, category in zip(pdf["term"], pdf["category"]):
            by_term.setdefault(term, set()).add(category)
        for term, categories in by_term.items():
            machine.add_word(term, (len(term), *_borders(term, fold), tuple(sorted(categories))))
        machine.make_automaton()
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "machine": [pickle.dumps(machine)]})

    placed = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    path = scratch_path(spark, "automata")
    placed.groupBy("part").applyInPandas(make, "part long, machine binary").write.option("maxRecordsPerFile", 1).parquet(path)
    files = spark.read.schema("part long, machine binary").parquet(path).inputFiles()
    for f in files:
        spark.sparkContext.addFile(f)
    return tuple(sorted(os.path.basename(f) for f in files))


def _borders(term: str, fold: bool) -> tuple[bool, bool]:
    """Whether the term's ends must stand at word borders: with case ignored an underscore at an end may go on."""
    border = str.isalnum if fold else is_word
    return border(term[0]), border(term[-1])


_LOADED: OrderedDict = OrderedDict()


def _automata(name: str) -> list:
    """The automata of a file of this worker (the latest few are kept)."""
    import pickle

    import pyarrow.parquet as pq
    from pyspark import SparkFiles

    if name not in _LOADED:
        while len(_LOADED) >= KEPT_AUTOMATA:
            _LOADED.popitem(last=False)
        _LOADED[name] = [pickle.loads(x) for x in pq.read_table(SparkFiles.get(name), columns=["machine"]).column(0).to_pylist()]
    _LOADED.move_to_end(name)
    return _LOADED[name]


class _Index:
    """An index table in mapped files of this worker's executor."""

    def __init__(self, files: tuple[str, ...]):
        self.files, self.open = files, {}

    def _part(self, part: int):
        """Keys, texts and values of a part; its file is unpacked once on each executor."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import SparkFiles

        if part not in self.open:
            source = SparkFiles.get(self.files[part])
            plain = f"{source}.arrow"
            if not os.path.exists(plain):
                own = f"{plain}.{os.getpid()}"
                with open(own, "wb") as f:
                    f.write(pq.read_table(source, columns=["data"]).column(0)[0].as_py())
                os.replace(own, plain)
            batch = pa.ipc.open_file(pa.memory_map(plain)).get_batch(0)
            self.open[part] = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        return self.open[part]

    def get(self, texts: list[str]) -> dict[str, str]:
        """The values of those ``texts`` that the table has."""
        out: dict[str, str] = {}
        if not texts or not self.files:
            return out
        keys = _keys(texts)
        places = keys % len(self.files)
        for part in np.unique(places).tolist():
            if not self.files[part]:
                continue
            own = np.flatnonzero(places == part)
            known, names, values = self._part(part)
            at = np.searchsorted(known, keys[own])
            hit = known[np.minimum(at, len(known) - 1)] == keys[own]
            for n, i in zip(own[hit].tolist(), at[hit].tolist()):
                while i < len(known) and known[i] == keys[n]:
                    if names[i].as_py() == texts[n]:
                        out[texts[n]] = values[i].as_py()
                        break
                    i += 1
        return out


class _Finder:
    """Occurrences of indexed terms; remembers the latest words and the shapes that follow them."""

    def __init__(self, terms: TermFiles):
        self.heads, self.terms, self.fold = _Index(terms.heads), _Index(terms.terms), terms.fold
        self.seen: dict[str, tuple] = {}

    def find(self, texts: list[str], searched: list[str]) -> list[set[tuple[int, int, str]]]:
        """``(start, end, category)`` of each text's hits."""
        words = [_WORD_RUN.findall(s) for s in searched]
        if len(self.seen) > CACHED_WORDS:
            self.seen = {}
        if new := list(set().union(*words).difference(self.seen)):
            known = self.heads.get(new)
            self.seen.update((w, tuple(tuple(map(int, x.split(","))) for x in known[w].split("\n")) if w in known else ()) for w in new)
        spans = []  # text, start, end, in order
        for n, (s, ws) in enumerate(zip(searched, words)):
            shapes = [(i, found) for i, w in enumerate(ws) if (found := self.seen[w])]
            if not shapes:
                continue
            runs = [m.span() for m in _WORD_RUN.finditer(s)]
            for i, found in shapes:
                for before, count, after in found:
                    start = runs[i][0] - before
                    if start >= 0 and i + count <= len(runs) and (end := runs[i + count - 1][1] + after) <= len(s):
                        spans.append((n, start, end))
        known = self.terms.get(list({searched[n][a:b] for n, a, b in spans}))
        out: list[set] = [set() for _ in texts]
        last: dict = {}
        for n, start, end in spans:
            key = searched[n][start:end]
            if key not in known:
                continue
            left, right = _borders(key, self.fold)
            text = texts[n]
            if left and start and is_word(text[start - 1]) or right and end < len(text) and is_word(text[end]):
                continue
            if last.get((n, key), 0) <= start:
                last[n, key] = end
                out[n].update((start, end, category) for category in known[key].split("\n"))
        return out


def hits(machine, text: str, searched: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, category)`` of every occurrence in ``text``; ``searched`` is its compared form."""
    last: dict = {}
    for at, found in machine.iter(searched):
        length, left, right, categories = found
        start, end = at - length + 1, at + 1
        if left and start and is_word(text[start - 1]) or right and end < len(text) and is_word(text[end]):
            continue
        key = searched[start:end]
        if last.get(key, 0) <= start:
            last[key] = end
            for category in categories:
                yield start, end, category


def _groups(texts: list) -> Iterator[list[int]]:
    """Numbers of the texts that are not empty, in lists of about ``GROUP_CHARS`` characters."""
    held, size = [], 0
    for n, t in enumerate(texts):
        if t:
            held.append(n)
            size += len(t)
            if size > GROUP_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def with_terms(df: DataFrame, text: str, terms: TermFiles, out: str) -> DataFrame:
    """Add ``out``: the findings of all terms, ascending."""
    fold, loaded = terms.fold, []

    @F.pandas_udf(FINDING_T)
    def walk(texts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(_Finder(terms))
        searched = [folded(t) if fold and t else t for t in texts]
        found: list[set] = [set() for _ in searched]
        if terms.heads:
            whole = texts.tolist()
            for group in _groups(whole):
                for n, some in zip(group, loaded[0].find([whole[n] for n in group], [searched[n] for n in group])):
                    found[n] = some
        for name in terms.files:
            for machine in _automata(name):
                if len(machine):
                    for n, (t, s) in enumerate(zip(texts, searched)):
                        if s:
                            found[n].update(hits(machine, t, s))
        return pd.Series([[{"start": a, "end": b, "category": c, "value": t[a:b]} for a, b, c in sorted(f)] for t, f in zip(texts, found)],
                         dtype=object)

    if not (terms.heads or terms.files):
        return df.withColumn(out, F.array().cast(FINDING_T))
    return df.withColumn(out, walk(F.col(text)))
