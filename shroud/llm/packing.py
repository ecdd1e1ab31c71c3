"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised in one narrow pass and cut into pieces of at most
``capacity`` tokens. Pieces are dealt to chunks of bounded size by a hash of a
row number; each chunk is packed by several islands. An individual is a list
of bins. Crossover injects whole well-filled bins of one parent into the
other, removes the receiver's bins that hold any of the injected pieces, and
best-fits the displaced pieces again. After each epoch an island's elite
migrates to the next island of its chunk (an equi-join); islands stop early at
the lower bound. Poorly filled bins of many chunks then meet in fewer chunks
and are packed again, level by level, until one chunk is left or packing again
saves no more bins.

Null text counts as empty: its document is the closing id alone. Rows with a
null or repeated id are packed like any other; every input row gives its own
pieces. An empty table gives no pieces. Columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from itertools import chain, filterfalse
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, discard, materialize, need

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

# ------------------------------------------------------------- tokenisation

_BLANK = re.compile(r"[\x20\x09-\x0D]")
CHUNK_CHARS = 1 << 20
CACHE_WORDS = 500_000
CACHED_LENGTH = 48


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordEncoder:
    """Token ids of whole texts from a word-bound tokenizer, with the ids of words kept.

    The tokenizer drops white space, lower-cases letter by letter and never
    joins letters with marks, so a text's ids are those of its words one after
    another, a Latin-1 word's are those of its lower-case form, and a mark
    after a Latin-1 letter stands for itself (other letters may decompose). Words are split at ASCII blanks only; all else
    is the tokenizer's own business. Two generations of words are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Lower-case Latin letters go straight to the merges; anything else through the whole tokenizer."""
        out, rest, merge, letters = {}, [], self.model.tokenize, self.letters
        for w in words:
            low = w.lower()
            if w.isalpha() and (w.isascii() or max(w) <= "\xff"):
                shown = low if w.isascii() else "".join([letters[b] for b in low.encode()])
                out[w] = struct.pack(f"<{len(found)}I", *[t.id for t in found]) if (found := merge(shown)) else b""
            else:
                rest.append(w)
        words = rest
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            owner = np.array(got.word_ids, np.int64)
            start = 0
            for word, end in zip(part, (4 * np.searchsorted(owner, np.arange(len(part)), "right")).tolist()):
                out[word] = ids[start:end]
                start = end
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in ``known``."""
        out, marked, older = {}, {}, self.older
        for w in new:
            if (ids := older.get(w)) is not None:
                out[w] = ids
            elif w[-1] in ".,;:!?" and w[-2:-1] <= "\xff" and w[:-1].isalpha():
                marked[w] = w[:-1]
        known = self.known
        fresh = self._encode([w for w in (new | set(marked.values()) | {w[-1] for w in marked}) - out.keys() - marked.keys()
                              if w not in known and w not in older])
        out.update(fresh)
        for w, stem in marked.items():
            out[w] = b"".join([next(d[x] for d in (out, known, older) if x in d) for x in (stem, w[-1])])
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [[] if "<|" in t else _split(_lower(t)) for t in texts]
        # Special tokens are matched in the whole text, before any splitting.
        whole = {n: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                 for n, t in enumerate(texts) if "<|" in t}
        if new := set(filterfalse(self.known.__contains__, chain.from_iterable(split))):
            learnt = self._learn(new)
            if len(self.known) > CACHE_WORDS:
                self.older, self.known = self.known, {"": b""}
                learnt.update((w, self.older[w]) for w in set(chain.from_iterable(split)) - new)
            self.known.update(learnt)
        get = self.known.__getitem__
        out = [whole[n] if n in whole else b"".join(map(get, w)) for n, w in enumerate(split)]
        for w in new:
            if len(w) > CACHED_LENGTH:
                self.known.pop(w, None)
        return out

    def id_chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text of any length, by stretches cut at blanks."""
        if "<|" in text:
            yield from self.ids([text])
            return
        at = 0
        while at < len(text):
            end = at + CHUNK_CHARS
            if end < len(text):
                gap = _BLANK.search(text, end)
                end = gap.start() if gap else len(text)
            yield from self.ids([text[at:end]])
            at = end


def _lower(text: str) -> str:
    """Lower case where it is the same letter by letter (ASCII and Latin-1 texts)."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``CHUNK_CHARS`` characters; a longer one alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _split(text: str) -> list[str]:
    for blank in "\t\n\x0b\x0c\r":
        if blank in text:
            text = text.replace(blank, " ")
    return text.split(" ")


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _all_ids(enc: WordEncoder, texts: list[str]) -> Iterator[bytes]:
    for group in _groups(texts):
        yield from enc.ids(group) if len(group) > 1 or len(group[0]) <= CHUNK_CHARS else [b"".join(enc.id_chunks(group[0]))]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
             tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, crc[, ids])``: every document's pieces, its closing id included.

    ``tokenizer`` is the path of a tokenizer file on the executors (None: the
    installed public word tokenizer).
    """
    need(docs, (id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    last = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = _encoder(tokenizer)
        for batch in batches:
            keys, columns, ids_out = [], ([], [], [], []), []
            for row, ids in enumerate(_all_ids(enc, batch.column("text").to_pylist())):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    keys.append(row)
                    for c, x in zip(columns, (piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(x)
                    if with_ids:
                        ids_out.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column("id").take(pa.array(keys, pa.int64())), pa.array(columns[0], pa.int32()),
                      *(pa.array(c, pa.int64()) for c in columns[1:])]
            names = ["id", "piece", "start", "length", "crc"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"id {kind}, piece int, start long, length long, crc long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(cut, schema)


# ---------------------------------------------------------- genetic packing

Bins = list[list[int]]  # piece numbers by bin


def best_fit(bins: Bins, pieces: list[int], size: list[int], capacity: int) -> Bins:
    """Put each piece into the fullest bin that takes it, else into a new one (``bins`` is changed)."""
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in pieces:
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > size[i]:
            insort(free, (room - size[i], k))
    return bins


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled as unevenly as can be (room gathers in few bins)."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(giver: Bins, taker: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject half the giver's well-filled bins; remove duplicates; best-fit the displaced pieces."""
    full = sorted(giver, key=lambda b: -sum(size[i] for i in b))[: max(1, len(giver) * 2 // 3)]
    inject = [list(b) for b in rng.sample(full, max(1, len(full) // 2))]
    taken = {i for b in inject for i in b}
    left, loose = [], []
    for b in taker:
        if taken.isdisjoint(b):
            left.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    # The two emptiest bins left give way too: their pieces find better places together with the displaced ones.
    left.sort(key=lambda b: -sum(size[i] for i in b))
    for _ in range(min(2, len(left))):
        loose += left.pop()
    loose.sort(key=lambda i: -size[i])
    return best_fit(inject + left, loose, size, capacity)


def first_parents(size: list[int], capacity: int, count: int, rng: random.Random) -> Iterator[Bins]:
    """Best fit by decreasing size, then by slightly disturbed decreasing sizes."""
    order = sorted(range(len(size)), key=lambda i: -size[i])
    yield best_fit([], order, size, capacity)
    for _ in range(count - 1):
        noise = [size[i] * rng.uniform(0.85, 1.0) for i in range(len(size))]
        yield best_fit([], sorted(order, key=lambda i: -noise[i]), size, capacity)


def evolve(size: list[int], capacity: int, elites: list[Bins], seed: int, population: int, generations: int) -> list[Bins]:
    """One epoch of an island; the best individuals first. Stops at the lower bound of bins."""
    bound = -(-sum(size) // capacity)
    rng = random.Random(seed)
    group = [(fitness(b, size, capacity), b) for b in elites]
    best = lambda: max(group, key=lambda x: x[0])[1]
    for parent in first_parents(size, capacity, max(1, population - len(elites)), rng):
        if group and len(best()) == bound:
            break
        group.append((fitness(parent, size, capacity), parent))
    for _ in range(generations):
        if len(best()) == bound or len(group) < 2:
            break
        bred = [crossover(*(b for _, b in rng.sample(group, 2)), size, capacity, rng) for _ in range(population)]
        group += [(fitness(b, size, capacity), b) for b in bred]
        group = sorted(group, key=lambda x: x[0], reverse=True)[:population]
    return [b for _, b in sorted(group, key=lambda x: x[0], reverse=True)]


def _dump(bins: Bins, n: int) -> bytes:
    owner = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        owner[b] = k
    return owner.tobytes()


def _load(blob: bytes) -> Bins:
    owner = np.frombuffer(blob, "<i4")
    order = np.argsort(owner, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)]


def pack_chunks(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int,
                seed: int) -> DataFrame:
    """``(chunk, uid, length)`` -> ``(chunk, uids, owner)``: the best individual of each chunk's islands."""
    chunks = items.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("x"))
    chunks = chunks.select("chunk", F.col("x.uid").alias("uids"), F.col("x.length").alias("lengths"))
    chunks = materialize(chunks, "packing-chunks")
    rows = chunks.count() * islands
    state = chunks.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths",
                          F.array().cast("array<binary>").alias("elites"))

    def epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                size = [int(x) for x in r.lengths]
                group = evolve(size, capacity, [_load(e) for e in r.elites], hash((seed, r.chunk, r.island, len(r.elites))),
                               population, generations)
                bins, square = fitness(group[0], size, capacity)
                yield pd.DataFrame({"chunk": [r.chunk], "island": [r.island], "bins": [-bins], "square": [square],
                                    "elites": [[_dump(b, len(size)) for b in group[:2]]]})

    schema = "chunk long, island int, bins long, square double, elites array<binary>"
    done = None
    for turn in range(epochs):
        # One row is one island's whole epoch: a task for every few rows, however few bytes they have.
        spread = state.repartition(blocks_of(rows, 4), "chunk", "island")
        before, done = done, materialize(spread.mapInPandas(epoch, schema), "packing-epoch")
        if before is not None:
            discard(before)
        if turn + 1 < epochs:
            guests = done.select("chunk", ((F.col("island") + 1) % islands).alias("island"),
                                 F.slice("elites", 1, 1).alias("guests"))
            state = (done.join(guests, ["chunk", "island"]).join(chunks.select("chunk", "lengths"), "chunk")
                     .select("chunk", "island", "lengths", F.concat("elites", "guests").alias("elites")))
    best = done.groupBy("chunk").agg(F.min_by(F.col("elites")[0], F.struct("bins", -F.col("square"), "island")).alias("owner"))
    return best.join(chunks, "chunk")


def _bins_of(packed: DataFrame) -> DataFrame:
    """``(chunk, uids, lengths, owner)`` -> one row per bin with its pieces."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                uids, lengths = np.asarray(r.uids, np.int64), np.asarray(r.lengths, np.int64)
                bins = _load(r.owner)
                yield pd.DataFrame({"chunk": r.chunk, "bin": np.arange(len(bins)), "fill": [int(lengths[b].sum()) for b in bins],
                                    "uids": [uids[b].tolist() for b in bins], "lengths": [lengths[b].tolist() for b in bins]})

    return packed.mapInPandas(split, "chunk long, bin long, fill long, uids array<long>, lengths array<long>")


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = 4096, islands: int = 3, epochs: int = 2,
         population: int = 6, generations: int = 6, merge: int = 64, poor: float = 0.95, seed: int = 11,
         gain: float = 0.005) -> DataFrame:
    """``(uid, length)`` with unique ``uid`` -> ``(uid, sequence_id, offset)``.

    ``chunk_pieces`` bounds a chunk; bins filled below ``poor`` of the capacity
    of ``merge`` chunks meet again at the next level. Once the chunks cannot get
    fewer, a level that saves less than ``gain`` of the bins it packs again is
    the last; a level that saves none leaves the bins as they were.
    """
    items = pieces.where(F.col("length") < capacity)
    chunks = blocks_of(items.count(), chunk_pieces)
    items = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk"))
    placed = pieces.where(F.col("length") >= capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Offsets: running sum inside one bin of bounded size.
    starts = F.expr("transform(sequence(0, size(lengths) - 1), i -> aggregate(slice(lengths, 1, i), 0L, (s, x) -> s + x))")

    def rows_of(bins: DataFrame) -> DataFrame:
        return (bins.select("sequence_id", F.arrays_zip("uids", starts.alias("offset")).alias("z"))
                .select("sequence_id", F.inline("z")).select(F.col("uids").alias("uid"), "sequence_id", "offset"))

    level, used, held, n_held = 0, 0, None, 0  # used: chunk numbers given so far; held: the poor bins of the level before
    while True:
        bins = _bins_of(pack_chunks(items, capacity, islands, epochs, population, generations, seed + level))
        number = (F.col("chunk") + F.lit(used)) * F.lit(1 << 24) + F.col("bin")
        bins = materialize(bins.withColumn("sequence_id", number), "packing-bins")
        used += chunks
        stalled = False
        if held is not None:
            saved = n_held - bins.count()
            stalled = saved < gain * n_held
            if saved <= 0:
                bins = held
        rest = bins.where(F.col("fill") < F.lit(poor * capacity))
        n_held, left = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("uids")), F.lit(0))).first()
        fewer = max(min(blocks_of(chunks, merge), blocks_of(left, chunk_pieces // 2)), blocks_of(left, 2 * chunk_pieces))
        if chunks == 1 or not left or (stalled and fewer >= chunks):
            return placed.unionByName(rows_of(bins))
        placed = placed.unionByName(rows_of(bins.where(F.col("fill") >= F.lit(poor * capacity))))
        chunks, held = fewer, rest
        items = rest.select("chunk", F.inline(F.arrays_zip("uids", "lengths"))).select(
            F.col("uids").alias("uid"), F.col("lengths").alias("length"),
            F.pmod(F.xxhash64("uids", F.lit(level)), F.lit(chunks)).alias("chunk"))
        level += 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   tokenizer: str | None = None, with_ids: bool = False, **options) -> DataFrame:
    """``(id, piece, start, length, crc[, ids], sequence_id, offset)``, one row per piece."""
    pieces = tokenize(docs, id_col, text_col, capacity, tokenizer, with_ids)
    # The row numbers are frozen by writing the table.
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity, **options), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from :func:`pack_documents` with ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
