"""Token alignment between two tokenizers, as an Arrow pipeline inside Spark tasks.

A task cuts its rows into units of bounded bytes, and those into parts that are
aligned one after the other, so that a worker holds the arrays of one part. A
part's texts are cut at single spaces, where both tokenizers always end a token (checked when they are
loaded; a text is left whole if they do not), and each distinct piece is
tokenised once; the tokens of short pieces are kept in Arrow arrays. Everything after that is columnar: token lists are flattened
beside their parent indices, segmented cumulative sums of token lengths give
each token's end in its piece, and an Acero hash join on (piece, end) pairs the
ends of both sides. In order of that key every row of the full join is one
overlapping pair of tokens, and rows with both ends are the cuts between
groups. ``Table.group_by`` counts the id pairs of a part, numbered alike in all
parts of a unit, whose counts leave it once; Spark adds those
partial counts up, finds each B id's highest, and hands every unit the totals
of its own pairs only, in a co-grouping on the unit number.

Null and empty texts, and texts that one of the tokenizers does not give back
byte for byte, have no tokens: zeros and an empty digest. A very long text is a
unit and a part of its own. Repeated rows and null ids count like any other row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, need

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: Bytes of text in a unit and in a part of it (a longer text is one of its own), and pieces whose tokens a worker keeps.
UNIT_BYTES = 4 << 20
PART_BYTES = 1 << 20
KEPT_PIECES = 200_000
KEPT_LENGTH = 48
IDS = pa.list_(pa.int32())
_MARK = "▁"
#: The piece tokenizer reads its own mark as a space.
_IRREGULAR = re.compile(rf"\A[\s{_MARK}]|[\s{_MARK}][\s{_MARK}]|[\s{_MARK}]\Z")
_SINGLE = re.compile(rf"(?<=[^\s{_MARK}]) (?=[^\s{_MARK}])")


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class TokenizerPair:
    """Token ids of pieces under both tokenizers, and the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        letters = _letter_bytes()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        a_bytes = [bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        b_names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(b_names)]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [pc.cast(pc.binary_length(x), pa.int64()) for x in self.bytes]
        self.numbers = [pa.array([str(i) for i in range(len(x))]) for x in self.bytes]
        with open(byte_path) as f:
            before = json.load(f)["pre_tokenizer"] or {}
        inner = any(_MARK in p.lstrip(_MARK) for p in b_names)
        #: Whether every single space between two other characters starts a token on both sides.
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not inner
        self._forget()

    def _forget(self) -> None:
        self.kept, self.kept_ids = pa.array([], pa.string()), [pa.array([], IDS)] * 2

    def split(self, text: str) -> list[str]:
        """Pieces of a text; each stands for itself after one space."""
        if not self.cuts:
            return [text]
        return _SINGLE.split(text) if _IRREGULAR.search(text) else text.split(" ")

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        left = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        return left, self.b.encode(pieces, num_threads=1)

    def tokens(self, pieces: pa.StringArray) -> list[pa.ListArray]:
        """Ids of distinct pieces under both tokenizers; those of short pieces are kept for later parts."""
        if len(self.kept) > KEPT_PIECES:
            self._forget()
        new = pieces.filter(pc.invert(pc.is_in(pieces, value_set=self.kept)))
        known = pa.concat_arrays([self.kept, new])
        ids = [pa.concat_arrays([x, pa.array(y, IDS)]) for x, y in zip(self.kept_ids, self.encode(new.to_pylist()))]
        place, short = pc.index_in(pieces, value_set=known), pc.less_equal(pc.utf8_length(known), KEPT_LENGTH)
        self.kept, self.kept_ids = known.filter(short), [x.filter(short) for x in ids]
        return [x.take(place) for x in ids]


_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


def tokenizer_pair(byte_path: str | None = None, piece_path: str | None = None) -> TokenizerPair:
    """The pair for two files (None: the installed public ones), loaded once in a worker."""
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    paths = (byte_path or public_tokenizers.path(BYTE_TOKENIZER), piece_path or public_tokenizers.path(PIECE_TOKENIZER))
    if paths not in _PAIRS:
        _PAIRS[paths] = TokenizerPair(*paths)
    return _PAIRS[paths]


# ------------------------------------------------------------------ one part

def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _segments(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Side:
    """One tokenizer's tokens of all pieces: ids, the piece of each, and its end there in bytes."""

    def __init__(self, tokens: pa.ListArray, lengths: pa.Array, data: pa.Array):
        self.ids = pc.list_flatten(tokens)
        self.piece = pc.list_parent_indices(tokens).to_numpy()
        total = pc.cumulative_sum(pc.take(lengths, self.ids)).to_numpy()
        before = _starts(pc.list_value_length(tokens).to_numpy())[:-1]
        self.end = total - np.concatenate([[0], total])[before][self.piece]
        self.joined = pc.binary_join(_segments(np.append(before, len(self.ids)), pc.take(data, self.ids)), pa.scalar(b"", pa.binary()))

    def keep(self, good: np.ndarray) -> "Side":
        mask = good[self.piece]
        self.ids, self.piece, self.end = self.ids.filter(pa.array(mask)), self.piece[mask], self.end[mask]
        return self

    def ends(self, name: str) -> pa.Table:
        return pa.table({"key": pa.array((self.piece << 32) | self.end), name: self.ids})


def align(texts: list[str | None], pair: TokenizerPair) -> tuple[dict[str, pa.Array], dict[str, pa.Array]]:
    """Columns of the part's texts ``(n_a, n_b, n_groups, n_links, groups, pairs, times)`` and of its id pairs ``(pair, a, b, n)``."""
    lists = pa.array([pair.split(t) if t else [] for t in texts], pa.list_(pa.string()))
    words = pc.list_flatten(lists).dictionary_encode()
    doc, piece = pc.list_parent_indices(lists).to_numpy(), words.indices.to_numpy(zero_copy_only=False)
    pieces = words.dictionary
    left, right = (Side(x, pair.lengths[s], pair.bytes[s]) for s, x in enumerate(pair.tokens(pieces)))
    wanted = pc.binary_join_element_wise(pa.scalar(b"", pa.binary()), pc.cast(pieces, pa.binary()), pa.scalar(b" ", pa.binary()))
    good = pc.and_(pc.equal(left.joined, wanted), pc.equal(right.joined, wanted)).to_numpy(zero_copy_only=False)
    n_pieces, n_docs = len(pieces), len(texts)
    whole = np.bincount(doc, ~good[piece], n_docs) == 0  # every piece comes back byte for byte
    left, right = left.keep(good), right.keep(good)

    links = left.ends("a").join(right.ends("b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    owner = links["key"].to_numpy() >> 32
    ends_a, ends_b = (pc.is_valid(links[c]).to_numpy().astype(np.int64) for c in ("a", "b"))
    so_far_a, so_far_b = np.cumsum(ends_a), np.cumsum(ends_b)
    # The tokens that a row's stretch lies in: as many came to their end before it.
    link_a, link_b = pc.take(left.ids, pa.array(so_far_a - ends_a)), pc.take(right.ids, pa.array(so_far_b - ends_b))
    cut = np.flatnonzero(ends_a & ends_b)
    count = lambda owners: np.bincount(owners, minlength=n_pieces)
    per_piece = {"n_a": count(left.piece), "n_b": count(right.piece), "n_groups": count(owner[cut]), "n_links": count(owner)}

    written = []  # each group's ids on both sides, as text
    for side, numbers, so_far in ((left, pair.numbers[0], so_far_a), (right, pair.numbers[1], so_far_b)):
        written.append(pc.binary_join(_segments(np.concatenate([[0], so_far[cut]]), pc.take(numbers, side.ids)), ","))
    groups = pc.binary_join_element_wise(*written, "|")
    groups = pc.binary_join(_segments(_starts(per_piece["n_groups"]), groups), ";")

    used = whole[doc]
    doc, piece = doc[used], piece[used]
    size = np.bincount(doc, minlength=n_docs)
    text_groups = pc.binary_join(_segments(_starts(size), pc.take(groups, pa.array(piece))), ";")
    digest = [hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(text_groups, size.tolist())]
    out = {name: pa.array(np.bincount(doc, n[piece], n_docs).astype(np.int64)) for name, n in per_piece.items()}

    # Id pairs: each distinct piece of a text counts its own links as often as it stands there.
    both = pa.array((link_a.to_numpy().astype(np.int64) << 32) | link_b.to_numpy()).dictionary_encode()
    stands = pa.table({"doc": doc, "piece": piece, "n": np.ones(len(doc), np.int64)}).group_by(["doc", "piece"], use_threads=False)
    stands = stands.aggregate([("n", "sum")])
    own = pc.take(_segments(_starts(per_piece["n_links"]), both.indices), stands["piece"]).combine_chunks()
    at = pc.list_parent_indices(own)
    held = pa.table({"doc": stands["doc"].take(at), "pair": pc.list_flatten(own), "n": stands["n_sum"].take(at)})
    held = held.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]).sort_by("doc").combine_chunks()
    offsets = _starts(np.bincount(held["doc"].to_numpy(), minlength=n_docs))
    out |= {"groups": pa.array(digest), "pairs": _segments(offsets, _one(held["pair"], pa.int32())),
            "times": _segments(offsets, _one(held["n_sum"], pa.int64()))}
    total = held.select(["pair", "n_sum"]).group_by("pair", use_threads=False).aggregate([("n_sum", "sum")])
    ids = pc.take(both.dictionary, total["pair"]).to_numpy()
    return out, {"pair": _one(total["pair"], pa.int32()), "a": pa.array((ids >> 32).astype(np.int32)),
                 "b": pa.array((ids & 0xFFFFFFFF).astype(np.int32)), "n": _one(total["n_sum_sum"], pa.int64())}


def _one(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.array(column.to_numpy(), kind)


# -------------------------------------------------------------- whole corpus

def _units(texts: list[str | None], most: int | None = None) -> Iterator[slice]:
    most, start, size = most or UNIT_BYTES, 0, 0
    for n, t in enumerate(texts):
        more = len(t or "")
        if size and size + more > most:
            yield slice(start, n)
            start, size = n, 0
        size += more
    if start < len(texts):
        yield slice(start, len(texts))


class PairNumbers:
    """The id pairs of a unit, numbered as its parts bring them, and how many links hold each."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.links: list[int] = []

    def add(self, lists: pa.ListArray, pairs: dict[str, pa.Array]) -> pa.ListArray:
        """Take a part's pairs in; its texts' lists of pairs with the numbers of the unit."""
        a, b, old = (pairs[c].to_numpy().astype(np.int64) for c in ("a", "b", "pair"))
        renumbered = np.zeros(old.max(initial=-1) + 1, np.int32)
        for key, at, n in zip(((a << 32) | b).tolist(), old.tolist(), pairs["n"].to_pylist()):
            renumbered[at] = place = self.number.setdefault(key, len(self.links))
            if place == len(self.links):
                self.links.append(0)
            self.links[place] += n
        return _segments(lists.offsets.to_numpy(), pa.array(renumbered[lists.values.to_numpy()]))

    def columns(self) -> dict[str, pa.Array]:
        ids = np.fromiter(self.number, np.int64, len(self.number))
        return {"pair": pa.array(np.arange(len(ids), dtype=np.int32)), "a": pa.array((ids >> 32).astype(np.int32)),
                "b": pa.array((ids & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(self.links, pa.int64())}


def align_unit(texts: list[str | None], pair: TokenizerPair) -> Iterator[tuple[slice | None, dict[str, pa.Array]]]:
    """The columns of each part of a unit's texts with its place, then (place None) those of the unit's id pairs."""
    numbers = PairNumbers()
    for part in _units(texts, PART_BYTES):
        found, pairs = align(texts[part], pair)
        found["pairs"] = numbers.add(found["pairs"], pairs)
        yield part, found
    yield None, numbers.columns()


def aligned_units(docs: DataFrame, id_col: str, text_col: str, byte_path: str | None, piece_path: str | None) -> DataFrame:
    """Both kinds of rows of every unit: its texts (``a`` is null) and its id pairs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    columns = {"unit": "long", "id": kind, "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
               "pairs": "array<int>", "times": "array<long>", "pair": "int", "a": "int", "b": "int", "n": "long"}
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, unit = tokenizer_pair(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for of in _units(texts):
                for part, got in align_unit(texts[of], pair):
                    n = len(got["n"]) if part is None else part.stop - part.start
                    got |= {"unit": pa.array(np.full(n, unit), pa.int64())} | ({} if part is None else {"id": ids[of][part]})
                    kinds = {c: ids.type if c == "id" else arrow[k] for c, k in columns.items()}
                    yield pa.RecordBatch.from_arrays([got[c] if c in got else pa.nulls(n, t) for c, t in kinds.items()], list(columns))
                unit += 1

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns.items()))


def pair_counts(units: DataFrame) -> DataFrame:
    """``(a, b, links, best)``: how many links hold a pair, and whether no other pair of its B id has more."""
    counts = units.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.sum("n").alias("links"))
    top = counts.groupBy("b").agg(F.max("links").alias("top"))
    return counts.join(top, "b").select("a", "b", "links", (F.col("links") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None,
              piece_path: str | None = None) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` for every row; ``groups`` is the digest of its groups.

    ``byte_path`` and ``piece_path`` are tokenizer files on the executors.
    """
    need(docs, (id_col, text_col))
    units = materialize(aligned_units(docs, id_col, text_col, byte_path, piece_path), "alignment-units")
    pairs = units.where(F.col("a").isNotNull()).select("unit", "pair", "a", "b")
    known = pairs.join(pair_counts(units), ["a", "b"]).select("unit", "pair", "links", "best")
    texts = units.where(F.col("a").isNull()).select(F.col("unit").alias("of"), "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
    kind = dict(texts.dtypes)["id"]
    names = ["id", "n_a", "n_b", "n_groups", "n_links"]

    def add_up(held: pa.Table, totals: pa.Table) -> pa.Table:
        lists, times = held["pairs"].combine_chunks(), pc.list_flatten(held["times"]).to_numpy()
        owner, pair = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
        place = pc.index_in(pair, totals["pair"].combine_chunks())
        links, best = (pc.take(totals[c], place).to_numpy() for c in ("links", "best"))
        sums = [np.zeros(held.num_rows, np.int64) for _ in range(2)]
        for out, value in zip(sums, (best * times, links * times)):
            np.add.at(out, owner, value)
        return pa.table([*(held[c] for c in names), *map(pa.array, sums), held["groups"]], [*names, "n_best", "count_sum", "groups"])

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return texts.groupBy("of").cogroup(known.groupBy("unit")).applyInArrow(add_up, schema)
