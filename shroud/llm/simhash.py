"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of all documents are computed in one narrow pass, equal ones are
merged, and the distinct fingerprints are range-partitioned by population count
(whole word, then its four 16-bit quarters) into tiles. Two tiles are compared
only if their population counts come within the radius: the Hamming distance is
at least the difference of the counts, and at least the summed differences of
the quarters' counts. A surviving tile pair is compared exactly with numpy
(exclusive-or, ``bitwise_count``) and gives a spanning forest of its links (at
most one edge per fingerprint), so a large group of near copies never becomes
a table of all its pairs. Components of those edges are found in Spark.

Null text counts as empty; a text without words has fingerprint 0 and links
like any other. A null ``doc_id`` takes part; ``component_id`` is the smallest
non-null id of the component (null if there is none). Repeated rows repeat in
the result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.hashing import PAIR, row_hash

from .common import blocks_of, materialize, need
from .components import connected_components

HASH_SEED = 42
CHUNK_BYTES = 1 << 22
TILE_ROWS = 8192
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """Words of ``text`` in lists of bounded size (cut at white space)."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every ``k`` consecutive words joined by one space."""
    import xxhash

    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(words) - k + 1].tolist()
    stops = (ends - 1)[k - 1:].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], HASH_SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """SimHash of one text (UTF-8 bytes): bit i is set if it is set in over half the shingle hashes."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    for words in _word_chunks(text or b""):
        words = carry + words
        if len(words) >= k:
            h = _hashes(words, k)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            n += len(h)
            carry = words[len(words) - k + 1:] if k > 1 else []
        else:
            carry = words
    if n == 0 and carry:
        h = _hashes(carry, len(carry))
        counts, n = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 3) -> DataFrame:
    """Add the signed 64-bit fingerprint of column ``text`` as ``out``."""

    @F.pandas_udf("long")
    def fp(col: pd.Series) -> pd.Series:
        prints = np.fromiter((fingerprint(t, k) for t in col), np.uint64, len(col))
        return pd.Series(prints.view(np.int64))

    return df.withColumn(out, fp(F.col(text).cast("binary")))


# --------------------------------------------------------------------- tiles

def _pack(rows: pd.DataFrame, tile: int) -> dict:
    q = rows[["pc", "q0", "q1", "q2", "q3"]]
    return {"tile": tile, "fps": rows["fp"].to_numpy(np.int64).tobytes(), "lo": q.min().tolist(), "hi": q.max().tolist()}


def tiles_of(prints: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct fingerprints ``(fp)`` as tiles ``(tile, fps, lo, hi)`` sorted by population counts."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).alias(f"q{i}") for i in range(4)]
    df = prints.select("fp", F.bit_count("fp").alias("pc"), *quarter)
    order = ["pc", "q0", "q1", "q2", "q3", "fp"]
    parts = blocks_of(prints.count(), tile_rows)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, held, size, k = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            while size >= tile_rows:
                rows = pd.concat(held)
                yield pd.DataFrame([_pack(rows.iloc[:tile_rows], first + k)])
                held, size, k = [rows.iloc[tile_rows:]], size - tile_rows, k + 1
        if size:
            yield pd.DataFrame([_pack(pd.concat(held), first + k)])

    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInPandas(pack, "tile long, fps binary, lo array<int>, hi array<int>"), "simhash-tiles")


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` of tiles, ``a <= b``, whose population counts come within ``radius``."""
    box = tiles.select("tile", "lo", "hi")
    left = box.select(F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"),
                      F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)).alias("pc"))
    right = box.select(F.col("tile").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"),
                       F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("pc"))
    gap = F.expr("aggregate(sequence(1, 4), 0, (s, i) -> s + greatest(0, blo[i] - ahi[i], alo[i] - bhi[i]))")
    return left.join(right, "pc").where((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct()


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the classes of ``u`` and ``v`` in the compressed label array."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles sorted by population count."""
    nodes = a if same else np.concatenate([a, b])
    base = 0 if same else len(a)
    label = np.arange(len(nodes))
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    pa_, pb = np.bitwise_count(ua).astype(int), np.bitwise_count(ub).astype(int)
    for i in range(0, len(ua), 64):
        block = ua[i:i + 64]
        lo = np.searchsorted(pb, pa_[i] - radius, "left")
        hi = np.searchsorted(pb, pa_[min(i + 64, len(ua)) - 1] + radius, "right")
        near = np.bitwise_count(block[:, None] ^ ub[None, lo:hi]) <= radius
        r, c = np.nonzero(near)
        if len(r):
            _merge(label, r + i, c + lo + base)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(tiles: DataFrame, radius: int) -> DataFrame:
    """Forest edges ``(u, v)`` of all tile pairs within the radius."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n) for n in ("a", "b", "fa", "fb")]
            for row in range(batch.num_rows):
                a, b, fa, fb = (c[row].as_py() for c in cols)
                u, v = forest(np.frombuffer(fa, np.int64), np.frombuffer(fb, np.int64), radius, a == b)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    pairs = tile_pairs(tiles, radius)
    blob = tiles.select("tile", "fps")
    both = (pairs.join(blob.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a")
            .join(blob.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b"))
    spread = both.repartition(F.xxhash64("a", "b"))
    return spread.mapInArrow(compare, "u long, v long")


def _components(rows: DataFrame, k: int, radius: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(id, t, ...)`` -> ``(id, fp, ...)`` of every row, and ``(fp, root, component_id)`` of every distinct fingerprint."""
    prints = materialize(with_fingerprint(rows, "t", "fp", k).drop("t"), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = connected_components(links(tiles_of(distinct, tile_rows), radius))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = materialize(member.select("fp", "root", "low"), "simhash-members")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints, member.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(id, fp, component_id, root)`` for every row of ``docs``; see the module text for the edge cases.

    ``root`` is the component's smallest fingerprint.
    """
    need(docs, (id_col, text_col))
    prints, named = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), k, radius, tile_rows)
    return prints.join(named, "fp").select("id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3,
             tile_rows: int = TILE_ROWS) -> DataFrame:
    """``docs`` with exactly one row left of each near-duplicate component.

    It is a row with the component's smallest id; a null id counts as larger
    than all others, and of several rows with that id the one with the smallest
    row hash stays, so reruns agree. Rows that repeat an id but not its text are
    judged by their own texts: each component keeps its row.
    """
    need(docs, (id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *row_hash(docs))
    prints, named = _components(rows, k, radius, tile_rows)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", *PAIR)).alias("w")
    kept = prints.join(named, "fp").groupBy("root").agg(first).select(*[f"w.{c}" for c in PAIR])
    return docs.select("*", *row_hash(docs)).join(kept, PAIR, "left_semi").dropDuplicates(PAIR).select(*docs.columns)
