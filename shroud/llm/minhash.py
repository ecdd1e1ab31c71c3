"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

One narrow pass hashes every document's distinct word shingles and takes the
minima of ``bands * rows`` hash functions. Whole minima form the band keys; of
each minimum only the low ``bits`` bits are kept, packed into the signature.
Documents with equal sets are one class. Classes that share a band key are
candidates; a band with many classes is dealt to blocks of bounded size that
meet pairwise. Inside a block pair, bit counts of the exclusive-or of packed
signatures give the number of equal minima, and after correction for equal low
bits by chance the estimated similarity. Only pairs that could reach the
threshold (``margin`` standard errors below it) are confirmed, on full sets.

A large group never becomes a table of its pairs: candidates leave a block as a
forest, connected components of those edges are clusters, and the sets of a
cluster's classes meet in units of bounded size, where candidates are compared
again and confirmed with numpy; confirmed links leave a unit as a forest, too.
With 40 bands of 6 rows a pair of similarity 0.85 shares no band with a
probability of 6e-9; sets are compared by 64-bit hashes of their shingles.

Null and empty texts, and texts without words, have an empty set and are linked
with nothing. A null id takes part; ``component_id`` is the smallest non-null id
of the component, or null. Repeated rows repeat in the result. Other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.hashing import PAIR, text_hash

from .common import discard, materialize, need
from .components import connected_components
from .simhash import _merge as merge

CHUNK_BYTES = 1 << 22
BLOCK = 2048
SMALL = 64  # runs of up to so many classes are compared together
SLOT_SHINGLES = 1 << 16  # hashes of the sets on one side of a unit
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ------------------------------------------------------------------ signatures

def shingle_set(text: bytes | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles (ASCII lower case)."""
    import xxhash

    parts, carry, text = [], [], text or b""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        runs = [words[i:] for i in range(k)]
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, map(b" ".join, zip(*runs))), np.uint64, max(0, len(words) - k + 1)))
        carry = words[-(k - 1):] if k > 1 else []
        if len(words) < k:
            carry = words
    found = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    if not len(found) and carry:
        found = np.array([xxhash.xxh3_64_intdigest(b" ".join(carry))], np.uint64)
    return found


class MinHasher:
    """``bands * rows`` hash functions, the band keys and packed low bits of their minima."""

    def __init__(self, bands: int = 40, rows: int = 6, bits: int = 4, seed: int = 13):
        if bits not in (1, 2, 4, 8):
            raise ValueError("bits must be 1, 2, 4 or 8")
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, self.count = bands, rows, bits, bands * rows
        self.factor = rng.integers(0, 1 << 32, self.count, np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, self.count, np.uint32)
        self.mix = rng.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(self.count, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(low, (x[at:at + 1024, None] * self.factor + self.shift).min(axis=0), out=low)
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """``(documents, functions)`` -> ``(documents, bands)`` signed keys, different for each band."""
        wide = minima.reshape(-1, self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        return (wide * self.mix).sum(axis=2, dtype=np.uint64).view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the (mixed) minima as rows of 64-bit numbers."""
        mixed = minima * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        shown = (mixed[:, :, None] >> np.arange(self.bits, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(shown.reshape(len(minima), -1).astype(np.uint8), axis=1, bitorder="little")
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many kept minima differ between packed rows (the last axis) of ``a`` and ``b``."""
        out, lanes = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.uint16), np.uint64(sum(1 << i for i in range(0, 64, self.bits)))
        for w in range(a.shape[-1]):
            x, half = a[..., w] ^ b[..., w], self.bits // 2
            while half:  # any differing bit of a minimum shows in its lowest bit
                x |= x >> np.uint64(half)
                half //= 2
            out += np.bitwise_count(x & lanes)
        return out

    def similarity(self, differing: np.ndarray) -> np.ndarray:
        """Estimated similarity: the share of equal low bits, corrected for those equal by chance."""
        chance = 2.0 ** -self.bits
        return (1 - differing / self.count - chance) / (1 - chance)

    def most_differing(self, threshold: float, margin: float) -> int:
        """The most differing minima of a pair that may reach ``threshold``."""
        chance = 2.0 ** -self.bits
        equal = threshold + (1 - threshold) * chance
        return int(self.count * (1 - equal + margin * np.sqrt(equal * (1 - equal) / self.count)))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, hasher: MinHasher) -> DataFrame:
    """``(id, h1, h2, n, key, sig, bands)`` of every row; ``key`` identifies the set (null if it is empty)."""
    rows = docs.select(F.col(id_col).alias("id"), *text_hash(text_col), F.col(text_col).cast("binary").alias("t"))
    kind = dict(rows.dtypes)["id"]

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            low, sizes, keys = np.empty((batch.num_rows, hasher.count), np.uint32), [], []
            for n, text in enumerate(batch.column("t")):
                found = shingle_set(text.as_py(), k)
                low[n] = hasher.minima(found)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sig, bands = hasher.packed(low), hasher.band_keys(low)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * hasher.bands)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", *PAIR)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array([r.tobytes() for r in sig], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                ["id", *PAIR, "n", "key", "sig", "bands"])

    return rows.mapInArrow(sign, f"id {kind}, __h1 long, __h2 long, n long, key binary, sig binary, bands array<long>")


# ------------------------------------------------------------------ candidates

def band_members(classes: DataFrame) -> DataFrame:
    """``(band, block, blocks, cls)`` of the band keys that several classes share."""
    rows = classes.select(F.explode("bands").alias("band"), "cls")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return rows.join(shared, "band").select("band", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), blocks.alias("blocks"), "cls")


class Block:
    """Classes of one or many runs (bands, clusters), one after another; ``part`` tells the sides of a unit apart."""

    def __init__(self, cls, n, sig, part=None):
        self.cls, self.n, self.sig, self.part = cls, n, sig, part

    @classmethod
    def of(cls, rows) -> "Block":
        """From an Arrow struct array of ``(cls, n, sig)``."""
        sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), "<u8").reshape(len(rows), -1)
        return cls(rows.field("cls").to_numpy(), rows.field("n").to_numpy(), sig)

    def slice(self, start: int, end: int) -> "Block":
        return Block(self.cls[start:end], self.n[start:end], self.sig[start:end], None if self.part is None else self.part[start:end])


class Candidates:
    """Which pairs of classes could be linked, by the bit counts of their signatures."""

    def __init__(self, hasher: MinHasher, threshold: tuple[int, int], margin: float):
        self.hasher, (self.over, self.under) = hasher, threshold
        self.limit = hasher.most_differing(self.over / self.under, margin)

    def near(self, a: Block, i, b: Block, j) -> np.ndarray:
        """Whether pairs (by place) may reach the threshold."""
        n, m = a.n[i], b.n[j]
        # Sets of too different sizes cannot.
        near = self.hasher.differing(a.sig[i], b.sig[j]) <= self.limit
        near &= self.under * np.minimum(n, m) >= self.over * np.maximum(n, m)
        return near if a.part is None else near & (a.part[i] != b.part[j])

    def in_runs(self, block: Block, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the near pairs inside the block's runs; short runs of one length all at once."""
        starts = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[(lengths > 1) & (lengths <= SMALL)]).tolist():
            i, j = np.triu_indices(length, 1)
            of, step = starts[lengths == length], max(1, 200_000 // len(i))
            for at in range(0, len(of), step):
                left, right = ((of[at:at + step, None] + x).ravel() for x in (i, j))
                near = self.near(block, left, block, right)
                yield left[near], right[near]
        for start, length in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist()):
            run = block.slice(start, start + length)
            for i, j in self.between(run, run):
                upper = i < j
                yield i[upper] + start, j[upper] + start

    def between(self, a: Block, b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the near pairs of two blocks."""
        for at in range(0, len(a.cls), 256):
            rows = np.arange(at, min(at + 256, len(a.cls)))[:, None]
            i, j = np.nonzero(self.near(a, rows, b, np.arange(len(b.cls))[None, :]))
            yield i + at, j


class Forest:
    """Classes joined so far; its edges lead to the smallest class of each tree, one for each class at most."""

    def __init__(self, cls: np.ndarray):
        self.cls = np.unique(cls)
        self.label = np.arange(len(self.cls))

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            merge(self.label, np.searchsorted(self.cls, u), np.searchsorted(self.cls, v))

    def joined(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.label[np.searchsorted(self.cls, u)] == self.label[np.searchsorted(self.cls, v)]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.cls)))
        return self.cls[moved], self.cls[self.label[moved]]


def candidate_forest(members: DataFrame, classes: DataFrame, hasher: MinHasher, threshold: tuple[int, int], margin: float) -> DataFrame:
    """Edges ``(u, v)`` that connect all classes which candidates connect; at most one for each class of a block."""
    rows = members.join(classes.select("cls", "n", "sig"), "cls")
    blocks = rows.groupBy("band", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "sig"))).alias("x"))
    pairs = blocks.where("blocks > 1").withColumn("other", F.explode(F.expr("sequence(block, blocks - 1)")))
    right = blocks.where("blocks > 1").select("band", F.col("block").alias("other"), F.col("x").alias("y"))
    pairs = pairs.join(right, ["band", "other"]).select("x", F.when(F.col("block") < F.col("other"), F.col("y")).alias("y"))
    units = blocks.where("blocks = 1").select("x", F.lit(None).cast(dict(blocks.dtypes)["x"]).alias("y"))
    units = units.unionByName(pairs.repartition(F.xxhash64("x")))

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        search = Candidates(hasher, threshold, margin)
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            alone = pc.is_null(y)
            runs = x.filter(alone)
            block = Block.of(runs.flatten())
            forest = Forest(np.concatenate([block.cls, *(c.flatten().field("cls").to_numpy() for c in (x, y))]))
            for i, j in search.in_runs(block, pc.list_value_length(runs).to_numpy()):
                forest.join(block.cls[i], block.cls[j])
            for n in np.flatnonzero(~alone.to_numpy(zero_copy_only=False)).tolist():
                left, right = (Block.of(c.slice(n, 1).flatten()) for c in (x, y))
                for i, j in search.between(left, right):
                    forest.join(left.cls[i], right.cls[j])
            u, v = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return units.mapInArrow(meet, "u long, v long").distinct()


def class_sets(docs: DataFrame, text_col: str, wanted: DataFrame, k: int) -> DataFrame:
    """``(cls, n, s)``: the full sets of the classes in ``wanted (cls, rep)``, from one text of each."""
    texts = docs.select(*text_hash(text_col), F.col(text_col).cast("binary").alias("t")).dropDuplicates(PAIR)
    rows = texts.join(wanted.select("cls", "rep.*"), PAIR).select("cls", "t")

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.sort(shingle_set(t.as_py(), k).view(np.int64)) for t in part.column("t")]
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([len(x) for x in found], pa.int64()),
                                                  pa.array(found, pa.list_(pa.int64()))], ["cls", "n", "s"])

    return rows.mapInArrow(gather, "cls long, n long, s array<long>")


def units_of(sets: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(place, p, q, part, cls, root, n, sig, hashes)``: the classes of each unit in which sets are compared.

    Classes of one cluster lie in one slot or, if their sets have more than
    ``SLOT_SHINGLES`` hashes together, in several, any two of which meet in a
    unit; slots hold many small clusters. So no task gathers a large cluster,
    and a set travels to as many units as its cluster has slots.
    """
    rows = sets.join(clusters.select(F.col("node").alias("cls"), "root"), "cls")
    sizes = materialize(rows.groupBy("root").agg(F.sum("n").alias("size")), "minhash-clusters")
    slots = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // SLOT_SHINGLES))
    rows = rows.join(sizes.select("root", F.ceil(F.col("size") / SLOT_SHINGLES).cast("long").alias("parts")), "root")
    rows = rows.join(classes.select("cls", "sig"), "cls").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    return rows.select(F.pmod(F.xxhash64("root"), F.lit(slots)).alias("place"), F.least("part", "other").alias("p"),
                       F.greatest("part", "other").alias("q"), "part", "cls", "root", "n", "sig", F.col("s").alias("hashes"))


def common_sizes(values: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets ``i`` and ``j`` (by place; ``values[ends[k]:ends[k + 1]]``) share, for sorted ``i``."""
    kept, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # hashes that only one set holds are in no intersection
    shared = count[inverse] > 1
    width = -(-max(1, int((count > 1).sum())) // 64)
    bits = np.zeros((len(ends) - 1, width), np.uint64)
    row, bit = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[shared], number[inverse[shared]]
    np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    out = np.empty(len(i), np.int64)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
        out[at:to] = np.bitwise_count(bits[i[at]] & bits[j[at:to]]).sum(axis=1, dtype=np.int64)
    return out


def confirmed(units: DataFrame, hasher: MinHasher, threshold: tuple[int, int], margin: float) -> DataFrame:
    """Edges ``(u, v)`` that connect all classes which links connect: candidates whose full sets reach the threshold."""
    over, under = threshold

    def confirm(rows):
        import pyarrow as pa

        rows = rows.sort_by([("root", "ascending"), ("cls", "ascending")]).combine_chunks()
        cls, root, n = (rows[c].to_numpy() for c in ("cls", "root", "n"))
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u8").reshape(len(cls), -1)
        block = Block(cls, n, sig, rows["part"].to_numpy() if rows["p"][0] != rows["q"][0] else None)
        lists = rows["hashes"].chunk(0)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        borders = np.append(np.flatnonzero(np.diff(root, prepend=root[0] - 1)), len(root))
        forest, search = Forest(cls), Candidates(hasher, threshold, margin)
        for start, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
            run = block.slice(start, end)
            for i, j in search.in_runs(run, np.array([end - start])):
                open_ = ~forest.joined(run.cls[i], run.cls[j])
                i, j = i[open_], j[open_]
                if len(i):
                    order = np.lexsort((j, i))
                    i, j = i[order], j[order]
                    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                    own = [values[ends[start + k]:ends[start + k + 1]] for k in used.tolist()]
                    common = common_sizes(np.concatenate(own), np.cumsum([0, *map(len, own)]), place[:len(i)], place[len(i):])
                    linked = under * common >= over * (run.n[i] + run.n[j] - common)
                    forest.join(run.cls[i[linked]], run.cls[j[linked]])
        u, v = forest.edges()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return units.groupBy("place", "p", "q").applyInArrow(confirm, "u long, v long")


# ------------------------------------------------------------------ components

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100),
                    hasher: MinHasher | None = None, margin: float = 5.5) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row; documents are linked from a similarity of ``threshold`` (a fraction) on."""
    need(docs, (id_col, text_col))
    hasher = hasher or MinHasher()
    prints = materialize(signatures(docs, id_col, text_col, k, hasher), "minhash-prints")
    classes = prints.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("low"), F.min(F.struct(*PAIR)).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "minhash-classes")
    members = materialize(band_members(classes), "minhash-bands")
    clusters = materialize(connected_components(candidate_forest(members, classes, hasher, threshold, margin)), "minhash-clustered")
    wanted = classes.select("cls", "rep").join(clusters.select(F.col("node").alias("cls")), "cls")
    sets = materialize(class_sets(docs, text_col, wanted, k), "minhash-sets")
    roots = connected_components(confirmed(units_of(sets, classes, clusters), hasher, threshold, margin))
    member = classes.select("key", "cls", "low").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    member = member.select("key", "low", F.coalesce("root", "cls").alias("root"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    lowest = materialize(member.join(lowest, "root").select("key", "component_id"), "minhash-members")
    discard(members)
    out = prints.select("id", "n", "key").join(lowest, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
