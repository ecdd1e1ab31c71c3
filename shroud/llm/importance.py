"""Target-distribution importance resampling over hashed n-grams.

Texts stay UTF-8 bytes: a 256-byte table lower-cases ``A-Z`` and blanks every
other ASCII byte that is no digit or letter, ``bytes.split`` yields the words,
and an n-gram's checksum is its first words' checksum carried on over the next
word (``zlib.crc32`` with the former value as seed). Counters reduce the
features of a task to at most ``buckets`` numbers; Spark adds those up over the
corpus and the target texts, and a second narrow pass weighs every document by
the ratio of both distributions. The highest scores are drawn by a range
partitioning on (score, id) and the counts of its ranges, so no task ranks all
documents.

Null and empty texts have no words and weight 0. A null id counts as the empty
text in the hash and stands after all other ids in ties; rows that repeat an id
and text score alike and take neighbouring ranks. An empty corpus gives no
rows, an empty target counts as no features. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import chain
from typing import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, need

BUCKETS = 10_000
CHUNK_BYTES = 1 << 22
#: Digits, letters in lower case and all bytes of longer characters stay; the rest become blanks.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` in lists of bounded size (cut where no word is)."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            gap = _BREAK.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].translate(TABLE).split()
        at = end


def feature_chunks(text: bytes, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, checksums)`` of each chunk: all runs of 1 to ``order`` words that end in it."""
    tails: list[list[int]] = [[] for _ in range(order)]  # checksums of the runs that end at the last word, by length
    for words in word_chunks(text):
        if not words:
            continue
        runs = list(map(zlib.crc32, words))
        found, after, last = [runs], [b" " + w for w in words], [runs[-1:]]
        for length in range(1, order):
            before = tails[length - 1] + runs[:-1]
            runs = list(map(zlib.crc32, after[len(words) - len(before):], before))
            found.append(runs)
            last.append(runs[-1:])
        tails = last
        yield len(words), np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))


def _batches(column) -> Iterable[bytes]:
    return (t or b"" for t in column.to_pylist())


def bucket_counts(texts: DataFrame, text_col: str, order: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket; each task sends at most ``buckets`` rows."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in _batches(batch.column(0)):
                for _, sums in feature_chunks(text, order):
                    total.update((sums % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())],
                                         ["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths: the logarithm of the smoothed ratio of its shares, floored.

    Both tables have at most ``buckets`` rows, so both reach the driver.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, frame in ((s, corpus), (t, target)):
        for row in frame.collect():
            counts[row["bucket"]] = row["n"]
    total_s, total_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    ratio = lambda n, m: ((n + 1.0) * total_s) / ((m + 1.0) * total_t)
    return np.array([math.floor(1000 * math.log(ratio(float(n), float(m)))) for n, m in zip(t, s)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, order: int = 2) -> DataFrame:
    """``(id, n_words, n_features, weight)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = dict(rows.dtypes)["id"]

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words, features, weights = [], [], []
            for text in _batches(batch.column("t")):
                n_words = n = total = 0
                for k, sums in feature_chunks(text, order):
                    n_words, n, total = n_words + k, n + len(sums), total + int(gain[sums % len(gain)].sum())
                words.append(n_words)
                features.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (words, features, weights))],
                                             ["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, partitions: int) -> DataFrame:
    """``rows`` with ``rank``: 1 for the highest score, ties by smaller id.

    The range partitions are frozen by writing the table; a range's rank starts
    after the rows of the ranges before it (one row for each range).
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranges = rows.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id())
    ranges = materialize(ranges, "importance-ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn("place", place).join(F.broadcast(starts), "range").withColumn(
        "rank", (F.col("start") + F.col("place")).cast("long")).drop("range", "place", "start")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = 25, min_words: int = 20, seed: int = 7, order: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is null if it is not drawn.

    Drawn are the ``percent`` highest scores of the documents with at least
    ``min_words`` words: the mean gain plus Gumbel noise, which draws without
    replacement in proportion to the exponential of the gain.
    """
    need(docs, (id_col, text_col))
    need(target, (target_col,))
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_col, order, buckets), buckets)
    scored = weighed(docs, gain, id_col, text_col, order).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = materialize(scored, "importance-scored")
    able = scored.where(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = ranked(able, partitions).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
