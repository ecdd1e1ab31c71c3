"""Row and text identity by two 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sql import ident

PAIR = ["__h1", "__h2"]


def row_hash(df: DataFrame) -> list[Column]:
    """Hashes of all columns that can be hashed, and of which of them are null."""
    cols = [F.col(ident(c)) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    nulls = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *nulls).alias("__h1"), F.xxhash64(F.lit("second"), *nulls, *cols).alias("__h2")]


def text_hash(text: str) -> list[Column]:
    t = F.col(ident(text))
    return [F.xxhash64(t).alias("__h1"), F.xxhash64(F.lit("second"), t).alias("__h2")]
