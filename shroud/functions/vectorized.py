"""Small Arrow-batched helpers (pandas UDFs) for the few steps Catalyst lacks.

Kept in a module without postponed annotations: pandas UDF type hints must
be real types.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("array<int>")
def exclusive_cumsum(arrays: pd.Series) -> pd.Series:
    """Exclusive prefix sums of each int array (null stays null)."""
    out = []
    for a in arrays:
        if a is None:
            out.append(None)
        else:
            v = np.asarray(a, dtype=np.int64)
            out.append((np.cumsum(v) - v).astype(np.int32))
    return pd.Series(out, dtype=object)


@F.pandas_udf("array<int>")
def first_occurrence_numbers(arrays: pd.Series) -> pd.Series:
    """For each string array, each element's number by first occurrence (null stays null)."""
    return pd.Series([None if a is None else pd.factorize(np.asarray(a, dtype=object))[0].astype(np.int32) for a in arrays],
                     dtype=object)


FINDINGS_DDL = "array<struct<start:int,end:int,category:string,value:string>>"


def detector_udf(fn, category=None):
    """Wrap ``fn(text) -> iterable of (start, end[, category])`` as a pandas UDF."""

    @F.pandas_udf(FINDINGS_DDL)
    def detect(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = []
            if isinstance(t, str) and t:
                for item in fn(t):
                    start, end = int(item[0]), int(item[1])
                    cat = item[2] if len(item) > 2 else category
                    found.append({"start": start, "end": end, "category": cat, "value": t[start:end]})
            out.append(found)
        return pd.Series(out, dtype=object)

    return detect
