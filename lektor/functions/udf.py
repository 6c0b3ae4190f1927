"""The few scalars that Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition of Unicode text."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def ratio(a: Column, b: Column, junk: bool = False) -> Column:
    """Ratcliff-Obershelp similarity; ``junk`` turns on the heuristic that ignores popular characters of long texts."""

    @F.pandas_udf(DoubleType())
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=junk).ratio() if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return apply(a, b)


def letter_counts(text: Column) -> Column:
    """How often each of a to z occurs, case aside, and last how many other characters there are."""
    low = F.lower(text)
    counts = [F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit(""))) for c in range(97, 123)]
    known = F.array(*counts)
    return F.concat(known, F.array(F.greatest(F.length(text) - F.aggregate(known, F.lit(0), lambda x, y: x + y), F.lit(0))))


def ratio_bound(a_counts: Column, a_length: Column, b_counts: Column, b_length: Column) -> Column:
    """An upper bound of ``ratio`` from the texts' letter counts, in the JVM: prefilter pairs with it."""
    shared = F.aggregate(F.zip_with(a_counts, b_counts, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return F.when(a_length + b_length == 0, 1.0).otherwise(2.0 * shared / (a_length + b_length))
