"""Text functions that Spark has no built-in for: Ratcliff-Obershelp similarity and NFKC, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching share of two names, their letters and digits in lower case; null or empty names share nothing."""
    plain = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
    pairs = [(plain(x), plain(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in pairs], dtype="float64")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical(text: Column) -> Column:
    """NFKC, quotes and dashes folded, lower case, blanks collapsed. Pure ASCII never leaves the JVM."""
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.translate(F.when(ascii_only, text).otherwise(nfkc(F.when(~ascii_only, text))), "‘’“”–—‐", "''\"\"---")
    return F.trim(F.regexp_replace(F.lower(folded), r"\s+", " "))


def grounded(value: Column, source: Column, page: Column) -> Column:
    """Whether a page has the value, or its source text, after canonical()."""
    p = canonical(page)
    return F.contains(p, canonical(value)) | F.contains(p, canonical(source))
