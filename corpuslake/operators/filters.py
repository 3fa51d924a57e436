"""Row filters: language and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import col, is_likely_english

# Shortest accepted text per kind of source, as (length, inclusive).
MIN_LENGTH = {
    "loader": {"finance": (20, False), "ecommerce": (50, False), "generic": (100, False),
               "wiki": (100, True), "cache": (20, False), "chunk": (200, False)},
    "tokenizer": {"finance": (20, True), "ecommerce": (50, False), "generic": (100, True),
                  "wiki": (100, True), "cache": (1, True), "chunk": (200, True)},
}


def filter_english(df: DataFrame, text: str = "text", min_ascii_ratio: float = 0.85, head: int | None = None) -> DataFrame:
    return df.where(is_likely_english(text, min_ascii_ratio, head))


def long_enough(text: Column | str, kind: str, variant: str = "loader") -> Column:
    limit, inclusive = MIN_LENGTH[variant][kind]
    return F.length(col(text)) >= limit if inclusive else F.length(col(text)) > limit


def long_enough_by_kind(text: Column | str, kind: Column | str, variant: str = "loader") -> Column:
    """The same test where the kind of source is a column."""
    keep = F.lit(False)
    for name in MIN_LENGTH[variant]:
        keep = F.when(col(kind) == name, long_enough(text, name, variant)).otherwise(keep)
    return keep


def min_length(df: DataFrame, kind: str, variant: str = "loader", text: str = "text") -> DataFrame:
    return df.where(long_enough(text, kind, variant))
