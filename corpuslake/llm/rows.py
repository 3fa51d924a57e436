"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of an ordered numbering should hold. More rows mean more buckets, never larger ones.
ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 64


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def draw(seed: str, key: str = "doc_id", text: str = "text") -> Column:
    """MD5 of seed, key and text as 32 hex digits: a random order that reruns and other engines reproduce.

    The text takes part so that rows whose key is null or repeated still get numbers of their own.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(seed), name, F.md5(F.encode(text_of(text), "UTF-8"))))


def unit(digest: Column) -> Column:
    """The first 48 bits of a digest as a number strictly between 0 and 1."""
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def bucket_of(fraction: Column, buckets: int) -> Column:
    """The equal-width bucket of a number from 0 to 1."""
    return F.least(F.floor(fraction * F.lit(buckets)), F.lit(buckets - 1)).cast("bigint")


def before(counts: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over all earlier buckets; one row per bucket, so the window stays small."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0).cast("bigint")))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def replacing(columns: list[str], added: list[str]) -> list[str]:
    """Input columns that stay: an output column takes the place of an input column of the same name."""
    taken = {name.lower() for name in added}
    return [c for c in columns if c.lower() not in taken]
