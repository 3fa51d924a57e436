"""Writers. Every write is a distributed job; nothing is buffered on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.text import page_url
from corpuslake.operators.entities import filter_entity_pages
from corpuslake.operators.ordering import Order, with_index
from corpuslake.operators.sampling import take_first

ESCAPES = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))  # undone in reverse order


def write_corpus(df: DataFrame, path: str, text: str = "text", max_records_per_file: int = 2_000_000) -> None:
    """Single `text` column, Snappy Parquet."""
    (df.select(F.col(text).alias("text")).write.mode("overwrite")
     .option("compression", "snappy").option("maxRecordsPerFile", max_records_per_file).parquet(path))


def stored_rows(spark: SparkSession, path: str) -> int | None:
    """Row count of a finished Parquet table (reads no column data), or None."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").select("path").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:  # a finished job that wrote no file
        return 0


def materialize_once(spark: SparkSession, make: Callable[[], DataFrame], path: str, force: bool = False) -> int:
    """Write the table unless a finished copy exists; returns its row count."""
    rows = None if force else stored_rows(spark, path)
    if rows is None:
        make().write.mode("overwrite").option("compression", "snappy").parquet(path)
        rows = stored_rows(spark, path)
    return rows


def write_text_shards(df: DataFrame, folder: str, shard_size: int = 100_000, text: str = "text",
                      order: Sequence[Order] = ()) -> None:
    """One record per line in files of at most `shard_size` records.

    With `order` shard k is the folder `shard=k` with exactly `shard_size` records, only the last one may be short.

    Line breaks inside a record are written as backslash escapes, so that a record stays one line
    and `read_text_shards` returns exactly what was written.
    """
    line = F.col(text)
    for raw, escaped in ESCAPES:
        line = F.replace(line, F.lit(raw), F.lit(escaped))
    if not order:
        df.select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", shard_size).text(folder)
        return
    numbered = with_index(df, order, "__idx").select(line.alias("value"), F.floor(F.col("__idx") / shard_size).cast("bigint").alias("shard"))
    # the rows are in order already; a hash of the shard only brings its rows together
    numbered.repartition("shard").write.mode("overwrite").partitionBy("shard").text(folder)


def read_text_shards(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("value")
    for raw, escaped in reversed(ESCAPES):
        line = F.replace(line, F.lit(escaped), F.lit(raw))
    rows = spark.read.text(folder)
    return rows.select(line.alias("text"), *[F.col("shard").cast("bigint")] * ("shard" in rows.columns))


def extract_entities(pages: DataFrame, path: str, max_pages: int | None = None, force: bool = False, order: str = "doc_id",
                     head: int | None = None, tail: int | None = None) -> int:
    """Company pages as `title, url, text`, all or at most `max_pages`; an existing result of the same arguments is kept.

    The arguments are a column of the result's companion table `path-arguments`; a result that was made with others is
    made again.
    """
    def make() -> DataFrame:
        kept = take_first(filter_entity_pages(pages, head=head, tail=tail), max_pages, [order])
        url = F.col("url") if "url" in kept.columns else None
        return kept.select("title", page_url("title", url).alias("url"), "text")

    spark, noted, arguments = pages.sparkSession, f"{path}-arguments", repr((max_pages, order, head, tail))
    known = stored_rows(spark, noted) and spark.read.parquet(noted).first()["arguments"]
    rows = materialize_once(spark, make, path, force or known != arguments)
    spark.createDataFrame([(arguments,)], "arguments string").write.mode("overwrite").parquet(noted)
    return rows
