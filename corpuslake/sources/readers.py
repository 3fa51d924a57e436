"""Readers of text corpora. Only the wanted columns reach the scan."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.operators.sampling import concat_sources, take_first
from corpuslake.session import shared_dir
from corpuslake.sources.arrays import read_json_records

log = logging.getLogger(__name__)

TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType())])
CACHE_NAMES = ("finance", "ecommerce", "generic")
INSTRUCTION_FIELDS = ("instruction", "input", "output", "context", "response")
PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())),
])


def read_first_available(spark: SparkSession, candidates: Sequence[tuple[str, str]], schema: T.StructType = TEXT_SCHEMA) -> DataFrame:
    """First `(path, format)` that opens; each failure is logged; none gives an empty table."""
    for path, fmt in candidates:
        try:
            return spark.read.format(fmt).load(path)
        except AnalysisException as error:
            log.warning("cannot open %s as %s: %s", path, fmt, error)
    return spark.createDataFrame([], schema)


def read_parquet_text(spark: SparkSession, path: str, cols: Sequence[str] = ("text",), limit: int | None = None,
                      order: str | None = None) -> DataFrame:
    """Text columns of a Parquet table without null or empty texts (first of `cols`)."""
    rows = spark.read.parquet(path).select(*cols)
    rows = rows.where(F.col(cols[0]).isNotNull() & (F.col(cols[0]) != ""))
    if limit is None:
        return rows
    if order is None:
        raise ValueError("a limit needs an order column to be reproducible")
    return take_first(rows, limit, [order])


def read_instruction_json(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """`.json` (an array) or `.jsonl` (a record per line); any other path is a Parquet table.

    Without `fields`, the columns that exist in the file are found by one inference pass, because
    the chat format chooses its columns by existence. Arrays are cut into records by many tasks; records that are not
    named by `fields` are then written as lines, so that inference and reading are split, too.
    """
    if not path.endswith((".json", ".jsonl")):
        return spark.read.parquet(path)
    schema = None if fields is None else T.StructType([T.StructField(f, T.StringType()) for f in fields])
    if path.endswith(".json"):
        records = read_json_records(spark, path)
        if schema is not None:
            return records.select(F.from_json("value", schema).alias("record")).select("record.*")
        if records.isEmpty():
            return spark.createDataFrame([], T.StructType())
        path = shared_dir(spark, "records")
        records.select(F.regexp_replace("value", "[\\r\\n]+", " ").alias("value")).write.text(path)
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.option("primitivesAsString", True).json(path)


def scan_cache_dir(spark: SparkSession, folder: str, names: Sequence[str] = CACHE_NAMES) -> DataFrame:
    """Texts of whichever of the named Parquet tables exist, with `source` and `source_rank`."""
    found = []
    for name in names:
        try:
            rows = spark.read.parquet(f"{folder}/{name}.parquet").select("text")
            found.append(rows.withColumn("source", F.lit(name)))
        except AnalysisException:
            log.info("no cached table %s in %s", name, folder)
    if not found:
        raise FileNotFoundError(f"no cached tables in {folder}")
    return concat_sources(*found)


def scan_page_dump(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet") -> DataFrame:
    """Pages with title, url, text and categories; missing columns read as null."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PAGE_SCHEMA).format(fmt).load(path)
