"""The cleaning plan over arriving files.

The same stateless operators as the batch form; the file source and the checkpoint make an
interrupted run continue where it stopped, which replaces periodic saves and signal handlers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpuslake.functions.text import is_likely_english
from corpuslake.operators.chunking import chunk_text
from corpuslake.operators.entities import KEEP_REASONS, entity_rule
from corpuslake.operators.filters import filter_english, min_length
from corpuslake.operators.sampling import first_rows


def clean_text(rows: DataFrame, kind: str = "generic", head: int | None = None) -> DataFrame:
    """Language, length and chunking; works on batch and streaming tables alike."""
    return chunk_text(min_length(filter_english(rows, head=head), kind))


def read_stream(spark: SparkSession, in_dir: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(in_dir)


def stream_clean(rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = clean_text) -> StreamingQuery:
    """Start a run over everything that has arrived; a Parquet sink, exactly once per file."""
    return (transform(rows).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))


def drop_reason(rows: DataFrame, min_chars: int = 100) -> DataFrame:
    """Why a document would be left out by `clean_text`, or kept; the whole text is looked at."""
    text = F.col("text")
    reason = F.when(~is_likely_english(text), "not_english").when(F.length(text) <= min_chars, "short").otherwise("kept")
    return rows.withColumn("reason", reason)


def page_reason(rows: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    rows = rows.withColumn("reason", entity_rule(F.col("title"), F.col("text"), head=head, tail=tail))
    return rows.withColumn("reason", F.when(F.col("reason").isin(*KEEP_REASONS), "kept").otherwise(F.col("reason")))


def _carried(spark: SparkSession, path: str, schema: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """What the last micro-batch (before a given one) left in `path`, and the slot that the next one may overwrite.

    Two slots take turns, so there are as many files after a thousand batches as after two. A batch that is repeated
    finds the slot of the batch before it untouched and overwrites its own.
    """
    try:
        found = spark.read.schema(f"{schema}, slot int, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0
    earlier = found if before is None else found.where(F.col("batch") < before)
    last = earlier.agg(F.max(F.struct("batch", "slot")).alias("last")).first()["last"]
    if last is None:
        return None, 0
    return found.where((F.col("batch") == last["batch"]) & (F.col("slot") == last["slot"])).drop("slot", "batch"), 1 - last["slot"]


def _leave(rows: DataFrame, path: str, slot: int, batch_id: int) -> None:
    rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.partitionBy("batch").option("partitionOverwriteMode", "static") \
        .mode("overwrite").parquet(f"{path}/slot={slot}")


def _counts_schema(by: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` string" for c in by) + ", n bigint"


def stream_counts(rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = drop_reason,
                  by: tuple[str, ...] = ("source", "reason")) -> StreamingQuery:
    """Rows per source and reason, as text; `read_counts` reads the totals.

    Every micro-batch adds its counts to the totals of the batch before, so files and work per batch grow with the
    number of groups only, and a repeated batch counts once. Nothing is gathered on the driver.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = transform(batch).groupBy(*[F.col(c).cast("string").alias(c) for c in by]).agg(F.count(F.lit(1)).alias("n"))
        before, slot = _carried(rows.sparkSession, out, _counts_schema(by), batch_id)
        if before is not None:
            counts = before.unionByName(counts).groupBy(*by).agg(F.sum("n").alias("n"))
        _leave(counts, out, slot, batch_id)

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_counts(spark: SparkSession, out: str, by: tuple[str, ...] = ("source", "reason")) -> DataFrame:
    """Totals over all micro-batches of `stream_counts`."""
    found, _ = _carried(spark, out, _counts_schema(by))
    return found if found is not None else spark.createDataFrame([], _counts_schema(by))


def stream_cap(rows: DataFrame, n: int, out: str, checkpoint: str, order: str = "doc_id") -> StreamingQuery:
    """First n rows overall: batches in arrival order, inside a batch by `order`.

    Each micro-batch writes its rows to `out/batch=i` and the running total to a slot of `out-total`. It starts from the
    total of the batch before, so a repeated batch overwrites itself and the total stays exact. The rows that are kept
    are never counted again, and batches after the n-th row read that total and write nothing.
    """
    spark, totals = rows.sparkSession, f"{out}-total"

    def write(batch: DataFrame, batch_id: int) -> None:
        before, slot = _carried(spark, totals, "total bigint", batch_id)
        stored = 0 if before is None else before.first()["total"]
        if stored < n:
            first = first_rows(batch, n - stored, [order])
            path = f"{out}/batch={batch_id}"
            first.write.mode("overwrite").parquet(path)
            stored += spark.read.schema(first.schema).parquet(path).count()
            _leave(spark.createDataFrame([(stored,)], "total bigint"), totals, slot, batch_id)

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
