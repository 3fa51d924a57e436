"""Choosing and joining text fields, and formatting samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions.wordlists import QUERY_TEMPLATE
from corpuslake.operators.ordering import HOT_ROWS
from corpuslake.session import cut_lineage


def _present(df: DataFrame, fields: Sequence[str]) -> list[str]:
    found = [f for f in fields if f in df.columns]
    if not found:
        raise ValueError(f"none of the fields {list(fields)} is among {df.columns}")
    return found


def first_nonempty_field(df: DataFrame, fields: Sequence[str], out: str = "text", min_len: int | None = None) -> DataFrame:
    """First non-empty field; the length test looks at that field only."""
    rows = df.withColumn(out, tx.first_nonempty(*_present(df, fields))).where(F.col(out).isNotNull())
    return rows if min_len is None else rows.where(F.length(out) > min_len)


def first_long_field(df: DataFrame, fields: Sequence[str], min_len: int = 50, out: str = "text") -> DataFrame:
    """First field longer than `min_len`."""
    return df.withColumn(out, tx.first_long(_present(df, fields), min_len)).where(F.col(out).isNotNull())


def explode_long_fields(df: DataFrame, fields: Sequence[str], min_len: int = 50, out: str = "text") -> DataFrame:
    """One row per field longer than `min_len`, numbered in field order."""
    keep = [c for c in df.columns if c not in fields]
    values = tx.long_values(_present(df, fields), min_len)
    return df.select(*keep, F.posexplode(values).alias("field_no", out))


def concat_nonempty_fields(df: DataFrame, fields: Sequence[str] | None = None, out: str = "text") -> DataFrame:
    """All non-blank fields joined by a space, in schema order."""
    return df.withColumn(out, tx.concat_nonblank(_present(df, fields or df.columns)))


def _named(df: DataFrame, *names: str):
    return next((F.col(n) for n in names if n in df.columns), F.lit(""))


def format_instruction(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Chat text from instruction, context (or input) and response (or output).

    The column is chosen by its existence, not by its value; raw columns are dropped.
    """
    sample = tx.instruction_text(
        _named(df, "instruction"), _named(df, "context", "input"), _named(df, "response", "output"))
    return df.select(*keep, sample.alias("text"))


def format_query(df: DataFrame, template: str = QUERY_TEMPLATE, out: str = "query_text") -> DataFrame:
    if "instruction" not in df.columns:
        return df.withColumn(out, F.col("query"))
    return df.withColumn(out, tx.query_text("query", "instruction", template))


def contextualize(df: DataFrame, context: str = "chunk_context", content: str = "chunk_content",
                  sep: str = " ", out: str = "text") -> DataFrame:
    """Chunk text with its context in front."""
    return df.withColumn(out, F.concat_ws(sep, context, content))


def _with_neighbours(turns: DataFrame, *group: str) -> DataFrame:
    """The latest system text so far and the next turn, inside the group."""
    order = Window.partitionBy(*group).orderBy("turn")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    system = F.last(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True).over(so_far)
    return turns.select(*group, "turn", "role", F.col("text").alias("instruction"), system.alias("context"),
                        F.lead(F.struct("role", "text")).over(order).alias("next"))


def _long_conversations(turns: DataFrame) -> DataFrame:
    """The same for conversations of any length: ranges of turns are tasks, and know what lies at their borders."""
    spark = turns.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = turns.select("conv_id", "turn", "role", "text").repartitionByRange(tasks, "conv_id", "turn")
    ranged = cut_lineage(ranged.withColumn("__range", F.spark_partition_id()), "turn-ranges")
    told = (F.col("role") == "system") & F.col("text").isNotNull()
    edges = ranged.groupBy("conv_id", "__range").agg(
        F.min(F.struct("turn", "role", "text")).alias("first"), F.max(F.when(told, F.struct("turn", "text")))["text"].alias("system"))
    order = Window.partitionBy("conv_id").orderBy("__range")  # one row a range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = cut_lineage(edges.select(
        F.col("conv_id").alias("__conv"), F.col("__range").alias("__edge"), F.last("system", ignorenulls=True).over(before).alias("__system"),
        F.lead(F.struct("first.role", "first.text")).over(order).alias("__next")), "turn-edges")
    rows = _with_neighbours(ranged, "conv_id", "__range")
    rows = rows.join(edges, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__range") == F.col("__edge")))
    return rows.select("conv_id", "turn", "role", "instruction", F.coalesce("context", "__system").alias("context"),
                       F.coalesce("next", "__next").alias("next"))


def turns_to_samples(conversations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each user turn with the assistant turn that follows it; the system text is the context.

    A conversation of at most `hot_rows` turns is one group of a window. Longer ones are cut into ranges of turns; a
    range learns the latest system text before it and the turn behind it from one row per range. Turns with equal
    numbers follow each other in any order; a null conversation is one of its own.
    """
    sizes = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = cut_lineage(sizes.where(F.col("n") > hot_rows).select(F.col("conv_id").alias("__long")), "long-conversations")
    if long.isEmpty():
        rows = _with_neighbours(conversations, "conv_id")
    else:
        among = F.col("conv_id").eqNullSafe(F.col("__long"))
        rows = _with_neighbours(conversations.join(long, among, "left_anti"), "conv_id") \
            .unionByName(_long_conversations(conversations.join(long, among, "left_semi")))
    pairs = rows.where((F.col("role") == "user") & (F.col("next.role") == "assistant")).withColumn("response", F.col("next.text"))
    return format_instruction(pairs, keep=["conv_id", "turn"])
