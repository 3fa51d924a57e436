"""Exact positions inside groups of any size.

`row_number` over a group sorts the whole group in one task. That is right for ordinary groups and wrong for one
that holds a third of the table. Groups are counted first. If one exceeds `HOT_ROWS`, or if the whole table is one
group, the rows are range-partitioned and sorted by group and order, written once with their place in the
partition, and numbered by adding the rows of the partitions before; the rank in a group is that number minus the
number of the group's first row. This works for every type that Spark can sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

HOT_ROWS = 250_000          # rows of one group that one task may sort

Order = str | tuple[str, str]


def sort_columns(order: Sequence[Order]) -> list[Column]:
    pairs = [(o, "asc") if isinstance(o, str) else o for o in order]
    return [F.col(n).desc_nulls_last() if direction == "desc" else F.col(n).asc_nulls_first() for n, direction in pairs]


def _window_rank(df: DataFrame, by: list[str], order: Sequence[Order], name: str, limit: int | None) -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*sort_columns(order))))
    if limit is not None:
        ranked = ranked.where(F.col(name) <= limit)  # becomes a map-side WindowGroupLimit
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def _numbered(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """0-based position of every row in the order of `columns`: one range shuffle, written once."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # counts the rows of a partition in their order
    rows = cut_lineage(rows.withColumn("__rank_part", F.spark_partition_id()).withColumn("__rank_place", place), "numbered")
    sizes = rows.groupBy("__rank_part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__rank_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select(F.col("__rank_part").alias("__rank_p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rank_before"))
    sizes = cut_lineage(sizes, "numbered-sizes")  # of known size
    return rows.join(sizes, F.col("__rank_part") == F.col("__rank_p")).withColumn(name, F.col("__rank_before") + F.col("__rank_place")) \
        .drop("__rank_part", "__rank_place", "__rank_p", "__rank_before")


def with_rank(
    df: DataFrame,
    order: Sequence[Order],
    by: Sequence[str] = (),
    name: str = "rank",
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row in `order` within `by`; `limit` keeps the first rows.

    `order` should end in a unique key, so that the result does not depend on partitioning. Nulls come first in
    ascending order and last in descending order; a null in `by` is a group of its own. Groups that are `bounded` by
    an earlier limit are not counted.
    """
    by = list(by)
    if bounded and by:
        return _window_rank(df, by, order, name, limit)
    if by:
        largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if (largest or 0) <= hot_rows:
            return _window_rank(df, by, order, name, limit)
    rows = _numbered(df, [F.col(c).asc_nulls_first() for c in by] + sort_columns(order), "__rank_index")
    if by:
        firsts = rows.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.min("__rank_index").alias("__rank_first"))
        on = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
        rows = rows.join(cut_lineage(firsts, "group-firsts"), on).drop(*[f"__by{i}" for i in range(len(by))])
    else:
        rows = rows.withColumn("__rank_first", F.lit(0))
    rows = rows.withColumn(name, F.col("__rank_index") - F.col("__rank_first") + 1).drop("__rank_index", "__rank_first")
    return rows.where(F.col(name) <= limit) if limit is not None else rows


def with_index(df: DataFrame, order: Sequence[Order], name: str = "idx", **kw) -> DataFrame:
    """0-based position of each row of the whole table."""
    return with_rank(df, order, (), name, **kw).withColumn(name, F.col(name) - 1)
