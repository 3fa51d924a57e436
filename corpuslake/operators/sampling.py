"""Caps, mixing, shuffling and sharding with fixed keys and seeds.

Nothing here depends on arrival order, partition ids or `rand`: "first" means first by a key,
"random" means ordered by a seeded hash of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.hashing import seeded_hash
from corpuslake.operators.ordering import Order, sort_columns, with_index, with_rank
from corpuslake.session import cut_lineage

HEAD_ROWS = 100_000  # first rows that one task may merge


def cap_per_source(df: DataFrame, n: int, order: Sequence[Order] = ("doc_id",), source: str = "source", **kw) -> DataFrame:
    """First n rows of each source, counted after filters and chunking."""
    return with_rank(df, order, [source], "__rank", limit=n, **kw).drop("__rank")


def cap_scanned(df: DataFrame, n: int, keep, order: Sequence[Order] = ("doc_id",), source: str = "source", **kw) -> DataFrame:
    """First n rows read from each source, of which those passing `keep` stay."""
    return cap_per_source(df, n, order, source, **kw).where(keep)


def debug_sample(df: DataFrame, n: int | None = None, **kw) -> DataFrame:
    """First n rows of each source; everything unless n is given."""
    return df if n is None else cap_per_source(df, n, **kw)


def take_first(df: DataFrame, n: int | None, order: Sequence[Order] = ("doc_id",), **kw) -> DataFrame:
    """First n rows of the table, before any projection; everything if n is None."""
    return df if n is None else first_rows(df, n, order, **kw)


def first_rows(df: DataFrame, n: int, order: Sequence[Order], **kw) -> DataFrame:
    """The first n rows in `order`, in no particular one.

    Up to `HEAD_ROWS` rows, every task keeps its own first n and one task merges those, so nothing else moves. More
    rows are found by numbering the whole table.
    """
    if n <= HEAD_ROWS:
        return df.orderBy(*sort_columns(order)).limit(n)
    return with_rank(df, order, (), "__rank", limit=n, **kw).drop("__rank")


def _running_totals(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Rows in all earlier sources; the window runs over one row per source."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum(size).over(before), F.lit(0)))


def oversample_cap(df: DataFrame, n: int, rank: str = "source_rank", order: Sequence[Order] = ("doc_id",), **kw) -> DataFrame:
    """Up to 2n rows per source in source order, no further source once n are reached, then the first n.

    Adds `position`. A source is skipped exactly when the sources before it already hold n rows.
    """
    sizes = df.groupBy(rank).agg(F.least(F.count(F.lit(1)), F.lit(2 * n)).alias("__n"))
    totals = _running_totals(sizes, rank, "__n").where(F.col("__before") < n).select(F.col(rank).alias("__r"), "__before")
    totals = cut_lineage(totals, "source-totals")  # one row per source, of known size
    wanted = df.join(totals, F.col(rank) == F.col("__r")).drop("__r")
    ranked = with_rank(wanted, order, [rank], "__rank", limit=n, **kw)
    ranked = ranked.withColumn("position", F.col("__before") + F.col("__rank"))
    return ranked.where(F.col("position") <= n).drop("__before", "__rank")


def concat_sources(*frames: DataFrame) -> DataFrame:
    """All sources one after the other; `source_rank` holds the order."""
    ranked = [f.withColumn("source_rank", F.lit(i).cast("bigint")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def interleave_round_robin(df: DataFrame, order: Sequence[Order] = ("doc_id",), source: str = "source",
                           sources: Sequence[str] | None = None, rank: str | None = None, **kw) -> DataFrame:
    """One row from each source in turn; a source that runs out is skipped. Adds 0-based `position`.

    `rank` names a column that already holds the place of each row in its source. The sources take turns in the order
    of `sources`; those that are not listed follow by name, a null source comes last. No row is left out.

    The r-th rows of all sources follow the rows before them, so the position is the place in the order of rank and
    turn: a range-partitioned numbering, whatever the number of sources and their sizes.
    """
    ranked = with_rank(df, order, [source], "__rank", **kw) if rank is None else df.withColumn("__rank", F.col(rank))
    listed = F.lit(None).cast("int")
    for turn, name in reversed(list(enumerate(sources or ()))):
        listed = F.when(F.col(source) == name, turn).otherwise(listed)
    ranked = ranked.withColumn("__listed", F.coalesce(listed, F.lit(len(sources or ())))).withColumn("__none", F.col(source).isNull())
    placed = with_index(ranked, ["__rank", "__listed", "__none", source], "position")
    return placed.drop("__rank", "__listed", "__none")


def shuffle_global(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """The table in a seeded random order (a range-partitioned sort by hash)."""
    return df.withColumn("shuffle_key", seeded_hash(seed, F.col(key))).orderBy("shuffle_key", key)


def shuffle_blocks(df: DataFrame, seed: int, block: int = 500_000, order: Sequence[Order] = ("doc_id",),
                   key: str = "doc_id", **kw) -> DataFrame:
    """Shuffle inside fixed blocks of consecutive rows; adds `block` and the new `position`."""
    rows = with_index(df, order, "__idx", **kw)
    rows = rows.withColumn("block", F.floor(F.col("__idx") / block).cast("bigint"))
    rows = rows.withColumn("__hash", seeded_hash(seed, F.col(key)))
    rows = with_rank(rows, ["__hash", key], ["block"], "__rank", bounded=True)  # a block holds `block` rows
    return rows.withColumn("position", F.col("block") * block + F.col("__rank") - 1).drop("__idx", "__hash", "__rank")


def assign_shards(df: DataFrame, num_workers: int, order: Sequence[Order] = ("doc_id",), **kw) -> DataFrame:
    """Worker of each row: row index modulo the number of workers."""
    rows = with_index(df, order, "__idx", **kw)
    return rows.withColumn("shard", F.pmod(F.col("__idx"), F.lit(num_workers)).cast("bigint")).drop("__idx")


def shard(df: DataFrame, num_workers: int, worker_id: int, **kw) -> DataFrame:
    return assign_shards(df, num_workers, **kw).where(F.col("shard") == worker_id).drop("shard")


def epoch_split(df: DataFrame, world_size: int, epoch: int, seed: int, key: str = "doc_id",
                drop_last: bool = False, **kw) -> DataFrame:
    """Per-epoch permutation dealt out to ranks; all ranks get the same number of rows.

    The tail is dropped, or filled up by starting again from the first rows. Adds `rank` and `slot`.
    """
    rows = df.withColumn("__hash", seeded_hash(seed, epoch, F.col(key)))
    rows = with_index(rows, ["__hash", key], "__idx", **kw)
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if total == 0:
        return rows.withColumn("rank", F.lit(0).cast("bigint")).withColumn("slot", F.lit(0).cast("bigint")).drop("__idx", "__hash")
    even = total // world_size * world_size if drop_last else -(-total // world_size) * world_size
    rows = rows.where(F.col("__idx") < even)
    places = F.sequence(F.col("__idx"), F.lit(even - 1).cast("bigint"), F.lit(total).cast("bigint"))
    rows = rows.withColumn("__place", F.explode(places))
    return (
        rows.withColumn("rank", F.pmod("__place", F.lit(world_size)).cast("bigint"))
        .withColumn("slot", F.floor(F.col("__place") / world_size).cast("bigint"))
        .drop("__idx", "__hash", "__place")
    )


def mix_by_ratio(a: DataFrame, b: DataFrame, share: float, seed: int, key: str = "doc_id", **kw) -> DataFrame:
    """All of `a` plus as many rows of `b`, picked by hash, as make `b` the given share of the result."""
    n_a = a.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n_b = int(share / (1 - share) * n_a + 0.5)
    picked = b.withColumn("__hash", seeded_hash(seed, F.col(key)))
    picked = first_rows(picked, n_b, ["__hash", key], **kw).drop("__hash")
    return a.withColumn("part", F.lit("a")).unionByName(picked.withColumn("part", F.lit("b")))
