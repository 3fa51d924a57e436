"""Epochs over rows that are numbered once.

A keyed bijection on row numbers takes the place of a sort: every epoch's order is an expression over the number, so a
new epoch, another world size or another seed moves no rows. The number is written as a place on a grid of about
sqrt(n) by sqrt(n); rounds shift the row by a hash of the column and the column by a hash of the row, each of which can
be undone. Grid places beyond n are walked through until a place below n follows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.hashing import seeded_hash
from corpuslake.operators.ordering import Order, with_index
from corpuslake.session import cut_lineage

ROUNDS = 6


def grid(total: int) -> tuple[int, int]:
    """Rows and columns of the smallest nearly square grid with `total` places; fewer than a row's worth are unused."""
    rows = math.isqrt(max(total - 1, 0)) + 1
    return rows, max(-(-total // rows), 1)


def _step(place: int, rows: int, columns: int, seed: int, epoch: int) -> int:
    row, column = divmod(place, columns)
    for k in range(ROUNDS):
        shift = int(hashlib.md5(f"{seed}|{epoch}|{k}|{row if k % 2 else column}".encode()).hexdigest()[:15], 16)
        row, column = (row, (column + shift) % columns) if k % 2 else ((row + shift) % rows, column)
    return row * columns + column


def longest_walk(total: int, seed: int, epoch: int) -> int:
    """Most steps that an unused place needs to a used one; there are at most about sqrt(total) unused places.

    Unused places that only lead to each other are never entered from a used one, and do not count.
    """
    rows, columns = grid(total)
    unused, longest = rows * columns - total, 0
    for place in range(total, total + unused):
        for steps in range(1, unused + 1):
            place = _step(place, rows, columns, seed, epoch)
            if place < total:
                longest = max(longest, steps)
                break
    return longest


def number_rows(df: DataFrame, order: Sequence[Order] = ("doc_id",), name: str = "idx", **kw) -> DataFrame:
    """The rows with their place in `order`, written once; any number of epochs can be read from them."""
    return cut_lineage(with_index(df, order, name, **kw), "numbered-rows")


def _moved(place: Column, rows: int, columns: int, seed: int, epoch: int) -> Column:
    """The grid place behind all rounds. The two parts change sides in every round, so an even number restores them."""
    def turn(parts: Column, k: Column) -> Column:
        size = F.when(k % 2 == 0, F.lit(rows)).otherwise(F.lit(columns)).cast("bigint")
        return F.array(parts[1], F.pmod(parts[0] + seeded_hash(seed, epoch, k, parts[1]), size))

    start = F.array(F.call_function("div", place, F.lit(columns).cast("bigint")), F.pmod(place, F.lit(columns).cast("bigint")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda parts: parts[0] * columns + parts[1])


def shuffled_place(numbered: DataFrame, total: int, seed: int, epoch: int, index: str = "idx", out: str = "place") -> DataFrame:
    """Adds the place of each of the `total` numbers in the epoch's order: a projection, without a shuffle.

    It is one expression of fixed size, so filters that Catalyst pushes below it do not grow with the rounds.
    """
    side = grid(total)

    def walk(place: Column, steps: Column) -> Column:
        return F.when((steps == 0) | (place >= total), _moved(place, *side, seed, epoch)).otherwise(place)

    steps = F.sequence(F.lit(0), F.lit(longest_walk(total, seed, epoch)))
    return numbered.withColumn(out, F.aggregate(steps, F.col(index).cast("bigint"), walk))


def epoch_places(numbered: DataFrame, total: int, world_size: int, epoch: int, seed: int, index: str = "idx",
                 drop_last: bool = False) -> DataFrame:
    """The epoch's order dealt out to ranks, all with the same number of rows; adds `rank` and `slot`.

    `total` is the number of rows, numbered from 0. The tail is dropped, or filled up by starting again from the first
    places of the order. An empty table stays empty.
    """
    even = total // world_size * world_size if drop_last else -(-total // world_size) * world_size
    rows = shuffled_place(numbered, total, seed, epoch, index, "__place")
    if even < total:
        rows = rows.where(F.col("__place") < even)
    if even > total:
        last = F.lit(even - 1).cast("bigint")
        rows = rows.withColumn("__place", F.explode(F.sequence(F.col("__place"), last, F.lit(total).cast("bigint"))))
    return rows.withColumn("rank", F.pmod("__place", F.lit(world_size)).cast("bigint")) \
        .withColumn("slot", F.expr(f"__place DIV {world_size}")).drop("__place")
