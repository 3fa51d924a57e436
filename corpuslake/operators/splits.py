"""Jobs that walk files in their order, with a state that is carried from split to split.

Some rules are sequential: whether a row opens a new pack, or whether a brace is inside a string, depends on everything
before it. Such a rule runs in three steps. Every split is summed up by what it does to any state that may reach it; the
summaries, one row per split, are composed in order; then every split is walked again from its own start state. Both
walks read the same files under the same settings, so they see the same splits, and a lost task repeats its split only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

MOST_SPLITS = 500_000  # start states (some hundred bytes each) that may be broadcast; more are joined by a shuffle

BLOCK, PLACE = "__block", "__place"


def with_block(scan: DataFrame) -> DataFrame:
    """A file scan with the start of each row's split in its file."""
    return scan.withColumn(BLOCK, F.col("_metadata.file_block_start"))


def with_states(rows: DataFrame, states: DataFrame, split: list[str], most: int = MOST_SPLITS) -> DataFrame:
    """The rows of a scan, still in file order, with the start state of their split.

    `split` names the columns that identify a split in both tables. A split without a state keeps null states.
    """
    states = cut_lineage(states, "split-states")
    if states.count() <= most:
        return rows.join(F.broadcast(states), split, "left")
    rows = rows.withColumn(PLACE, F.monotonically_increasing_id())  # grows inside a split
    return rows.join(states.hint("merge"), split, "left").repartition(*split).sortWithinPartitions(*split, PLACE).drop(PLACE)
