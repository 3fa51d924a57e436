"""Overlapping chunks of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import explode_values
from corpuslake.operators.filters import MIN_LENGTH

CHUNK_ABOVE = 5_000  # only longer texts are cut


def chunk_text(
    df: DataFrame,
    variant: str = "loader",
    text: str = "text",
    size: int = 2_000,
    overlap: int = 500,
    min_len: int = 200,
    above: int = CHUNK_ABOVE,
) -> DataFrame:
    """One row per chunk: `size + overlap` characters every `size` characters.

    Adds `chunk_no`, `n_chunks` (before short tails are dropped) and `char_start`; a text that is
    not cut keeps its row as chunk 0. The loader keeps chunks longer than `min_len`, the tokenizer
    also those of exactly that length. Row-local: no shuffle.
    """
    inclusive = MIN_LENGTH[variant]["chunk"][1]
    body = F.col(text)
    cut = F.length(body) > F.lit(max(above, size + overlap))

    def piece(number: Column, start: Column, part: Column) -> Column:
        return F.struct(number.cast("int").alias("chunk_no"), start.cast("int").alias("char_start"), part.alias("part"))

    starts = F.sequence(F.lit(0), F.length(body) - 1, F.lit(size))
    pieces = F.transform(starts, lambda s, i: piece(i, s, F.substring(body, s + 1, F.lit(size + overlap))))
    whole = F.array(piece(F.lit(0), F.lit(0), body))
    rows = df.withColumn("n_chunks", F.when(cut, F.ceil(F.length(body) / size)).otherwise(F.lit(1)).cast("int"))
    others = [c for c in df.columns if c != text]
    # the long text itself ends here: only its pieces go through the generator
    rows = rows.select(*others, "n_chunks", F.when(cut, pieces).otherwise(whole).alias("__pieces"))
    rows = explode_values(rows, F.col("__pieces"), "__p", *others, "n_chunks")
    rows = rows.select(*[F.col("__p.part").alias(text) if c == text else c for c in df.columns],
                       "n_chunks", F.col("__p.chunk_no").alias("chunk_no"), F.col("__p.char_start").alias("char_start"))
    enough = F.length(text) >= min_len if inclusive else F.length(text) > min_len
    return rows.where((F.col("n_chunks") == 1) | enough)
