"""From raw documents to a capped, interleaved corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.ordering import with_rank
from corpuslake.operators.sampling import interleave_round_robin
from corpuslake.session import cut_lineage
from corpuslake.streaming.clean import clean_text


def build_corpus(documents: DataFrame, cap: int | None = None, kind: str = "generic", head: int | None = None, **kw) -> DataFrame:
    """Filter by language and length, chunk, cap per source (if asked for), interleave. Adds `position` and `n_chars`.

    The cleaned chunks are written once, so the regular expressions run once over the texts and the
    passes that count and rank read the key columns only. One ranking serves the cap and the mixing.
    """
    chunks = clean_text(documents.select("doc_id", "source", "text"), kind, head)
    chunks = cut_lineage(chunks.withColumn("n_chars", F.length("text")), "chunks")
    capped = with_rank(chunks, ["doc_id", "chunk_no"], ["source"], "place", limit=cap, **kw)
    return interleave_round_robin(capped, rank="place").drop("place")


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """Chunks, documents, characters, first and last position per source."""
    return corpus.groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_no") == 0).alias("documents"),
        F.sum("n_chars").cast("bigint").alias("chars"), F.min("position").alias("first_position"),
        F.max("position").alias("last_position"))
