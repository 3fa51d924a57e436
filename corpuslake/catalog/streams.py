"""Streaming runs to completion over the documents file; results are read back."""

from functools import partial

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import CORPUS_SQL, english_sql
from corpuslake.session import shared_dir
from corpuslake.streaming.clean import clean_text, drop_reason, read_counts, read_stream, stream_cap, stream_clean, stream_counts


def arriving(spark, sf):
    """The documents as a stream: three parts in the order of `doc_id`, each of as many files as its writing had tasks.

    A part is written when the run over the one before has ended, so every run of a query is one micro-batch of a part.
    """
    arrived, rows = shared_dir(spark, "arrived"), table(spark, sf, "documents")
    low, high = rows.agg(F.percentile_approx("doc_id", [1 / 3, 2 / 3]).alias("p")).first()["p"] or (0, 0)
    for part in (F.col("doc_id") < low, (F.col("doc_id") >= low) & (F.col("doc_id") < high), F.col("doc_id") >= high):
        rows.where(part).write.mode("append").parquet(arrived)
        yield read_stream(spark, arrived, rows.schema)


@query("stream_clean", f"""
  WITH {CORPUS_SQL} SELECT doc_id, source, chunk_no, length(text) AS n_chars FROM chunks""")
def _(spark, sf):
    out, state = shared_dir(spark, "clean"), shared_dir(spark, "clean-state")
    for rows in arriving(spark, sf):
        stream_clean(rows.select("doc_id", "source", "text"), out, state, partial(clean_text, head=500)).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("doc_id", "source", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("text").cast("bigint").alias("n_chars"))


@query("stream_counts", f"""
  SELECT source, CASE WHEN NOT {english_sql()} THEN 'not_english' WHEN length(text) <= 100 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n
  FROM documents GROUP BY ALL""")
def _(spark, sf):
    out, state = shared_dir(spark, "counts"), shared_dir(spark, "counts-state")
    for rows in arriving(spark, sf):
        stream_counts(rows, out, state).awaitTermination()
    return read_counts(spark, out)


@query("stream_cap", "SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY doc_id LIMIT 400")
def _(spark, sf):
    out, state = shared_dir(spark, "cap"), shared_dir(spark, "cap-state")
    for rows in arriving(spark, sf):
        stream_cap(rows.select("doc_id", "text"), 400, out, state).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
