"""Sources and sinks."""

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import WIKI_SQL, reason_sql, wiki_pages
from corpuslake.operators.fields import format_instruction
from corpuslake.session import shared_dir
from corpuslake.sources.arrays import write_json_array
from corpuslake.sources.readers import (
    read_first_available, read_instruction_json, read_parquet_text, scan_cache_dir, scan_page_dump)
from corpuslake.sources.writers import (
    extract_entities, materialize_once, read_text_shards, write_corpus, write_text_shards)

def n_chars():
    return F.length("text").cast("bigint").alias("n_chars")


@query("read_first_available", "SELECT item_id, length(text) AS n_chars FROM benchmark")
def _(spark, sf):
    options = [(f"{sf}/absent.parquet", "parquet"), (f"{sf}/benchmark.parquet", "parquet")]
    return read_first_available(spark, options).select("item_id", n_chars())


@query("read_parquet_text", "SELECT doc_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(spark, sf):
    return read_parquet_text(spark, f"{sf}/documents.parquet", ["text", "doc_id"]).select("doc_id", n_chars())


@query("read_instruction_json", """
  SELECT conv_id, turn, '<s>[INST] ' || trim(text, chr(32)||chr(9)||chr(10)||chr(13)) || ' [/INST]  </s>' AS text FROM conversations""")
def _(spark, sf):
    path = shared_dir(spark, "instructions") + ".jsonl"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("instruction"))
    turns.write.json(path)
    rows = read_instruction_json(spark, path, ["conv_id", "turn", "instruction"])
    return format_instruction(rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "instruction"),
        keep=["conv_id", "turn"])


@query("read_instruction_array", """
  SELECT conv_id, turn, '<s>[INST] ' || trim(text, chr(32)||chr(9)||chr(10)||chr(13)) || ' [/INST]  </s>' AS text FROM conversations""")
def _(spark, sf):
    path = shared_dir(spark, "instructions") + ".json"
    write_json_array(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("instruction")), path)
    rows = read_instruction_json(spark, path, ["conv_id", "turn", "instruction"])
    return format_instruction(rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "instruction"),
        keep=["conv_id", "turn"])


@query("scan_cache_dir", """
  SELECT 'benchmark' AS source, CAST(0 AS BIGINT) AS source_rank, length(text) AS n_chars FROM benchmark
  UNION ALL SELECT 'conversations', 1, length(text) FROM conversations""")
def _(spark, sf):
    return scan_cache_dir(spark, sf, ["benchmark", "finance", "conversations"]).select("source", "source_rank", n_chars())


@query("scan_page_dump", f"""
  SELECT title, CAST(NULL AS VARCHAR) AS url, length(text) AS n_chars FROM ({WIKI_SQL})""")
def _(spark, sf):
    path = shared_dir(spark, "pages")
    wiki_pages(table(spark, sf, "documents")).select("title", "text").write.parquet(path)
    return scan_page_dump(spark, path).select("title", "url", n_chars())


@query("write_corpus", "SELECT md5(text) AS digest, length(text) AS n_chars FROM documents")
def _(spark, sf):
    path = shared_dir(spark, "corpus")
    write_corpus(table(spark, sf, "documents"), path)
    return spark.read.parquet(path).select(F.md5("text").alias("digest"), n_chars())


@query("materialize_once", "SELECT count(*) AS first_rows, count(*) AS second_rows FROM documents")
def _(spark, sf):
    path = shared_dir(spark, "once")
    docs = table(spark, sf, "documents").select("text")
    counts = [materialize_once(spark, lambda: docs, path) for _ in range(2)]
    return spark.createDataFrame([tuple(counts)], "first_rows bigint, second_rows bigint")


@query("write_text_shards", """
  SELECT md5(text) AS digest, length(text) AS n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS shard FROM documents""")
def _(spark, sf):
    path = shared_dir(spark, "shards")
    write_text_shards(table(spark, sf, "documents"), path, shard_size=300, order=["doc_id"])
    return read_text_shards(spark, path).select(F.md5("text").alias("digest"), n_chars(), "shard")


@query("extract_entities", f"""
  SELECT title, 'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url, length(text) AS n_chars
  FROM ({reason_sql('(' + WIKI_SQL + ')')}) WHERE reason IN ('business_category', 'business_intro', 'stock_intro')""")
def _(spark, sf):
    path = shared_dir(spark, "entities")
    extract_entities(wiki_pages(table(spark, sf, "documents")), path, head=800, tail=2_000)
    return spark.read.parquet(path).select("title", "url", n_chars())
