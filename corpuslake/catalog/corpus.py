"""Caps, mixing, shuffling, sharding and the corpus plan."""

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import CORPUS_SQL, ENGLISH_SQL, hash_sql
from corpuslake.operators.epochs import ROUNDS, epoch_places, number_rows
from corpuslake.operators.filters import filter_english, min_length
from corpuslake.operators.sampling import (
    assign_shards, cap_per_source, cap_scanned, concat_sources, debug_sample, epoch_split, interleave_round_robin, mix_by_ratio,
    oversample_cap, shuffle_blocks, shuffle_global, take_first)
from corpuslake.plans.corpus import build_corpus, corpus_totals
from corpuslake.streaming.clean import clean_text

SEED = 7
HEAD = 500  # characters that decide the language in the SQL


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source")


def _chunk_key(df):
    return df.select("doc_id", "source", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("text").cast("bigint").alias("n_chars"))


@query("corpus_totals", f"""
  WITH {CORPUS_SQL},
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) AS rn FROM chunks) WHERE rn <= 3000000),
  placed AS (SELECT *, row_number() OVER (ORDER BY rn, source) - 1 AS position FROM capped)
  SELECT source, count(*) AS chunks, sum(CASE WHEN chunk_no = 0 THEN 1 ELSE 0 END)::BIGINT AS documents, sum(length(text))::BIGINT AS chars,
    min(position) AS first_position, max(position) AS last_position FROM placed GROUP BY source""")
def _(spark, sf):
    return corpus_totals(build_corpus(docs(spark, sf), cap=3_000_000, head=HEAD))


@query("cap_per_source", f"""
  WITH {CORPUS_SQL}
  SELECT doc_id, source, chunk_no, length(text) AS n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) AS rn FROM chunks) WHERE rn <= 12""")
def _(spark, sf):
    return _chunk_key(cap_per_source(clean_text(docs(spark, sf), head=HEAD), 12, ["doc_id", "chunk_no"]))


@query("cap_scanned", """
  SELECT doc_id, source, length(text) AS n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 30 AND length(text) > 200""")
def _(spark, sf):
    kept = cap_scanned(docs(spark, sf), 30, F.length("text") > 200)
    return kept.select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"))


@query("oversample_cap", """
  WITH r AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS source_rank FROM documents WHERE length(text) > 20),
  c AS (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY doc_id) AS rn FROM r)
  SELECT * FROM (SELECT doc_id, source_rank, row_number() OVER (ORDER BY source_rank, doc_id) AS position FROM c WHERE rn <= 240)
  WHERE position <= 120""")
def _(spark, sf):
    rows = min_length(docs(spark, sf), "finance").select("doc_id", F.substring("source", 4, 9).cast("bigint").alias("source_rank"))
    return oversample_cap(rows, 120)


@query("take_first", """
  SELECT doc_id, length(text) AS n_chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 150)""")
def _(spark, sf):
    return take_first(docs(spark, sf), 150).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query("concat_sources", """
  SELECT 0::BIGINT AS source_rank, doc_id AS key, length(text) AS n_chars FROM documents
  UNION ALL SELECT 1, item_id, length(text) FROM benchmark
  UNION ALL SELECT 2, conv_id, length(text) FROM conversations
  UNION ALL SELECT 3, page_id, length(html) FROM pages""")
def _(spark, sf):
    columns = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text"), "conversations": ("conv_id", "text"), "pages": ("page_id", "html")}
    frames = [table(spark, sf, t).select(F.col(k).alias("key"), F.length(c).cast("bigint").alias("n_chars")) for t, (k, c) in columns.items()]
    return concat_sources(*frames)


@query("interleave_round_robin", """
  WITH l AS (SELECT doc_id, nullif(lang, 'de') AS lang FROM documents),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM l)
  SELECT doc_id, lang, row_number() OVER (ORDER BY rn, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang NULLS LAST) - 1 AS position FROM r""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"))
    return interleave_round_robin(rows, source="lang", sources=["fr", "en"])


@query("shuffle_global", f"SELECT doc_id, source, {hash_sql(str(SEED), 'doc_id')} AS shuffle_key FROM documents")
def _(spark, sf):
    return shuffle_global(ids(spark, sf), SEED)


@query("shuffle_blocks", f"""
  WITH i AS (SELECT doc_id, source, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS block FROM documents)
  SELECT doc_id, source, block, block * 256 + row_number() OVER (PARTITION BY block ORDER BY {hash_sql(str(SEED), 'doc_id')}, doc_id) - 1 AS position FROM i""")
def _(spark, sf):
    return shuffle_blocks(ids(spark, sf), SEED, block=256)


@query("assign_shards", "SELECT doc_id, source, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def _(spark, sf):
    return assign_shards(ids(spark, sf), 4)


@query("epoch_split", f"""
  WITH p AS (SELECT doc_id, source, row_number() OVER (ORDER BY {hash_sql(str(SEED), '3', 'doc_id')}, doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
  w AS (SELECT doc_id, source, idx AS place FROM p UNION ALL SELECT doc_id, source, idx + n FROM p WHERE idx + n < ceil(n / 7.0) * 7)
  SELECT doc_id, source, place % 7 AS rank, place // 7 AS slot FROM w""")
def _(spark, sf):
    return epoch_split(ids(spark, sf), world_size=7, epoch=3, seed=SEED)


def step_sql(inner: str, seed: int, epoch: int) -> str:
    """One walk of the grid over `inner(doc_id, source, place, n, a, b)`: a rows, b columns."""
    rows = f"SELECT *, place // b AS r, place % b AS c FROM ({inner})"
    for k in range(ROUNDS):
        moved, by, size = ("c", "r", "b") if k % 2 else ("r", "c", "a")
        rows = f"SELECT * REPLACE (({moved} + {hash_sql(str(seed), str(epoch), str(k), by)}) % {size} AS {moved}) FROM ({rows})"
    return f"SELECT doc_id, source, r * b + c AS place, n, a, b FROM ({rows})"


@query("epoch_places", f"""
  WITH RECURSIVE p AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n,
    CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM documents),
  s AS (SELECT *, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT) AS b FROM p),
  w AS ({step_sql("SELECT * FROM s", SEED, 3)} UNION ALL {step_sql("SELECT * FROM w WHERE place >= n", SEED, 3)}),
  e AS (SELECT * FROM w WHERE place < n),
  f AS (SELECT doc_id, source, place FROM e UNION ALL SELECT doc_id, source, place + n FROM e WHERE place + n < ceil(n / 7.0) * 7)
  SELECT doc_id, source, place % 7 AS rank, place // 7 AS slot FROM f""")
def _(spark, sf):
    numbered = number_rows(ids(spark, sf))
    return epoch_places(numbered, numbered.count(), world_size=7, epoch=3, seed=SEED).drop("idx")


@query("mix_by_ratio", f"""
  WITH a AS (SELECT doc_id, source FROM documents WHERE lang = 'en'),
  b AS (SELECT doc_id, source, row_number() OVER (ORDER BY {hash_sql(str(SEED), 'doc_id')}, doc_id) AS rn FROM documents WHERE lang <> 'en')
  SELECT doc_id, source, 'a' AS part FROM a
  UNION ALL SELECT doc_id, source, 'b' FROM b WHERE rn <= (SELECT floor(0.15 / 0.85 * count(*) + 0.5) FROM a)""")
def _(spark, sf):
    rows = table(spark, sf, "documents")
    english, other = (rows.where(test).select("doc_id", "source") for test in (F.col("lang") == "en", F.col("lang") != "en"))
    return mix_by_ratio(english, other, 0.15, SEED)


@query("debug_sample", f"""
  SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE {ENGLISH_SQL}) WHERE rn <= 1000""")
def _(spark, sf):
    return debug_sample(filter_english(docs(spark, sf), head=HEAD), 1_000).select("doc_id", "source")
