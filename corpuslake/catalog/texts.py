"""Fields, formatting, filters and chunks."""

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import (
    ENGLISH_SQL, FIELDS_SQL, KIND_SQL, SPACE_SQL, TOKEN_SQL, WIKI_SQL, chunk_sql, multi_field, reason_sql, wiki_pages, with_kind)
from corpuslake.functions.text import is_likely_english, normalize_text, page_url, pretokenize
from corpuslake.operators.chunking import chunk_text
from corpuslake.operators.entities import classify_entity_page
from corpuslake.operators.fields import (
    concat_nonempty_fields, contextualize, explode_long_fields, first_long_field, first_nonempty_field, format_instruction,
    format_query, turns_to_samples)
from corpuslake.operators.filters import filter_english, long_enough_by_kind

FIELDS = ["title", "description", "text"]


def docs(spark, sf):
    return table(spark, sf, "documents")


def strip_sql(c: str) -> str:
    return f"trim({c}, {SPACE_SQL})"


@query("first_nonempty_field", f"""
  SELECT * FROM (SELECT doc_id, coalesce(nullif(title, ''), nullif(description, ''), nullif(text, '')) AS chosen FROM ({FIELDS_SQL}))
  WHERE length(chosen) > 20""")
def _(spark, sf):
    return first_nonempty_field(multi_field(docs(spark, sf)), FIELDS, "chosen", 20).select("doc_id", "chosen")


@query("first_long_field", f"""
  SELECT * FROM (SELECT doc_id, CASE WHEN length(title) > 50 THEN title WHEN length(description) > 50 THEN description
    WHEN length(text) > 50 THEN text END AS chosen FROM ({FIELDS_SQL})) WHERE chosen IS NOT NULL""")
def _(spark, sf):
    return first_long_field(multi_field(docs(spark, sf)), FIELDS, 50, "chosen").select("doc_id", "chosen")


@query("explode_long_fields", f"""
  WITH f AS ({FIELDS_SQL}),
  l AS (SELECT doc_id, 0 AS place, title AS chosen FROM f UNION ALL SELECT doc_id, 1, description FROM f UNION ALL SELECT doc_id, 2, text FROM f)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS field_no, chosen FROM l WHERE length(chosen) > 50""")
def _(spark, sf):
    rows = explode_long_fields(multi_field(docs(spark, sf)), FIELDS, 50, "chosen")
    return rows.select("doc_id", F.col("field_no").cast("bigint").alias("field_no"), "chosen")


@query("concat_nonempty_fields", f"""
  SELECT doc_id, concat_ws(' ', CASE WHEN {strip_sql('title')} <> '' THEN title END,
    CASE WHEN {strip_sql('description')} <> '' THEN description END, CASE WHEN {strip_sql('text')} <> '' THEN text END) AS joined
  FROM ({FIELDS_SQL})""")
def _(spark, sf):
    return concat_nonempty_fields(multi_field(docs(spark, sf)), FIELDS, "joined").select("doc_id", "joined")


@query("format_instruction", f"""
  SELECT doc_id, '<s>[INST] ' || {strip_sql("CASE WHEN " + strip_sql("coalesce(description, '')") + " <> '' THEN coalesce(title, '') || chr(10) || chr(10) || 'Context:' || chr(10) || description ELSE coalesce(title, '') END")}
    || ' [/INST] ' || {strip_sql('text')} || ' </s>' AS text FROM ({FIELDS_SQL})""")
def _(spark, sf):
    rows = multi_field(docs(spark, sf)).selectExpr("doc_id", "title AS instruction", "description AS input", "text AS output")
    return format_instruction(rows, keep=["doc_id"])


@query("format_query", """
  SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE 'Instruct: Find {passages} like item ' || item_id || chr(10) || 'Query: ' || text END AS query_text
  FROM benchmark""")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").selectExpr(
        "item_id", "text AS query",
        "CASE WHEN item_id % 3 = 0 THEN NULL ELSE concat('Find {passages} like item ', CAST(item_id AS STRING)) END AS instruction")
    return format_query(rows).select("item_id", "query_text")


@query("contextualize", f"""
  WITH c AS ({chunk_sql('documents')})
  SELECT c.doc_id, c.chunk_no, 'Document of ' || d.source || ' in ' || d.lang || ' : ' || c.text AS text FROM c JOIN documents d USING (doc_id)""")
def _(spark, sf):
    rows = docs(spark, sf).withColumn("chunk_context", F.expr("concat('Document of ', source, ' in ', lang)"))
    chunks = chunk_text(rows).withColumnRenamed("text", "chunk_content")
    return contextualize(chunks, sep=" : ").select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")


@query("page_url", r"""
  SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN url END,
    'https://en.wikipedia.org/wiki/' || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', '_')) AS page_url FROM pages""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    rows = pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                        F.expr("CASE WHEN page_id % 2 = 0 THEN url END").alias("url"))
    return rows.select("page_id", page_url("title", "url").alias("page_url"))


@query("turns_to_samples", f"""
  WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response,
      last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS ctx
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, '<s>[INST] ' || {strip_sql("CASE WHEN " + strip_sql("coalesce(ctx, '')") + " <> '' THEN text || chr(10) || chr(10) || 'Context:' || chr(10) || ctx ELSE text END")}
    || ' [/INST] ' || {strip_sql('response')} || ' </s>' AS text
  FROM t WHERE role = 'user' AND next_role = 'assistant'""")
def _(spark, sf):
    return turns_to_samples(table(spark, sf, "conversations"))


@query("normalize_text", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", normalize_text("text").alias("folded"))


@query("pretokenize", f"""
  SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words
  FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS w FROM documents)""")
def _(spark, sf):
    rows = docs(spark, sf).select("doc_id", pretokenize("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", " ").alias("words"))


@query("is_likely_english", f"SELECT doc_id, {ENGLISH_SQL} AS english FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", is_likely_english("text", head=500).alias("english"))


@query("filter_english", f"SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE {ENGLISH_SQL} GROUP BY lang")
def _(spark, sf):
    return filter_english(docs(spark, sf), head=500).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("min_length", f"""
  SELECT doc_id, kind,
    CASE kind WHEN 'finance' THEN length(text) > 20 WHEN 'ecommerce' THEN length(text) > 50 WHEN 'generic' THEN length(text) > 100
      ELSE length(text) >= 100 END AS loader,
    CASE kind WHEN 'finance' THEN length(text) >= 20 WHEN 'ecommerce' THEN length(text) > 50 ELSE length(text) >= 100 END AS tokenizer
  FROM ({KIND_SQL})""")
def _(spark, sf):
    rows = with_kind(docs(spark, sf))
    return rows.select("doc_id", "kind", long_enough_by_kind("text", "kind").alias("loader"),
                       long_enough_by_kind("text", "kind", "tokenizer").alias("tokenizer"))


@query("classify_entity_page", f"""
  SELECT doc_id, title, reason, reason IN ('business_category', 'business_intro', 'stock_intro') AS keep
  FROM ({reason_sql('(' + WIKI_SQL + ')')})""")
def _(spark, sf):
    return classify_entity_page(wiki_pages(docs(spark, sf)), head=800, tail=2_000).select("doc_id", "title", "reason", "keep")


@query("entity_reasons", f"SELECT reason, count(*) AS n FROM ({reason_sql('(' + WIKI_SQL + ')')}) GROUP BY reason")
def _(spark, sf):
    return classify_entity_page(wiki_pages(docs(spark, sf)), head=800, tail=2_000).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _chunks(spark, sf, variant):
    rows = chunk_text(docs(spark, sf).select("doc_id", "source", "text"), variant)
    big = [F.col(c).cast("bigint").alias(c) for c in ("chunk_no", "n_chunks", "char_start")]
    return rows.select("doc_id", "source", "text", *big)


@query("chunk_text_loader", chunk_sql("documents"))
def _(spark, sf):
    return _chunks(spark, sf, "loader")


@query("chunk_text_tokenizer", chunk_sql("documents", inclusive=True))
def _(spark, sf):
    return _chunks(spark, sf, "tokenizer")
