"""Views that give the test tables the shapes the operators need, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import wordlists as w
from corpuslake.functions.text import pretokenize

# --- SQL fragments -----------------------------------------------------------------------------

SPACE_SQL = "||".join(f"chr({ord(c)})" for c in w.WHITESPACE)
TOKEN_SQL = r"[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+"
WORD_SQL = r"[\p{L}\p{N}]+"


def english_sql(words_in: str = "text") -> str:
    return (
        r"(text IS NULL OR length(text) < 20 OR (regexp_matches(" + words_in + ", "
        r"'(?i)(^|[^\p{L}\p{N}_])(" + "|".join(w.ENGLISH_WORDS) + r")([^\p{L}\p{N}_]|$)') "
        r"AND length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) >= 0.85))"
    )


ENGLISH_SQL = english_sql("substring(text, 1, 500)")


def hash_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def chunk_sql(source: str, inclusive: bool = False) -> str:
    """Chunks of `source(doc_id, source, text)`."""
    test = ">=" if inclusive else ">"
    return f"""
      SELECT * FROM (
        SELECT doc_id, source, CASE WHEN n_chunks > 1 THEN substring(text, chunk_no * 2000 + 1, 2500) ELSE text END AS text,
               chunk_no, n_chunks, CASE WHEN n_chunks > 1 THEN chunk_no * 2000 ELSE 0 END AS char_start
        FROM (SELECT doc_id, source, text, n_chunks, unnest(range(n_chunks)) AS chunk_no
              FROM (SELECT *, CASE WHEN length(text) > 5000 THEN CAST(ceil(length(text) / 2000.0) AS BIGINT) ELSE 1 END AS n_chunks
                    FROM {source})))
      WHERE n_chunks = 1 OR length(text) {test} 200"""


CORPUS_SQL = f"""
  cleaned AS (SELECT doc_id, source, text FROM documents WHERE {ENGLISH_SQL} AND length(text) > 100),
  chunks AS ({chunk_sql('cleaned')})"""


# --- corpus sources ----------------------------------------------------------------------------

def with_kind(docs: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("finance", "ecommerce", "generic", "wiki")])
    return docs.withColumn("kind", F.get(kinds, F.pmod("doc_id", F.lit(4)).cast("int")))


KIND_SQL = """SELECT doc_id, text, source, CASE doc_id % 4 WHEN 0 THEN 'finance' WHEN 1 THEN 'ecommerce'
              WHEN 2 THEN 'generic' ELSE 'wiki' END AS kind FROM documents"""


def multi_field(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE substring(text, 1, 30) END AS title",
        "CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE substring(text, 31, 200) END AS description",
        "text")


FIELDS_SQL = """SELECT doc_id,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE substring(text, 1, 30) END AS title,
  CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE substring(text, 31, 200) END AS description, text FROM documents"""

WIKI_COLUMNS = [
    "doc_id",
    """CASE doc_id % 14 WHEN 0 THEN 'User:Ann' WHEN 1 THEN 'Acme (disambiguation)' WHEN 2 THEN 'List of things'
    WHEN 3 THEN '1995' WHEN 4 THEN '19th century art' WHEN 5 THEN 'May Day'
    ELSE concat('Entity ', CAST(doc_id AS STRING)) END AS title""",
    """concat(
    CASE doc_id % 14 WHEN 6 THEN 'Ann was born in Oslo. ' WHEN 7 THEN 'Acme is a company. '
      WHEN 8 THEN 'Acme trades as NYSE: ACM. ' WHEN 9 THEN 'Acme is a company founded by a man who was a baker. '
      ELSE 'Plain text. ' END,
    text,
    CASE doc_id % 14 WHEN 10 THEN ' [[Category:Software companies]]' WHEN 11 THEN ' [[category: 1950 births ]]'
      WHEN 12 THEN ' [[Category:Companies of the United States]]' ELSE '' END) AS text""",
]
WIKI_SQL = f"SELECT {', '.join(WIKI_COLUMNS)} FROM documents"


def wiki_pages(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(*WIKI_COLUMNS)


def _contains_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in words) + ")"


def _starts_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{x}')" for x in words) + ")"


def _category_sql(words) -> str:
    return f"list_bool_or([{_contains_sql('c', words)} FOR c IN cats])"


def reason_sql(source: str) -> str:
    """`doc_id, title, text, reason` of the page rules over `source(doc_id, title, text)`."""
    months = ", ".join(f"'{m}'" for m in w.MONTHS)
    return f"""
      SELECT doc_id, title, text, CASE
        WHEN {_starts_sql('title', w.NAMESPACE_PREFIXES)} THEN 'namespace'
        WHEN contains(low, '(disambiguation)') THEN 'disambiguation'
        WHEN {_starts_sql('low', w.LIST_PREFIXES)} THEN 'list_page'
        WHEN regexp_matches(title, '{w.YEAR_PATTERN}') OR regexp_matches(title, '{w.DECADE_PATTERN}')
          OR regexp_matches(low, '{w.CENTURY_PATTERN}') THEN 'date_title'
        WHEN regexp_extract(low, '^\\s*(\\S+)', 1) IN ({months}) THEN 'month_title'
        WHEN length(text) < 1000 THEN 'short'
        WHEN {_category_sql(w.OTHER_CATEGORIES)} THEN 'other_category'
        WHEN {_category_sql(w.BUSINESS_CATEGORIES)} THEN 'business_category'
        WHEN {_contains_sql('intro', w.OTHER_INTROS)} THEN 'other_intro'
        WHEN {_contains_sql('intro', w.BUSINESS_INTROS)} THEN 'business_intro'
        WHEN {_contains_sql('intro', w.STOCK_INTROS)} THEN 'stock_intro'
        ELSE 'no_signal' END AS reason
      FROM (SELECT *, lower(title) AS low, lower(substring(text, 1, 800)) AS intro,
              [lower(trim(c)) FOR c IN regexp_extract_all(right(text, 2000), '(?i)Category:([^\\]\\n]+)', 1)] AS cats
            FROM {source})"""


# --- judged products ---------------------------------------------------------------------------

JUDGED_COLUMNS = [
    "concat(p_brand, ' ', p_type) AS query",
    "concat(p_name, ' ', CAST(p_partkey AS STRING)) AS product_title",
    """CASE p_partkey % 7 WHEN 0 THEN 'Exact' WHEN 1 THEN 'E' WHEN 2 THEN 'substitute' WHEN 3 THEN 'S'
    WHEN 4 THEN 'complement' WHEN 5 THEN 'irrelevant' ELSE '' END AS esci_label""",
    "p_partkey AS pos",
]
JUDGED_SQL = f"SELECT {', '.join(JUDGED_COLUMNS)} FROM part"


def judgments(part: DataFrame) -> DataFrame:
    return part.selectExpr(*JUDGED_COLUMNS)


# Scores from part sizes: many ties inside a query.
SCORED_SQL = """SELECT concat(p_brand, ' ', p_type) AS query_id, p_partkey AS item_id, p_partkey AS pos, p_size / 50.0::DOUBLE AS score,
  CASE WHEN p_partkey % 7 IN (0, 1) THEN 3 WHEN p_partkey % 7 IN (2, 3) THEN 2 WHEN p_partkey % 7 = 4 THEN 1 ELSE 0 END AS gain
  FROM part"""


def scored(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "concat(p_brand, ' ', p_type) AS query_id", "p_partkey AS item_id", "p_partkey AS pos",
        "p_size / CAST(50.0 AS DOUBLE) AS score",
        "CASE WHEN p_partkey % 7 IN (0, 1) THEN 3 WHEN p_partkey % 7 IN (2, 3) THEN 2 WHEN p_partkey % 7 = 4 THEN 1 ELSE 0 END AS gain")


# --- vectors -----------------------------------------------------------------------------------

def vector_pairs(embeddings: DataFrame, batch: int = 16) -> DataFrame:
    """Each vector as a query, its successor as the positive."""
    positive = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("pv"))
    rows = embeddings.select("vec_id", F.col("embedding").alias("qv")).join(positive, "vec_id")
    return rows.select(F.expr(f"vec_id DIV {batch}").alias("batch_id"), F.col("vec_id").alias("pair_id"), "qv", "pv")


PAIRS_SQL = """SELECT q.vec_id // 16 AS batch_id, q.vec_id AS pair_id, q.embedding::DOUBLE[] AS qv, p.embedding::DOUBLE[] AS pv
  FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1"""


def as_items(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def as_queries(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


UNIT_SQL = """SELECT vec_id, label, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""


# --- token ids ---------------------------------------------------------------------------------

def token_ids(docs: DataFrame) -> DataFrame:
    """Ids from the first character and the length of each word."""
    ids = F.transform(pretokenize(F.lower("text")), lambda t: (7 + (F.ascii(t) * 31 + F.length(t)) % 30_000).cast("int"))
    return docs.withColumn("input_ids", ids)


TOKENS_SQL = f"""SELECT doc_id, source, text, 
  [CAST(7 + (unicode(t) * 31 + length(t)) % 30000 AS INTEGER) FOR t IN regexp_extract_all(lower(text), '{TOKEN_SQL}')] AS input_ids FROM documents"""


def joined(ids) -> "F.Column":
    """An array as text, so that every engine prints it alike."""
    return F.array_join(F.col(ids) if isinstance(ids, str) else ids, ",")


# --- several small conveniences ----------------------------------------------------------------

def five_passages(docs: DataFrame) -> DataFrame:
    """Five consecutive documents per query as parallel arrays."""
    rows = docs.selectExpr("doc_id DIV 5 AS query_id", "doc_id", "text",
                           "CASE WHEN doc_id % 5 IN (2, 4) AND (doc_id DIV 5) % 4 <> 0 THEN 1 ELSE 0 END AS sel")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "sel"))).alias("p"))
    return lists.select(
        "query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query"),
        F.struct(F.transform("p", lambda s: s["text"]).alias("passage_text"),
                 F.transform("p", lambda s: s["sel"]).alias("is_selected")).alias("passages"))

