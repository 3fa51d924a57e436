"""Contrastive pairs and triples."""

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import JUDGED_SQL, UNIT_SQL, as_items, as_queries, five_passages, joined, judgments
from corpuslake.functions import wordlists as w
from corpuslake.operators.pairs import (
    check_pairs, explode_negatives, first_selected_passage, judged_to_triples, pair_counts, qa_pairs, union_pairs)
from corpuslake.operators.retrieval import mine_hard_negatives

TRIPLES_SQL = f"""
  WITH j AS (SELECT pos, query, product_title AS product, lower(esci_label) AS label FROM ({JUDGED_SQL})),
  s AS (SELECT query, list(product ORDER BY pos) AS negs FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS rn FROM j WHERE label IN ('substitute', 's')) WHERE rn <= 7 GROUP BY query)
  SELECT j.pos, j.query, j.product AS positive, coalesce(negs, []) AS hard_negatives, '{w.MATCH_INSTRUCTION}' AS instruction
  FROM j LEFT JOIN s USING (query) WHERE label IN ('exact', 'e')"""

QA_SQL = f"""
  SELECT conv_id, turn, query, positive, '{w.QA_INSTRUCTION}' AS instruction FROM (
    SELECT conv_id, turn, nullif(text, '') AS query, nullif(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS positive FROM conversations)
  WHERE query IS NOT NULL AND positive IS NOT NULL"""

PASSAGE_SQL = f"""
  SELECT doc_id // 5 AS query_id, 'query ' || (doc_id // 5) AS query, arg_min(text, doc_id) AS positive, '{w.PASSAGE_INSTRUCTION}' AS instruction
  FROM documents WHERE doc_id % 5 IN (2, 4) AND (doc_id // 5) % 4 <> 0 GROUP BY doc_id // 5"""


def triples(spark, sf):
    return judged_to_triples(judgments(table(spark, sf, "part")), max_neg=7)


def questions(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "text AS question", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context")
    return qa_pairs(turns, keep=["conv_id", "turn"])


def passages(spark, sf):
    return first_selected_passage(five_passages(table(spark, sf, "documents")), keep=["query_id"])


@query("judged_to_triples", f"""
  SELECT pos, query, positive, array_to_string(hard_negatives, '|') AS hard_negatives, instruction FROM ({TRIPLES_SQL})""")
def _(spark, sf):
    return triples(spark, sf).withColumn("hard_negatives", F.array_join("hard_negatives", "|"))


@query("qa_pairs", QA_SQL)
def _(spark, sf):
    return questions(spark, sf)


@query("first_selected_passage", PASSAGE_SQL)
def _(spark, sf):
    return passages(spark, sf)


def all_pairs(spark, sf, seed=None):
    frames = [triples(spark, sf).drop("pos"), questions(spark, sf).drop("conv_id", "turn"), passages(spark, sf).drop("query_id")]
    return union_pairs(*frames, seed=seed)


UNION_SQL = f"""
  SELECT query, positive, hard_negatives, instruction FROM ({TRIPLES_SQL})
  UNION ALL SELECT query, positive, [], instruction FROM ({QA_SQL})
  UNION ALL SELECT query, positive, [], instruction FROM ({PASSAGE_SQL})"""


@query("union_pairs", f"""
  SELECT query, positive, array_to_string(hard_negatives, '|') AS hard_negatives, instruction FROM ({UNION_SQL})""")
def _(spark, sf):
    return all_pairs(spark, sf, seed=11).withColumn("hard_negatives", F.array_join("hard_negatives", "|"))


@query("explode_negatives", f"""
  SELECT pos AS pair_id, unnest(range(len(hard_negatives))) AS neg_no, unnest(hard_negatives) AS negative FROM ({TRIPLES_SQL})""")
def _(spark, sf):
    rows = explode_negatives(triples(spark, sf).withColumnRenamed("pos", "pair_id"))
    return rows.withColumn("neg_no", F.col("neg_no").cast("bigint"))


@query("check_pairs", f"""
  SELECT count(*) AS n_rows, count(*) - count(query) AS no_query, count(*) - count(positive) AS no_positive,
    sum(len(hard_negatives))::BIGINT AS n_negatives FROM ({UNION_SQL})""")
def _(spark, sf):
    return pair_counts(check_pairs(all_pairs(spark, sf)))


@query("mine_hard_negatives", f"""
  WITH u AS ({UNIT_SQL}),
  r AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, d.u), 9) DESC, d.vec_id) AS rank
        FROM u q, u d)
  SELECT query_id, array_to_string(list(item_id ORDER BY rank), ',') AS hard_negatives FROM r
  WHERE rank <= 10 AND item_id <> query_id AND item_id <> query_id + 1 GROUP BY query_id""")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    known = vectors.select("vec_id", F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 1)).alias("item_id"))
    found = mine_hard_negatives(as_queries(vectors), as_items(vectors), known.withColumnRenamed("vec_id", "query_id"), depth=10)
    return found.select("query_id", joined("hard_negatives").alias("hard_negatives"))
