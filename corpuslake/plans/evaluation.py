"""Ranking evaluation of an encoder on judged query / product rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.vectors import dot
from corpuslake.operators.contrastive import HashedBagOfWords, encode_table
from corpuslake.operators.pairs import judged_rows
from corpuslake.operators.ranking import grade_labels, mrr_by_query, ndcg_by_query
from corpuslake.session import cut_lineage

SCORE_DIGITS = 9


def score_judgments(judgments: DataFrame, make_encoder: Callable = HashedBagOfWords, accept_codes: bool = False) -> DataFrame:
    """`query_id, item_id, score, gain`; each distinct query text is encoded once.

    The query vectors are joined on the text; a query with very many products is split by adaptive
    skew handling because its side has one row.
    """
    rows = grade_labels(judged_rows(judgments), accept_codes=accept_codes)
    queries = encode_table(rows.select("query").distinct(), make_encoder, "query", "qv")
    products = encode_table(rows, make_encoder, "product", "pv")
    scored = products.join(queries, "query")
    return scored.select(F.col("query").alias("query_id"), F.col("pos").alias("item_id"),
                         F.round(dot("qv", "pv"), SCORE_DIGITS).alias("score"), "gain")


def evaluate_judgments(judgments: DataFrame, make_encoder: Callable = HashedBagOfWords, accept_codes: bool = False) -> DataFrame:
    """One row: mean NDCG and mean reciprocal rank. Scores are written, so that texts are encoded once."""
    scores = cut_lineage(score_judgments(judgments, make_encoder, accept_codes), "scores")
    per_query = ndcg_by_query(scores).join(mrr_by_query(scores), "query_id", "full")
    return per_query.agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"),
                         F.count("rr").alias("queries"))
