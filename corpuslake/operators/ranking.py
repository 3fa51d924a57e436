"""Ranking metrics over `query_id, item_id, score, gain` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.ordering import with_rank
from corpuslake.operators.pairs import LABEL_CODES
from corpuslake.session import cut_lineage

# Relevance of the judgment labels.
GAINS = {"exact": 3, "substitute": 2, "complement": 1, "irrelevant": 0}
TOP_GAIN = 3
MIN_ITEMS = 2


def grade_labels(df: DataFrame, label: str = "label", accept_codes: bool = False) -> DataFrame:
    """Add `gain`: full words only, unless one-letter codes are accepted; unknown labels count 0."""
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    gain = F.lit(0)
    for name, value in GAINS.items():
        names = LABEL_CODES.get(name, (name,)) if accept_codes else (name,)
        gain = F.when(low.isin(*names), value).otherwise(gain)
    return df.withColumn("gain", gain)


def _discount(rank: str):
    return F.lit(1.0) / F.log2(F.col(rank) + 1)


def ndcg_by_query(df: DataFrame, k: int | None = None, **kw) -> DataFrame:
    """NDCG with linear gain per query that has two items and some gain.

    Items with equal scores share their mean gain. Both orders use the same partitioning by query;
    a query too large for one task is ranked in ranges (`with_rank`) and its sums are partial.
    """
    rows = df.select("query_id", "item_id", "score", F.col("gain").cast("double").alias("gain"))
    rows = with_rank(rows, [("score", "desc"), "item_id"], ["query_id"], "__rank", **kw)
    rows = with_rank(rows, [("gain", "desc"), "item_id"], ["query_id"], "__ideal", **kw)

    def weight(rank):
        return _discount(rank) if k is None else F.when(F.col(rank) <= k, _discount(rank)).otherwise(F.lit(0.0))

    ties = rows.groupBy("query_id", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain"), F.sum(weight("__rank")).alias("discount"),
        F.sum(F.col("gain") * weight("__ideal")).alias("ideal"))
    per_query = ties.groupBy("query_id").agg(
        F.sum("n").alias("items"), F.sum("gain").alias("gain"),
        F.sum(F.col("gain") / F.col("n") * F.col("discount")).alias("dcg"), F.sum("ideal").alias("ideal"))
    usable = per_query.where((F.col("items") >= MIN_ITEMS) & (F.col("gain") > 0))
    return usable.select("query_id", "items", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def ndcg(df: DataFrame, k: int | None = None, **kw) -> DataFrame:
    return ndcg_by_query(df, k, **kw).agg(F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("queries"))


def mrr_by_query(df: DataFrame, k: int | None = None, **kw) -> DataFrame:
    """Reciprocal rank of the first item with the top gain (0 without one), queries of two items or more."""
    rows = with_rank(df.select("query_id", "item_id", "score", "gain"), [("score", "desc"), "item_id"], ["query_id"], "__rank", **kw)
    hit = F.col("gain") == TOP_GAIN
    if k is not None:
        hit = hit & (F.col("__rank") <= k)
    per_query = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.min(F.when(hit, F.col("__rank"))).alias("first"))
    usable = per_query.where(F.col("items") >= MIN_ITEMS)
    return usable.select("query_id", F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def mrr(df: DataFrame, k: int | None = None, **kw) -> DataFrame:
    return mrr_by_query(df, k, **kw).agg(F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("queries"))


def recall_at_k(df: DataFrame, k: int = 100, min_gain: int = 1, **kw) -> DataFrame:
    """Share of each query's relevant items among its first k."""
    rows = with_rank(df.select("query_id", "item_id", "score", "gain"), [("score", "desc"), "item_id"], ["query_id"], "__rank", **kw)
    relevant = F.col("gain") >= min_gain
    per_query = rows.groupBy("query_id").agg(
        F.count_if(relevant).alias("relevant"), F.count_if(relevant & (F.col("__rank") <= k)).alias("found"))
    return per_query.where(F.col("relevant") > 0).select(
        "query_id", "relevant", "found", (F.col("found") / F.col("relevant")).alias("recall"))


def cap_queries(df: DataFrame, n: int | None = None, pos: str = "pos", query: str = "query_id",
                reference_cut: bool = False, **kw) -> DataFrame:
    """Rows of the first n queries in order of appearance; everything unless n is given.

    With `reference_cut` reading stops at the first row of the n-th query, as a single pass would.
    """
    if n is None:
        return df
    firsts = df.groupBy(F.col(query).alias("__q")).agg(F.min(pos).alias("__first"))
    chosen = with_rank(firsts, ["__first"], (), "__rank", limit=n, **kw)
    if reference_cut:
        last = chosen.where(F.col("__rank") == n).first()
        return df if last is None else df.where(F.col(pos) <= last["__first"])
    names = cut_lineage(chosen.select("__q"), "queries")
    return df.join(names, F.col(query) == F.col("__q"), "left_semi")


def macro_average(scores: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Unweighted mean over tasks; a task without a score counts 0."""
    mean = F.avg(F.coalesce(score, F.lit(0.0))).alias("macro_average")
    return scores.groupBy(*by).agg(mean) if by else scores.agg(mean)
