"""Query / positive / negative rows for contrastive training."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.hashing import seeded_hash
from corpuslake.functions.text import filled
from corpuslake.functions.wordlists import MATCH_INSTRUCTION, PASSAGE_INSTRUCTION, QA_INSTRUCTION
from corpuslake.operators.ordering import with_rank

# Accepted label spellings, lower case.
LABEL_CODES = {"exact": ("exact", "e"), "substitute": ("substitute", "s"), "complement": ("complement", "c")}


def _first_of(df: DataFrame, *names: str):
    present = [filled(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def judged_rows(df: DataFrame, pos: str = "pos") -> DataFrame:
    """`pos, query, product, label` with blank queries and products removed."""
    rows = df.select(
        F.col(pos).alias("pos"), filled("query").alias("query"),
        _first_of(df, "product_title", "product").alias("product"),
        F.lower(F.coalesce(_first_of(df, "esci_label", "label"), F.lit(""))).alias("label"))
    return rows.where(F.col("query").isNotNull() & F.col("product").isNotNull())


def judged_to_triples(df: DataFrame, max_neg: int, pos: str = "pos", **kw) -> DataFrame:
    """One row per exact product, with the first substitutes of the same query as negatives.

    The substitutes are cut to `max_neg` per query before they are collected, so a list never grows
    with a query's popularity; the join back is on `query` with at most one row per query on that side.
    """
    rows = judged_rows(df, pos)
    exact = rows.where(F.col("label").isin(*LABEL_CODES["exact"]))
    substitutes = rows.where(F.col("label").isin(*LABEL_CODES["substitute"]))
    first = with_rank(substitutes, ["pos"], ["query"], "__rank", limit=max_neg, **kw)
    lists = first.groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "product"))), lambda s: s["product"]).alias("hard_negatives"))
    joined = exact.join(lists, "query", "left")
    return joined.select(
        "pos", "query", F.col("product").alias("positive"),
        F.coalesce("hard_negatives", F.array().cast("array<string>")).alias("hard_negatives"),
        F.lit(MATCH_INSTRUCTION).alias("instruction"))


def qa_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Question and passage, both non-empty."""
    rows = df.select(
        *keep, _first_of(df, "question", "query").alias("query"),
        _first_of(df, "context", "passage", "text").alias("positive"), F.lit(QA_INSTRUCTION).alias("instruction"))
    return rows.where(F.col("query").isNotNull() & F.col("positive").isNotNull())


def first_selected_passage(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The first selected passage of each query; queries without one give no row. No explode."""
    passages = F.arrays_zip(
        F.col("passages.passage_text").alias("text"), F.col("passages.is_selected").alias("selected"))
    chosen = F.try_element_at(F.filter(passages, lambda p: p["selected"] == 1), F.lit(1))
    rows = df.select(*keep, F.coalesce("query", F.lit("")).alias("query"), chosen.alias("__chosen"))
    return rows.where(F.col("__chosen").isNotNull()).select(
        *keep, "query", F.col("__chosen")["text"].alias("positive"), F.lit(PASSAGE_INSTRUCTION).alias("instruction"))


def union_pairs(*frames: DataFrame, seed: int | None = None) -> DataFrame:
    """All pair sources; pairs without negatives get an empty list. With a seed, in random order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if "hard_negatives" not in rows.columns:
        rows = rows.withColumn("hard_negatives", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("hard_negatives", F.coalesce("hard_negatives", F.array().cast("array<string>")))
    if seed is None:
        return rows
    return rows.orderBy(seeded_hash(seed, F.col("query"), F.col("positive")), "query", "positive")


def explode_negatives(df: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """One row per negative in order; a pair without negatives gives none."""
    return df.select(pair_id, F.posexplode("hard_negatives").alias("neg_no", "negative"))


def check_pairs(df: DataFrame) -> DataFrame:
    """Raises when a pair lacks its query or its positive (one aggregate job)."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("query").isNull()).alias("no_query"),
        F.count_if(F.col("positive").isNull()).alias("no_positive")).first()
    if row["no_query"] or row["no_positive"]:
        raise ValueError(f"of {row['rows']} pairs {row['no_query']} lack a query and {row['no_positive']} a positive")
    return df


def pair_counts(df: DataFrame) -> DataFrame:
    """The counts behind `check_pairs` as a table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("query").isNull()).alias("no_query"),
        F.count_if(F.col("positive").isNull()).alias("no_positive"),
        F.sum(F.size(F.coalesce("hard_negatives", F.array().cast("array<string>")))).cast("bigint").alias("n_negatives"))
