"""From documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes the result of a stage as Parquet in the shared
folder and reads it again as the input of the next one. All stages but the last return the columns of `documents`; other
columns of the input, whatever their names, are dropped by the first one.

Nulls: a null key or source is kept as it is, a null text goes in the first stage, a null language gets a prediction.
Texts are read whole, whatever their length. Repeated rows are near duplicates of each other, so one stays. Every
stage turns an empty table into an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.jaccard import keep_one
from corpuslake.llm.langid import UNKNOWN, identify, remainder, train
from corpuslake.llm.mixing import pareto_mix
from corpuslake.llm.packing import packed_digests
from corpuslake.llm.suffixes import remove_repeated
from corpuslake.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the predicted one as their `lang`. Documents whose language cannot be told
    (`und`: null, empty, or without a letter) go."""
    found = identify(docs.select(*COLUMNS), train(docs, remainder("doc_id", 4) != 2))
    return found.where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated passages. A document that is all passage keeps its row with an empty text."""
    cleaned = remove_repeated(docs.select(*COLUMNS))
    cleaned = cleaned.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("bigint"))
    return cleaned.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = pareto_mix(docs.select(*COLUMNS)).where(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in token sequences. `document` numbers the rows that are packed, so that the
    copies of a document can be told apart."""
    return packed_digests(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("document")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: Support vector machines, suffix sorting and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
