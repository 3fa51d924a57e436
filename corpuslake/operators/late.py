"""Late interaction in a written index of documents.

The index holds one row per document: its token vectors and the cell of each. A query token q scores a token of a cell
at most q c + radius (`cells.py`), so the best of these over the cells of a document, summed over the query's tokens,
bounds the document's score. A task scores a document only for the queries of which that bound reaches the k-th best
score it has found so far, and hands on at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.operators.cells import SAMPLE, fit_centroids, nearest, unit_matrix
from corpuslake.operators.retrieval import DIGITS, BestK, best_of, maxsim, search
from corpuslake.session import cut_lineage

MOST_CELLS = 1_024
HOT_TOKENS = 1_024          # documents with more tokens stay in pieces
QUERIES = 256               # queries scored at a time: their bounds are one number per query token and cell
WIDE = 32                   # such blocks that share the documents of a task, at most
SHARD_DOCS = 16_384         # documents of a task when there are more queries than that
STEP = 64                   # documents between two looks at the k-th scores


@dataclass(frozen=True)
class LateIndex:
    """`documents` has item_id, cells and vectors, one of each per token; `hot` has doc_id, token_id and vector."""
    documents: DataFrame
    hot: DataFrame
    centroids: np.ndarray
    radius: np.ndarray


def build_late(doc_tokens: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1,
               hot_tokens: int = HOT_TOKENS) -> LateIndex:
    """An index of `doc_id, token_id, vector`; about the square root of the number of tokens as cells if not said otherwise.

    Centroids are fitted on a bounded sample drawn by a hash of document and token; every token gets its cell. Tokens of
    null vector take no part. Documents of more than `hot_tokens` tokens are not gathered into a row.
    """
    tokens = doc_tokens.select("doc_id", "token_id", "vector").where(F.col("vector").isNotNull())
    n = tokens.count()
    drawn = tokens if n <= sample else tokens.where(
        F.pmod(F.xxhash64("doc_id", "token_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    head = drawn.orderBy("doc_id", "token_id").select("vector").toPandas()
    wanted = cells or max(1, min(MOST_CELLS, int(n ** 0.5)))
    centroids = fit_centroids(unit_matrix(head["vector"]), wanted, seed) if len(head) else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = unit_matrix(batch["vector"])
            near, far = nearest(vectors, centroids)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "token_id": batch["token_id"],
                                "vector": pd.Series(list(vectors), index=batch.index, dtype=object), "cell": near, "far": far})

    schema = T.StructType([tokens.schema["doc_id"], tokens.schema["token_id"], T.StructField("vector", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.LongType()), T.StructField("far", T.DoubleType())])
    placed = cut_lineage(tokens.mapInPandas(assign, schema), "late-placed")
    radius = np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.max("far").alias("far")).collect():  # at most one row per cell
        radius[r["cell"]] = r["far"]
    crowded = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_tokens)
    crowded = cut_lineage(crowded.select(F.col("doc_id").alias("of")), "late-hot")  # at most n / hot_tokens rows
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    ordinary = placed.join(crowded, same, "left_anti").groupBy(F.col("doc_id").alias("item_id")).agg(
        F.collect_list(F.struct("cell", "vector")).alias("tokens"))
    documents = ordinary.select("item_id", F.col("tokens.cell").alias("cells"), F.col("tokens.vector").alias("vectors"))
    return LateIndex(cut_lineage(documents, "late-documents"),
                     placed.join(crowded, same, "left_semi").select("doc_id", "token_id", "vector"), centroids, radius)


class LateScorer:
    """The queries of a task, their bounds per cell, and the best k documents so far."""

    def __init__(self, vectors: pd.Series, index_centroids: np.ndarray, radius: np.ndarray, k: int):
        sizes = vectors.map(len).to_numpy()
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.matrix = unit_matrix(pd.Series([v for query in vectors for v in query]))
        self.reach = self.matrix @ index_centroids.T + radius
        self.best = BestK(len(sizes), k)
        self.scored = 0  # pairs that the bounds did not rule out

    def add(self, ids: np.ndarray, cells: list[np.ndarray], vectors: list) -> None:
        n = len(self.starts)
        scores = np.zeros((n, len(ids)))
        valid = np.zeros((n, len(ids)), dtype=bool)
        for j, (own, tokens) in enumerate(zip(cells, vectors)):
            bound = np.add.reduceat(self.reach[:, np.unique(own)].max(axis=1), self.starts)
            # scores are compared after rounding, so a bound within a rounding step of the k-th score counts
            wanted = bound >= self.best.floor - 10.0 ** (1 - DIGITS)
            if wanted.any():
                rows = np.nonzero(wanted[self.owner])[0]
                top = (self.matrix[rows] @ np.array(list(tokens)).T).max(axis=1)
                scores[:, j] = np.bincount(self.owner[rows], top, n)
                valid[:, j] = wanted
                self.scored += int(wanted.sum())
        self.best.add(scores, ids, valid)


def search_late(query_tokens: DataFrame, index: LateIndex, k: int, block: int = QUERIES, shard: int = SHARD_DOCS,
                wide: int = WIDE) -> DataFrame:
    """Best k documents per query (`query_id, token_id, vector`): `query_id, doc_id, score, rank`, as `maxsim` gives with `k`.

    The tokens of a query are one row. Documents are copied once per `wide` blocks of queries. Documents in pieces are scored by `maxsim`; they are few, since each has many tokens.
    """
    tokens = query_tokens.select("query_id", "token_id", "vector").where(F.col("vector").isNotNull())
    heads = tokens.groupBy("query_id").agg(F.collect_list("vector").alias("vectors"))
    centroids, radius = index.centroids, index.radius

    def kernel(head: pd.DataFrame, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if head.empty:
            return
        scorer = None
        for batch in batches:
            scorer = scorer or LateScorer(head["vectors"], centroids, radius, k)
            for at in range(0, len(batch), STEP):
                part = batch.iloc[at:at + STEP]
                scorer.add(part["item_id"].to_numpy(), list(part["cells"]), list(part["vectors"]))
        if scorer:
            yield scorer.best.frame(head["query_id"].to_numpy())

    found = search(heads, index.documents, kernel, k, block, shard, wide=wide).drop("rank")
    pieces = maxsim(tokens, index.hot, k=k).select("query_id", F.col("doc_id").alias("item_id"), "score")
    return best_of(found.unionByName(pieces), k=k).withColumnRenamed("item_id", "doc_id")
