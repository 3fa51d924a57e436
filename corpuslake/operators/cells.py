"""Dense search in a written index of cells.

Items are dealt to the nearest of some centroids and written in the order of their cells, with the radius of every
cell. An item x of a cell is its centroid c plus a rest no longer than the radius, so a unit query q scores it at most
q c + radius. A search visits the most promising cells of each query first; the k-th best score found there rules out
all cells whose bound is below it, and only the others are visited as well. With `probes`, it stops after the first step.

Neighbouring cells share a shard, and a query goes to a shard once, with the list of the cells it visits there: on
vectors without clusters nearly all cells are visited, and a copy of the query per cell would be brute force by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.operators.contrastive import unit_rows
from corpuslake.operators.retrieval import BLOCK_QUERIES, CELLS, DIGITS, WIDE, BestK, best_of
from corpuslake.session import cut_lineage

SAMPLE = 20_000         # vectors that the centroids are fitted on, on average
MOST_CELLS = 4_096
ITEMS_PER_SHARD = 50_000  # cells share a shard up to that; a cell with more items is read by several tasks
BOUNDS = 4_000_000      # bounds of queries and cells held at a time
STEPS = 8               # of Lloyd's algorithm
FIRST = 4               # cells that an exact search visits before it knows a bound


def unit_matrix(vectors: pd.Series) -> np.ndarray:
    return unit_rows(np.array(vectors.tolist(), dtype=float))


@dataclass(frozen=True)
class Cells:
    """One entry per cell. This is what travels to the tasks."""
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray

    def shards(self) -> tuple[np.ndarray, np.ndarray]:
        """The first shard of each cell and the number of its shards; shards are numbered in the order of cells."""
        parts = np.maximum(1, -(-self.counts // ITEMS_PER_SHARD))
        first, shard, held = np.empty(len(parts), dtype=np.int64), 0, 0
        for cell, (n, own) in enumerate(zip(self.counts, parts)):
            if held and (own > 1 or held + n > ITEMS_PER_SHARD):
                shard, held = shard + 1, 0
            first[cell], held = shard, held + n
            if own > 1:
                shard, held = shard + int(own), 0
        return first, parts

    def order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each query from the most to the least promising, and the bound of every cell."""
        bounds = np.where(self.counts > 0, queries @ self.centroids.T + self.radius, -np.inf)
        return np.argsort(-(queries @ self.centroids.T) + np.where(self.counts > 0, 0.0, 10.0), axis=1, kind="stable"), bounds

    def first(self, order: np.ndarray, cells: int, k: int) -> np.ndarray:
        """How many cells of each query are visited first: `cells`, or more if those hold fewer than k items."""
        held = np.cumsum(self.counts[order], axis=1)
        return np.minimum(np.maximum(cells, (held < k).sum(axis=1) + 1), int((self.counts > 0).sum()))


@dataclass(frozen=True)
class CellIndex:
    """`items` has item_id, vector (of length one), cell and shard."""
    items: DataFrame
    cells: Cells


def fit_centroids(vectors: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from random vectors; a cell that gets none keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = vectors[np.sort(rng.choice(len(vectors), size=min(cells, len(vectors)), replace=False))].copy()
    for _ in range(STEPS):
        near = nearest(vectors, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        sizes = np.bincount(near, minlength=len(centroids))
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the distance from it."""
    near = np.empty(len(vectors), dtype=np.int64)
    step = max(1, CELLS // len(centroids))
    for at in range(0, len(vectors), step):
        part = vectors[at:at + step] @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)
        near[at:at + step] = part.argmax(axis=1)
    return near, np.sqrt(((vectors - centroids[near]) ** 2).sum(axis=1))


def build_cells(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> CellIndex:
    """An index of `item_id, vector`; about the square root of the number of items as cells if not said otherwise.

    Centroids are fitted on a bounded sample drawn by a hash of the item; every item is then written with its cell. Only
    the centroids and one radius and count per cell are on the driver.
    """
    corpus = corpus.select("item_id", "vector").where(F.col("vector").isNotNull())
    n = corpus.count()
    drawn = corpus if n <= sample else corpus.where(
        F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    head = drawn.orderBy("item_id").toPandas() if n else pd.DataFrame()
    if not len(head):
        empty = corpus.withColumns({"cell": F.lit(0), "shard": F.lit(0)})
        return CellIndex(cut_lineage(empty, "cells"), Cells(np.zeros((1, 1)), np.zeros(1), np.zeros(1, dtype=np.int64)))
    centroids = fit_centroids(unit_matrix(head["vector"]), cells or max(1, min(MOST_CELLS, int(n ** 0.5))), seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = unit_matrix(batch["vector"])
            near, far = nearest(vectors, centroids)
            yield pd.DataFrame({"item_id": batch["item_id"], "vector": pd.Series(list(vectors), dtype=object), "cell": near, "far": far})

    schema = T.StructType([corpus.schema["item_id"], T.StructField("vector", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.LongType()), T.StructField("far", T.DoubleType())])
    placed = cut_lineage(corpus.mapInPandas(assign, schema), "cells-placed")
    radius, counts = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], counts[r["cell"]] = r["far"], r["n"]
    made = Cells(centroids, radius, counts)
    first, parts = (F.element_at(F.lit(n.tolist()).cast("array<bigint>"), (F.col("cell") + 1).cast("int")) for n in made.shards())
    dealt = placed.select("item_id", "vector", "cell", (first + F.pmod(F.xxhash64("item_id"), parts)).alias("shard"))
    # in the order of cells, so that a search reads the row groups of the cells it visits
    items = cut_lineage(dealt.repartition("cell", "shard").sortWithinPartitions("cell"), "cells")
    return CellIndex(items, made)


def _visit(heads: DataFrame, index: CellIndex, k: int, n_queries: int) -> DataFrame:
    """The best k items of each query in each shard it visits; `heads` is query_id, vector and visits (shard, cells)."""
    shards = int(sum(index.cells.shards()).max())
    tiles = -(-n_queries // BLOCK_QUERIES) * shards
    wide = max(1, min(WIDE, tiles // (2 * heads.sparkSession.sparkContext.defaultParallelism)))
    blocks = max(1, -(-n_queries // (BLOCK_QUERIES * wide)))
    heads = heads.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    heads = cut_lineage(heads, "cells-visited")
    left = heads.select("query_id", "vector", "block", F.explode("visits").alias("visit")).select("query_id", "vector", "block", "visit.*")
    # cells of no query are not read any further
    asked = heads.select("block", F.explode("visits").alias("visit")).select("block", "visit.shard", F.explode("visit.cells").alias("cell"))
    asked = asked.distinct().toDF("block", "s", "c")
    right = index.items.join(asked, F.expr("cell = c AND shard = s")).drop("c", "s")
    schema = T.StructType([heads.schema["query_id"], index.items.schema["item_id"], T.StructField("score", T.DoubleType())])

    def found(qs: pd.DataFrame, items: np.ndarray, ids: np.ndarray, firsts: dict[int, tuple[int, int]]) -> pd.DataFrame:
        best, matrix = BestK(len(qs), k), np.array(qs["vector"].tolist())
        visited = np.concatenate(qs["cells"].to_numpy())
        visitor = np.repeat(np.arange(len(qs)), qs["cells"].map(len))
        order = np.argsort(visited, kind="stable")
        cells, starts = np.unique(visited[order], return_index=True)
        for cell, rows in zip(cells, np.split(visitor[order], starts[1:])):
            start, stop = firsts.get(cell, (0, 0))
            step = max(1, CELLS // len(rows))
            for at in range(start, stop, step):
                here = slice(at, min(stop, at + step))
                best.add(matrix[rows] @ items[here].T, ids[here], rows=rows)
        return best.frame(qs["query_id"].to_numpy())

    def tile(qs: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or its.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        its = its.sort_values("cell", kind="stable")
        cells, starts = np.unique(its["cell"].to_numpy(), return_index=True)
        firsts = dict(zip(cells.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(its)])))
        items, ids = np.array(its["vector"].tolist()), its["item_id"].to_numpy()
        return pd.concat([found(qs.iloc[at:at + BLOCK_QUERIES], items, ids, firsts) for at in range(0, len(qs), BLOCK_QUERIES)])

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(tile, schema)


def _visits(chosen: np.ndarray, first: np.ndarray, parts: np.ndarray) -> pa.Array:
    """A list per query of the shards it visits, each with the list of its cells; `chosen` marks the cells of each query."""
    row, cell = np.nonzero(chosen)  # cells in ascending order, so those of one shard lie together
    copies = parts[cell]
    shard = np.repeat(first[cell], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    row, cell = np.repeat(row, copies), np.repeat(cell, copies)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
    starts = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), pa.array(cell, pa.int32()))
    visits = pa.StructArray.from_arrays([pa.array(shard[starts], pa.int64()), lists], ["shard", "cells"])
    ends = np.searchsorted(row[starts], np.arange(len(chosen) + 1), side="left")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), visits)


def search_cells(queries: DataFrame, index: CellIndex, k: int, probes: int | None = None) -> DataFrame:
    """Best k items per query: `query_id, item_id, score, rank`, the same as `dense_topk` gives.

    With `probes` only that many cells of each query are visited (more if they hold fewer than k items), and items of
    other cells can be missed.
    """
    queries = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    visit = T.ArrayType(T.StructType([T.StructField("shard", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    schema = T.StructType([queries.schema["query_id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("visits", visit)])
    n, cells, shards = queries.count(), index.cells, index.cells.shards()

    def expand(batch: pa.RecordBatch, floor: np.ndarray | None) -> pa.RecordBatch:
        vectors = unit_matrix(batch.column(1).to_pandas())
        order, bounds = cells.order(vectors)
        early = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(early, order, np.arange(order.shape[1])[None, :] < cells.first(order, probes or FIRST, k)[:, None], axis=1)
        chosen = early
        if floor is not None:  # scores are compared after rounding, so a bound within a rounding step of the floor counts
            chosen = (bounds >= floor[:, None] - 10.0 ** (1 - DIGITS)) & ~early & (cells.counts > 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, _visits(chosen, *shards)], ["query_id", "vector", "visits"])

    def run(late: bool):
        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, BOUNDS // len(cells.counts))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    yield expand(part, part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False) if late else None)
        return pieces

    if not cells.counts.sum():
        nothing = queries.withColumn("item_id", F.lit(None).cast(index.items.schema["item_id"].dataType)).withColumn("score", F.lit(0.0))
        return best_of(nothing.select("query_id", "item_id", "score").limit(0), k=k)
    found = best_of(_visit(queries.mapInArrow(run(False), schema), index, k, n), k=k)
    if probes:
        return found
    found = cut_lineage(found, "cells-first")
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("floor"))
    rest = queries.join(floors, F.col("query_id") == F.col("of"), "left").drop("of").mapInArrow(run(True), schema)
    return best_of(found.drop("rank").unionByName(_visit(rest, index, k, n)), k=k)
