"""Operator 7, exact top-k inner product search with one KD-tree per shard.

Rows are dealt to shards of bounded size by hash, and every shard becomes a tree: median splits along the
widest side, down to small leaves, each node with the tight box of its points. A query visits the nodes of a
tree best first. The largest inner product that a box allows bounds all its points, so the search of a tree
ends when the best remaining box lies below the k-th score found so far. Queries travel in blocks: a block
first searches one shard, and takes the k-th scores it finds there to all other shards. Blocks and trees meet by a
shuffle: a written table of blocks is small, but it is unfolded once per shard, so it must not pass through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.session import cut_lineage

SHARD_ROWS = 16_384
BLOCK_QUERIES = 256
MOST_BLOCKS = 64     # beyond that, blocks grow
MOST_QUERIES = 4_096  # of a block; beyond that, there are more blocks
LEAF = 256
NO_ID = (1 << 63) - 1  # stands for a null id; ties go to smaller ids, so it comes last
LOWEST = -(1 << 63)
EXACT = 1 << 53

TREE = "shard bigint, dim int, nodes binary, boxes binary, points binary, ids binary"
FOUND = "block bigint, pilot bigint, queries array<struct<id:bigint,v:array<bigint>,kth:bigint>>, " \
        "found array<struct<query_id:bigint,query:int,vec_id:bigint,score:bigint>>"


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (left, right, first, stop), their boxes (low, high), and the order of the points. Children of a leaf are -1."""
    order = np.arange(len(points))
    nodes, boxes, waiting = [], [], [(0, len(points), -1, 0)]
    while waiting:
        first, stop, parent, side = waiting.pop()
        here = points[order[first:stop]]
        low, high = here.min(axis=0), here.max(axis=0)
        node = len(nodes)
        nodes.append([-1, -1, first, stop])
        boxes.append((low, high))
        if parent >= 0:
            nodes[parent][side] = node
        if stop - first > LEAF and (high > low).any():
            axis = int((high.astype(float) - low.astype(float)).argmax())
            middle = (stop - first) // 2
            order[first:stop] = order[first:stop][np.argpartition(here[:, axis], middle)]
            waiting += [(first, first + middle, node, 0), (first + middle, stop, node, 1)]
    return np.array(nodes, dtype=np.int32), np.array(boxes, dtype=np.int64), order


def _matrix(vectors: list[list[int]], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _narrow(points: np.ndarray) -> bytes:
    """The points in the smallest whole numbers that hold them all; their width follows from the length."""
    low, high = points.min(initial=0), points.max(initial=0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return points.astype(kind).tobytes()


def _wide(points: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(points, dtype=f"i{len(points) // (rows * dim) if dim else 8}").reshape(rows, dim).astype(np.int64)


def _trees(group: pa.Table) -> pa.Table:
    vectors = group.column("v").to_pylist()
    dim = max(map(len, vectors))
    points = _matrix(vectors, dim)
    nodes, boxes, order = build_tree(points)
    ids = np.array(group.column("id").to_pylist(), dtype=np.int64)[order]
    values = [group.column("shard")[0].as_py(), dim, nodes.tobytes(), boxes.tobytes(), _narrow(points[order]), ids.tobytes()]
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([v], t) for v, t in zip(values, types)], names=["shard", "dim", "nodes", "boxes", "points", "ids"])


def search(q: np.ndarray, own: int, kth: int, k: int, bounds: np.ndarray, nodes: np.ndarray, points: np.ndarray,
           ids: np.ndarray) -> list[tuple[int, int]]:
    """The best k (score, id) of one tree that are not below `kth`; rows with the query's own id are left out."""
    scores, names = np.zeros(0, dtype=points.dtype), np.zeros(0, dtype=np.int64)
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < kth:  # an equal bound may hide an equal score with a smaller id
            break
        left, right, first, stop = nodes[node]
        if left >= 0:
            for child in (left, right):
                if bounds[child] >= kth:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        here, mine = points[first:stop] @ q, ids[first:stop]
        good = (here >= kth) & (mine != own)
        if good.any():
            scores, names = np.concatenate([scores, here[good]]), np.concatenate([names, mine[good]])
            best = np.lexsort((names, -scores))[:k]
            scores, names = scores[best], names[best]
            if len(best) == k:
                kth = max(kth, int(scores[-1]))
    return [(int(s), int(n)) for s, n in zip(scores, names)]


def _search_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                vectors = [q["v"] for q in r["queries"]]
                dim = max([r["dim"], *map(len, vectors)])
                nodes = np.frombuffer(r["nodes"], dtype=np.int32).reshape(-1, 4)
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                wide = [(0, 0), (0, dim - r["dim"])]
                points = np.pad(_wide(r["points"], len(ids), r["dim"]), wide)
                boxes = np.pad(np.frombuffer(r["boxes"], dtype=np.int64).reshape(len(nodes), 2, -1), [(0, 0), *wide])
                queries = _matrix(vectors, dim)
                largest = float(np.abs(points.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * dim
                kind = float if largest < EXACT else object  # whole numbers are exact in both
                points, boxes, queries = points.astype(kind), boxes.astype(kind), queries.astype(kind)
                bounds = np.maximum(queries, 0) @ boxes[:, 1].T + np.minimum(queries, 0) @ boxes[:, 0].T
                found, rows = [], []
                for i, q in enumerate(r["queries"]):
                    best = search(queries[i], q["id"], q["kth"], k, bounds[i], nodes, points, ids)
                    found += [{"query_id": q["id"], "query": i, "vec_id": n, "score": s} for s, n in best]
                    rows.append({"id": q["id"], "v": q["v"], "kth": max(q["kth"], best[-1][0]) if len(best) == k else q["kth"]})
                out = {"block": [r["block"]], "pilot": [r["shard"]], "queries": [rows], "found": [found]}
                yield pa.RecordBatch.from_pydict(out, schema=_found_schema())
    return run


def _found_schema() -> pa.Schema:
    asked = pa.struct([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("kth", pa.int64())])
    hit = pa.struct([("query_id", pa.int64()), ("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return pa.schema([("block", pa.int64()), ("pilot", pa.int64()), ("queries", pa.list_(asked)), ("found", pa.list_(hit))])


def whole_vector(name: str, scale: float) -> Column:
    """floor(scale * x) of every component, or null if the vector or a component is null or not finite."""
    x = F.col(name)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(usable, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("bigint")))


def exact_topk(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
               shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, key, score): the k rows with the highest inner product for every row that `is_query` selects.

    Vectors become whole numbers, floor(scale * x), so scores are exact; ties go to the smaller id, a null id
    comes last. A row with the id of the query is the query's own. Vectors that are null or hold null or
    non-finite components take no part; of vectors of different lengths the shorter one is filled up with
    zeros; repeated query rows are asked once, repeated candidates all count. No query or no candidate gives no
    row. Other columns of `df` are not read. A score beyond 64 bits is an error.
    """
    rows = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"), whole_vector(vector, scale).alias("v"),
                     F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut_lineage(rows.where(F.col("v").isNotNull()), "topk-vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    shards = max(1, -(-counts["rows"] // shard_rows))
    blocks = max(1, min(-(-counts["queries"] // block_queries), max(MOST_BLOCKS, -(-counts["queries"] // MOST_QUERIES))))

    dealt = rows.withColumn("salt", F.monotonically_increasing_id())  # copies of one row are dealt out, too
    dealt = dealt.select(F.pmod(F.xxhash64("id", "v", "salt"), F.lit(shards)).alias("shard"), "id", "v")
    trees = cut_lineage(dealt.groupBy("shard").applyInArrow(_trees, TREE), "topk-trees")
    asked = rows.where("asks").select("id", "v").distinct().withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    asked = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "v", F.lit(LOWEST).alias("kth")))).alias("queries"))

    work = _search_blocks(k)
    first = asked.withColumn("shard", F.pmod("block", F.lit(shards))).join(trees.hint("merge"), "shard")
    first = cut_lineage(first.repartition(blocks, "block").mapInArrow(work, FOUND), "topk-pilot")
    others = first.select("block", "pilot", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"))
    others = others.where(F.col("shard") != F.col("pilot")).join(trees.hint("merge"), "shard")
    others = others.repartition(blocks * shards, "block", "shard").mapInArrow(work, FOUND)
    hits = first.select("block", F.explode("found").alias("hit")).unionAll(others.select("block", F.explode("found").alias("hit")))
    hits = hits.select("block", "hit.*")
    best = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.nullif("query_id", F.lit(NO_ID)).alias("query_id"), F.col("rank").cast("int"),
                         F.nullif("vec_id", F.lit(NO_ID)).alias(key), "score")


@query("op7_kd_tree_topk", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op7_kd_tree_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, F.pmod("vec_id", F.lit(20)) == 0)
