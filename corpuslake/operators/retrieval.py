"""Dense, keyword and fused search.

Exact search compares every query with every item. The comparisons run as matrix products inside
tasks that keep a running best k per query; what leaves a task is at most k rows per query, never a
row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.text import explode_values
from corpuslake.functions.vectors import dot, l2_normalize
from corpuslake.operators.contrastive import unit_rows
from corpuslake.operators.ordering import with_rank
from corpuslake.session import cut_lineage

BLOCK_QUERIES = 4_096       # queries sent to every task
SHARD_ITEMS = 100_000       # items of one tile when there are more queries than that
WIDE = 8                    # blocks of queries that share the items of a tile, at most
TILE_STEP = 8_192           # items of a tile that a kernel gets at a time
TILE_QUERIES = 512          # queries and items of a product in single precision, which stays in a core's cache
TILE_ITEMS = 1_024
SEED_ITEMS = 4_096          # items that the first bounds come from
CELLS = 2_000_000           # scores held at a time
TILE_ROWS = 4_000_000       # rows that a tile of late interaction gives, about
MERGES = 64                 # groups per query in the first step of the final ranking
DIGITS = 9                  # scores are compared at this many decimals
ROUNDING = 10.0 ** (1 - DIGITS)  # more than rounding can move a score
MODEL_WORDS = r"[\p{L}\p{N}]+"


class BestK:
    """The k best items of each query seen so far: score descending, item ascending.

    Only scores that reach a query's k-th best are rounded and sorted in. `extra` computes a second number for the pairs
    (query, item) that are kept.
    """

    def __init__(self, queries: int, k: int, extra: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.k = k
        self.extra = extra
        self.floor = np.full(queries, -np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.items: np.ndarray | None = None  # ids of any type that can be sorted
        self.scores = np.empty(0)
        self.extras = np.empty(0)

    def add(self, scores: np.ndarray, items: np.ndarray, valid: np.ndarray | None = None, rows: np.ndarray | None = None) -> None:
        """Scores of all queries, or of those in `rows`, in some items; pairs that are not `valid` are left out."""
        floor = self.floor if rows is None else self.floor[rows]
        near = scores >= (floor - ROUNDING)[:, None]
        if valid is not None:
            near &= valid
        n = scores.shape[1]
        if n > self.k and np.count_nonzero(near) > 2 * self.k * len(near):
            top = scores if valid is None else np.where(valid, scores, -np.inf)
            near &= scores >= (np.partition(top, n - self.k, axis=1)[:, n - self.k] - ROUNDING)[:, None]
        at, j = np.nonzero(near)
        if not len(at):
            return
        new = np.round(scores[at, j], DIGITS)
        at, j, new = at[new > -np.inf], j[new > -np.inf], new[new > -np.inf]
        source = np.concatenate([np.full(len(self.q), -1), np.arange(len(at))])
        q = np.concatenate([self.q, at if rows is None else rows[at]])
        found = np.concatenate([self.scores, new])
        ids = items[j] if self.items is None else np.concatenate([self.items, items[j]])
        place_of = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]  # ids can be strings
        order = np.lexsort((place_of, -found, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order], side="left")
        keep = place < self.k
        order, place = order[keep], place[keep]
        if self.extra is not None:
            extras = np.concatenate([self.extras, np.zeros(len(at))])[order]
            fresh = source[order] >= 0
            extras[fresh] = self.extra(q[order][fresh], j[source[order][fresh]])
            self.extras = extras
        self.q, self.scores, self.items = q[order], found[order], ids[order]
        full = place == self.k - 1
        self.floor[self.q[full]] = self.scores[full]

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": query_ids[self.q], "item_id": [] if self.items is None else self.items, "score": self.scores})
        return out if self.extra is None else out.assign(extra=self.extras)


Kernel = Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def meet(heads: DataFrame, items: DataFrame, kernel: Kernel, schema: T.StructType, block: int, shard: int,
         spread: Sequence[str], wide: int = WIDE) -> tuple[DataFrame, int]:
    """Run `kernel` so that every head row meets every item row, in tasks of bounded size.

    Up to `block` heads (counted first) travel to every task and the items stay where they are.
    More heads are cut into blocks and the items, by a hash of the `spread` columns, into shards; every block meets every
    shard once. Up to `wide` blocks share a tile, so that the items are copied less often, as long as there are
    several tiles per core. In a tile the kernel runs block by block and gets `TILE_STEP` items at a time.

    Returns what the kernels give and the number of shards (0: a head's results come from any number of tasks).
    """
    head = heads.limit(block + 1).toPandas()
    if len(head) <= block:
        return items.mapInPandas(lambda batches: kernel(head, batches), schema), 0
    n_heads, n_shards = heads.count(), max(1, -(-items.count() // shard))
    single = -(-n_heads // block) * n_shards
    n_blocks = -(-n_heads // (block * max(1, min(wide, single // (2 * items.sparkSession.sparkContext.defaultParallelism)))))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = heads.withColumn("qb", F.pmod(F.xxhash64(*heads.columns[:2]), F.lit(n_blocks))).withColumn("ib", numbers(n_shards))
    right = items.withColumn("ib", F.pmod(F.xxhash64(*spread), F.lit(n_shards))).withColumn("qb", numbers(n_blocks))

    def tile(qs: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for at in range(0, len(qs) if len(its) else 0, block):
            steps = (its.iloc[i:i + TILE_STEP].reset_index(drop=True) for i in range(0, len(its), TILE_STEP))
            frames += kernel(qs.iloc[at:at + block].reset_index(drop=True), steps)
        return pd.concat(frames) if frames else pd.DataFrame({f.name: [] for f in schema})

    left = left.toDF(*left.columns)  # columns of its own, in case a table is searched with itself
    return left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(tile, schema), n_shards


def search(queries: DataFrame, items: DataFrame, kernel: Kernel, k: int, block: int = BLOCK_QUERIES,
           shard: int = SHARD_ITEMS, extra: bool = False, wide: int = WIDE) -> DataFrame:
    """Best k items per query: `query_id, item_id, score, rank`, and `extra` if the kernel gives that."""
    schema = T.StructType([queries.schema["query_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())])
    if extra:
        schema = schema.add("extra", T.DoubleType())
    return best_of(*meet(queries, items, kernel, schema, block, shard, ["item_id"], wide), k=k)


def best_of(found: DataFrame, parts: int = 0, *, k: int) -> DataFrame:
    """The best k of what tasks hand in, k rows per query each at most.

    They are merged in two steps, first by query and a hash of the item, so the last group of a query holds k rows for
    each of `MERGES` hashes, however many tasks there were. If it is known that no more than `MERGES` `parts` hand in
    rows of a query, one step does.
    """
    order = [("score", "desc"), "item_id"]
    if not 0 < parts <= MERGES:
        salted = found.withColumn("__salt", F.pmod(F.xxhash64("item_id"), F.lit(MERGES)))
        found = with_rank(salted, order, ["query_id", "__salt"], "rank", limit=k, bounded=True).drop("__salt", "rank")
    return with_rank(found, order, ["query_id"], "rank", limit=k, bounded=True)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return unit_rows(np.array(vectors.tolist(), dtype=float))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    """Cosine search of `query_id, vector` in `item_id, vector`."""

    def kernel(head: pd.DataFrame, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if head.empty:
            return
        matrix, best = _matrix(head["vector"]), BestK(len(head), k)
        step = max(1, CELLS // len(head))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                best.add(matrix @ _matrix(part["vector"]).T, part["item_id"].to_numpy())
        yield best.frame(head["query_id"].to_numpy())

    return search(queries.select("query_id", "vector"), corpus.select("item_id", "vector"), kernel, k, **kw)


def model_words(text: Column | str) -> Column:
    """Lower-case words for keyword search."""
    return F.regexp_extract_all(F.lower(text), F.lit(MODEL_WORDS), F.lit(0))


def bm25(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, **kw) -> DataFrame:
    """Keyword search of `query_id, text` in `item_id, text`.

    Each distinct query word t adds ln(1 + (N - df + 0.5) / (df + 0.5)) x tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)).
    The texts are split once: what is written per document is its length and its occurrences of query words, from which
    all counts follow. The query words are written first, so that their join is a broadcast exactly when they are small.
    Scores are summed inside tasks.
    """
    asked = cut_lineage(explode_values(queries, F.array_distinct(model_words("text")), "word", "query_id"), "query-words")
    numbered = cut_lineage(with_rank(asked.select("word").distinct(), ["word"], (), "term"), "query-terms")
    docs = corpus.select("item_id", model_words("text").alias("words")).select("item_id", F.size("words").alias("dl"), "words")
    words = docs.select("item_id", "dl", F.explode_outer("words").alias("word")).join(numbered, "word", "left")
    split = cut_lineage(words.groupBy("item_id", "dl").agg(F.collect_list("term").alias("terms")), "query-hits")
    totals = split.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = totals["n"], totals["avgdl"] or 1.0
    items = split.where(F.size("terms") > 0)
    counts = explode_values(items, F.array_distinct("terms"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = counts.join(numbered, "term")
    idf = F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    heads = asked.join(frequency, "word").groupBy("query_id").agg(
        F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms"))

    def kernel(head: pd.DataFrame, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if head.empty:
            return
        postings = sorted((t["term"], q, t["idf"]) for q, terms in enumerate(head["terms"]) for t in terms)
        terms, places, idfs = (np.array(column) for column in zip(*postings))
        best = BestK(len(head), k)
        step = max(1, CELLS // len(postings))  # a document meets a posting at most once
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                sizes = part["terms"].map(len).to_numpy()
                found = np.stack([np.repeat(np.arange(len(part)), sizes), np.concatenate(part["terms"].to_numpy())])
                (doc, term), tf = np.unique(found, axis=1, return_counts=True)
                dl = part["dl"].to_numpy()[doc]
                weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                first, last = np.searchsorted(terms, term, "left"), np.searchsorted(terms, term, "right")
                n = last - first
                row = np.repeat(np.arange(len(n)), n)
                at_posting = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
                cell = places[at_posting] * len(part) + doc[row]
                scores = np.bincount(cell, idfs[at_posting] * weight[row], len(head) * len(part)).reshape(len(head), len(part))
                best.add(scores, part["item_id"].to_numpy(), scores > 0)
        yield best.frame(head["query_id"].to_numpy())

    return search(heads, items, kernel, k, **kw)


def rrf(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """Fused score: sum of 1 / (k + rank) over the rankings that hold the item."""
    rows = rankings[0].select("query_id", "item_id", "rank")
    for other in rankings[1:]:
        rows = rows.unionByName(other.select("query_id", "item_id", "rank"))
    return rows.groupBy("query_id", "item_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def adaptive_k(df: DataFrame, n: int | None = None, **kw) -> DataFrame:
    """Keep each query's hits down to the largest score gap among its first n (all unless given); adds `rank`."""
    head = with_rank(df, [("score", "desc"), "item_id"], ["query_id"], "rank", limit=n, **kw)
    whole = Window.partitionBy("query_id")  # the hits of one query
    gap = F.col("score") - F.lead("score").over(whole.orderBy("rank"))
    rows = head.withColumn("__gap", gap)
    best = F.max_by("rank", F.when(F.col("__gap").isNotNull(), F.struct("__gap", -F.col("rank")))).over(whole)
    return rows.withColumn("__cut", F.coalesce(best, F.lit(1))).where(F.col("rank") <= F.col("__cut")).drop("__gap", "__cut")


def threshold_scores(df: DataFrame, threshold: float = 0.75, fallback: DataFrame | None = None,
                     queries: DataFrame | None = None) -> DataFrame:
    """Hits whose logistic score is above the threshold, with `status` kept.

    A query without any gives one row of status none, or its rows of `fallback`. `queries` (query_id) lists all that were
    asked, so that a query without a single hit is reported, too; without it only those with hits can be.
    """
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    rows = df.select("query_id", "item_id", "score", probability.alias("probability"))
    kept = rows.where(F.col("probability") > threshold)
    everyone = (rows if queries is None else queries).select("query_id").distinct()
    empty = everyone.join(kept.select("query_id"), "query_id", "left_anti")
    if fallback is None:
        rest = empty.select("query_id", F.lit(None).cast(rows.schema["item_id"].dataType).alias("item_id"),
                            F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"),
                            F.lit("none").alias("status"))
    else:
        rest = fallback.select("query_id", "item_id", "score", probability.alias("probability")) \
            .join(empty, "query_id", "left_semi").withColumn("status", F.lit("fallback"))
    return kept.withColumn("status", F.lit("kept")).unionByName(rest)


def tag_prefilter(chunks: DataFrame, tags: Sequence[str], column: str = "tags") -> DataFrame:
    """Chunks that carry one of the tags; to be applied before ranking, so that k hits remain."""
    return chunks.where(F.arrays_overlap(column, F.array(*[F.lit(t) for t in tags])))


class PrefixBest:
    """The `top` best items of some queries by their first `d` dimensions, each with its score by all of them.

    Items have to come in the order of their ids, so that of equal ones the first stay. Products are taken in single
    precision, tile by tile of a size that stays in a core's cache; pairs within their error bound of a query's floor are
    scored again in double precision, and nothing else is.
    """

    def __init__(self, vectors: np.ndarray, d: int, top: int):
        self.d, self.top = d, top
        self.slack = (min(d, vectors.shape[1]) + 4) * 2.0 ** -24 + ROUNDING  # more than the error of a product
        self.whole, self.short = unit_rows(vectors), unit_rows(vectors[:, :d])
        self.near = self.short.astype(np.float32)
        self.scores = np.full((len(vectors), top), -np.inf)  # best first, compared at DIGITS
        self.fines = np.zeros((len(vectors), top))
        self.ids: np.ndarray | None = None
        self.bounds = np.full(len(vectors), -np.inf, dtype=np.float32)  # no product below can be among the best
        self.waiting: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(0, len(vectors), TILE_QUERIES)]

    def _block(self, b: int) -> slice:
        return slice(b * TILE_QUERIES, min(len(self.near), (b + 1) * TILE_QUERIES))

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        short = unit_rows(vectors[:, :self.d])
        known = np.isfinite(short).all(axis=1)  # others are nobody's best
        whole, short, ids = unit_rows(vectors[known]), short[known], ids[known]
        near = short.astype(np.float32)
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
            if len(near) > self.top:
                self._guess(near[:SEED_ITEMS])
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(object)
        products, mask = np.empty(TILE_QUERIES * TILE_ITEMS, dtype=np.float32), np.empty(TILE_QUERIES * TILE_ITEMS, dtype=bool)
        for b, waiting in enumerate(self.waiting):
            here = self._block(b)
            queries, rows = self.near[here], here.stop - here.start
            for at in range(0, len(near), TILE_ITEMS):
                part = near[at:at + TILE_ITEMS]
                found, high = (space[:rows * len(part)].reshape(rows, len(part)) for space in (products, mask))
                np.matmul(queries, part.T, out=found)
                np.greater_equal(found, self.bounds[here, None], out=high)
                q, j = np.divmod(marked(high), len(part))
                for i in range(0, len(q), TILE_STEP):  # few at a time, also where there is no bound yet
                    self._wait(waiting, here, q[i:i + TILE_STEP], j[i:i + TILE_STEP] + at, whole, short, ids)
                if 2 * sum(len(w[0]) for w in waiting) >= rows * self.top:
                    self._merge(b)

    def _guess(self, near: np.ndarray) -> None:
        """Bounds from the first items, so that not all of them have to be taken in."""
        for b in range(len(self.waiting)):
            if len(near) > self.top:
                products = self.near[self._block(b)] @ near.T
                self.bounds[self._block(b)] = np.partition(products, -self.top, axis=1)[:, -self.top] - np.float32(2 * self.slack)

    def _wait(self, waiting: list, here: slice, q: np.ndarray, j: np.ndarray, whole: np.ndarray, short: np.ndarray, ids: np.ndarray) -> None:
        scores = np.round(np.einsum("pd,pd->p", self.short[here][q], short[j]), DIGITS)
        better = scores > self.scores[here, -1][q]
        if better.any():
            q, j, scores = q[better], j[better], scores[better]
            fines = np.round(np.einsum("pd,pd->p", self.whole[here][q], whole[j]), DIGITS)
            waiting.append((q, scores, fines, ids[j]))

    def _merge(self, b: int) -> None:
        """What waits takes its places. Of equal scores those that came first stay."""
        if not self.waiting[b]:
            return
        here, (q, scores, fines, ids) = self._block(b), map(np.concatenate, zip(*self.waiting[b]))
        rows = here.stop - here.start
        q = np.concatenate([np.repeat(np.arange(rows), self.top), q])
        scores = np.concatenate([self.scores[here].ravel(), scores])
        order = by_score(q, scores)
        sizes = np.bincount(q, minlength=rows)
        order = order[np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < self.top]
        self.scores[here] = scores[order].reshape(rows, self.top)
        self.fines[here] = np.concatenate([self.fines[here].ravel(), fines])[order].reshape(rows, self.top)
        self.ids[here] = np.concatenate([self.ids[here].ravel(), ids])[order].reshape(rows, self.top)
        self.bounds[here] = np.maximum(self.bounds[here], (self.scores[here, -1] - self.slack).astype(np.float32))
        self.waiting[b].clear()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query (its place), item, score by the first dimensions, score by all; by query, best first."""
        for b in range(len(self.waiting)):
            self._merge(b)
        q, place = np.nonzero(self.scores > -np.inf)
        ids = np.empty(0, dtype=object) if self.ids is None else self.ids[q, place]
        return q, ids, self.scores[q, place], self.fines[q, place]


def by_score(q: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by `q` (below `TILE_QUERIES`), score descending and place. Scores are cosines rounded to `DIGITS`, so all three
    fit in one whole number, which sorts many times as fast as the columns do."""
    bits = len(q).bit_length()
    if int(TILE_QUERIES).bit_length() + 32 + bits > 63:
        return np.lexsort((-scores, q))
    low = np.clip(np.rint((1.0 - scores) * 10.0 ** DIGITS) + 1, 0, 2.0 ** 32 - 1).astype(np.int64)  # the last for none
    return np.sort((((q << 32) + low) << bits) + np.arange(len(q))) & ((1 << bits) - 1)


def marked(mask: np.ndarray) -> np.ndarray:
    """Places of the few true ones, in their order; eight are looked at in one step."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64) != 0)
    word, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + bit


def _flat(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    sizes = pc.list_value_length(vectors)
    if vectors.null_count or len(vectors) and pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors have to be of one length and not null")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _ids(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    ids = np.empty(len(column), dtype=object)
    ids[:] = column.to_pylist()
    return ids


def _best_rows(best: PrefixBest, query_ids: pa.Array, item_type: pa.DataType, k: int | None) -> pa.RecordBatch:
    """What was found: the candidates with both scores, or if nothing else can come in, the best `k` by all dimensions."""
    q, ids, scores, fines = best.rows()
    if k is None:
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), pa.array(ids, item_type), pa.array(scores), pa.array(fines)],
                                          ["query_id", "item_id", "score", "extra"])
    codes = query_ids.dictionary_encode(null_encoding="encode").indices.to_numpy()[q]  # rows of one query id are one query

    def first(order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.bincount(codes[order]) if len(order) else np.empty(0, dtype=np.int64)
        places = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return order[places < n], places[places < n]

    place_of = ids if ids.dtype.kind in "iu" else pd.factorize(ids, sort=True)[0]
    kept, _ = first(np.lexsort((place_of, -scores, codes)), best.top)
    fine = np.where(np.isnan(fines), np.inf, fines)  # as Spark orders them
    order, places = first(kept[np.lexsort((place_of[kept], -fine[kept], codes[kept]))], k)
    return pa.RecordBatch.from_arrays([query_ids.take(pa.array(q[order])), pa.array(ids[order], item_type), pa.array(fines[order]),
                                       pa.array(places + 1, pa.int64())], ["query_id", "item_id", "score", "rank"])


def matryoshka_search(queries: DataFrame, corpus: DataFrame, d: int, top: int, k: int, block: int = BLOCK_QUERIES,
                      shard: int | None = None, wide: int = WIDE) -> DataFrame:
    """Candidates by the first d dimensions, ranked again by all of them.

    A task that takes a pair into its best `top` has both vectors at hand and scores it by all dimensions at once, so
    vectors are not joined to the candidates afterwards. Up to `block` queries travel to every task. More are cut into
    blocks of a quarter to `wide` times as many (two per core if that allows it), and a task streams the items past its
    block, so that it hands on the final k rows per query; it holds the block and one batch of items. With fewer blocks
    than that and many items, or if `shard` is given, the items are cut, too, and tasks hand on candidates.

    Of items with equal first dimensions only the first `top` can be candidates; the others are left out before they are copied.
    """
    heads, items = queries.select("query_id", "vector"), corpus.select("item_id", "vector")
    query_id, item_id = heads.schema["query_id"], items.schema["item_id"]
    candidates = T.StructType([query_id, item_id, T.StructField("score", T.DoubleType()), T.StructField("extra", T.DoubleType())])
    ranked = T.StructType([query_id, item_id, T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
    head = heads.limit(block + 1).toArrow()

    def stream(best: PrefixBest, batch: pa.RecordBatch) -> None:
        step = max(1, CELLS // best.whole.shape[1])
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            best.add(_flat(part.column("vector")), _ids(part.column("item_id")))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All queries against the items of a task."""
        if not head.num_rows:
            return
        table = head.combine_chunks()
        best, item_type = PrefixBest(_flat(table["vector"].chunk(0)), d, top), None
        for batch in batches:
            item_type = batch.column("item_id").type
            stream(best, batch)
        if item_type is not None:
            yield _best_rows(best, table["query_id"].chunk(0), item_type, None)

    def past(final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Tile by tile, its queries (even `turn`) before its items (odd)."""
            tile, ids, vectors, best, item_type = None, [], [], None, None
            for batch in batches:
                turns = batch.column("turn").to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)] if len(turns) else []
                for start, stop in zip(starts, starts[1:]):
                    part, turn = batch.slice(start, stop - start), int(turns[start])
                    if turn // 2 != tile:
                        if best is not None:
                            yield _best_rows(best, pa.concat_arrays(ids), item_type, k if final else None)
                        tile, ids, vectors, best = turn // 2, [], [], None
                    if turn % 2 == 0:
                        ids.append(part.column("query_id"))
                        vectors.append(_flat(part.column("vector")))
                    elif ids:
                        if best is None:
                            best, item_type = PrefixBest(np.concatenate(vectors), d, top), part.column("item_id").type
                            vectors.clear()
                        stream(best, part)
            if best is not None:
                yield _best_rows(best, pa.concat_arrays(ids), item_type, k if final else None)
        return run

    if head.num_rows <= block:
        found, n_shards = items.sortWithinPartitions("item_id").mapInArrow(beside, candidates), 0
    else:
        cores = items.sparkSession.sparkContext.defaultParallelism
        n_heads, n_items = heads.count(), corpus.count()
        fewest, most = -(-n_heads // (block * wide)), -(-n_heads // max(1, block // 4))
        n_blocks = min(most, -(-max(fewest, 2 * cores) // cores) * cores)
        n_shards = max(1, min(-(-n_items // (shard or SHARD_ITEMS)), n_items if shard else -(-2 * cores // n_blocks)))

        def numbers(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

        items = with_rank(items.withColumn("__short", F.slice("vector", 1, d)), ["item_id"], ["__short"], "__copy", limit=top, bounded=True)
        left = heads.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn("s", numbers(n_shards))
        right = items.withColumn("s", F.pmod(F.xxhash64("item_id"), F.lit(n_shards))).withColumn("b", numbers(n_blocks))
        tile = F.col("b") * n_shards + F.col("s")
        left = left.select((2 * tile).alias("turn"), "query_id", F.lit(None).cast(item_id.dataType).alias("item_id"), "vector")
        right = right.select((2 * tile + 1).alias("turn"), F.lit(None).cast(query_id.dataType).alias("query_id"), "item_id", "vector")
        rows = left.unionByName(right).repartitionById(n_blocks * n_shards, F.expr("CAST(turn DIV 2 AS INT)"))
        rows = rows.sortWithinPartitions("turn", "item_id")
        if n_shards == 1:
            return rows.mapInArrow(past(True), ranked)
        found = rows.mapInArrow(past(False), candidates)
    coarse = best_of(found, n_shards, k=top)
    rows = coarse.select("query_id", "item_id", F.col("extra").alias("score"))
    return with_rank(rows, [("score", "desc"), "item_id"], ["query_id"], "rank", limit=k, bounded=True)


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, block: int = BLOCK_QUERIES, shard: int = SHARD_ITEMS,
           flush: int = 1_000, k: int | None = None, wide: int = WIDE) -> DataFrame:
    """Late interaction: per query token the best document token, summed per query and document.

    With `k` only the best k documents of each query are returned, with their `rank`.

    `query_tokens(query_id, token_id, vector)`, `doc_tokens(doc_id, token_id, vector)`. Tokens of a
    document are reduced to one maximum per query token inside each task and may lie in many tasks,
    so a document with very many tokens is neither gathered nor more rows than others. A task holds `CELLS` similarities
    at a time, and a tile gives no more than about `TILE_ROWS` rows: with many documents, tiles are smaller.
    """
    heads = query_tokens.select("query_id", "token_id", "vector")
    schema = T.StructType([heads.schema["query_id"], heads.schema["token_id"], doc_tokens.schema["doc_id"],
                           T.StructField("best", T.DoubleType())])

    def kernel(head: pd.DataFrame, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if head.empty:
            return
        matrix, best = _matrix(head["vector"]), {}
        step, most = max(1, CELLS // len(head)), max(1, min(flush, CELLS // len(head)))

        def rows() -> pd.DataFrame:
            frames = [pd.DataFrame({"query_id": head["query_id"], "token_id": head["token_id"], "doc_id": doc, "best": value})
                      for doc, value in best.items()]
            best.clear()
            return pd.concat(frames)

        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step].sort_values("doc_id", kind="stable")
                docs, starts = np.unique(part["doc_id"].to_numpy(), return_index=True)
                for i in range(0, len(docs), most):
                    first, last = starts[i], starts[i + most] if i + most < len(docs) else len(part)
                    sims = matrix @ _matrix(part["vector"].iloc[first:last]).T
                    tops = np.maximum.reduceat(sims, starts[i:i + most] - first, axis=1).T
                    for doc, value in zip(docs[i:i + most], tops):
                        best[doc] = np.maximum(best[doc], value) if doc in best else value.copy()
                    if len(best) >= most:
                        yield rows()
        if best:
            yield rows()

    items = doc_tokens.select("doc_id", "token_id", "vector")
    docs = items.select("doc_id").distinct().count()
    if docs > TILE_ROWS // block:
        shard = min(shard, max(1, TILE_ROWS // block))
    wide = min(wide, TILE_ROWS // (block * max(1, min(shard, docs))))
    partial, _ = meet(heads, items, kernel, schema, block, shard, ["doc_id", "token_id"], wide)
    per_token = partial.groupBy("query_id", "doc_id", "token_id").agg(F.max("best").alias("best"))
    scores = per_token.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score"))
    if k is None:
        return scores
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    return with_rank(rounded, [("score", "desc"), "doc_id"], ["query_id"], "rank", limit=k, bounded=True)


def rerank(df: DataFrame, score: Column, depth: int | None = None, **kw) -> DataFrame:
    """The candidates of each query (the best `depth` if that is given), scored again by a column expression.

    Few rows carry the whole cost here, so they are dealt out evenly before scoring, not by bytes.
    """
    head = with_rank(df, [("score", "desc"), "item_id"], ["query_id"], "first_rank", limit=depth, **kw)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = head.repartition(tasks, "query_id", "item_id").withColumn("score", score)
    return with_rank(scored, [("score", "desc"), "item_id"], ["query_id"], "rank", bounded=True)


def distinct_words(text: Column | str) -> Column:
    return F.array_distinct(model_words(text))


def word_overlap(asked: Column | str, words: Column | str) -> Column:
    """Share of the asked words among the words; both are lists of distinct words, split once per text."""
    n = F.size(asked)
    return F.when(n > 0, F.size(F.array_intersect(asked, words)) / n).otherwise(F.lit(0.0))


def term_overlap(query: Column | str, text: Column | str) -> Column:
    """Default second-stage score: share of the query's distinct words found in the text."""
    return word_overlap(distinct_words(query), distinct_words(text))


def mine_hard_negatives(queries: DataFrame, corpus: DataFrame, positives: DataFrame, depth: int, **kw) -> DataFrame:
    """The `depth` nearest items of each query without its known positives (`query_id, item_id`).

    A query of which nothing remains has an empty list.
    """
    near = dense_topk(queries, corpus, depth, **kw)
    wrong = near.join(positives.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    lists = wrong.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("found"))
    lists = lists.select("query_id", F.transform("found", lambda s: s["item_id"]).alias("hard_negatives"))
    none = F.array().cast(lists.schema["hard_negatives"].dataType)
    return queries.select("query_id").distinct().join(lists, "query_id", "left") \
        .select("query_id", F.coalesce("hard_negatives", none).alias("hard_negatives"))


def hybrid_search(queries: DataFrame, corpus: DataFrame, vectors: DataFrame, k: int, depth: int,
                  tags: Sequence[str] | None = None, cut: bool = False, threshold: float | None = None, **kw) -> DataFrame:
    """Dense and keyword search fused by rank.

    `queries(query_id, text, vector)`, `corpus(item_id, text [, tags])`, `vectors(item_id, vector)`.
    Tags filter both sides before ranking; with `cut` the fused list ends at its largest score gap. With `threshold` only
    dense hits above it take part, and a query without any falls back to all of its dense hits.
    """
    if tags is not None:
        corpus = tag_prefilter(corpus, tags)
        vectors = vectors.join(corpus.select("item_id"), "item_id", "left_semi")
    dense = dense_topk(queries, vectors, depth, **kw)
    if threshold is not None:
        dense = cut_lineage(dense, "dense-hits")
        passed = threshold_scores(dense, threshold, fallback=dense, queries=queries)
        dense = dense.join(passed.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
        dense = with_rank(dense.drop("rank"), [("score", "desc"), "item_id"], ["query_id"], "rank", bounded=True)
    words = bm25(queries, corpus, depth, **kw)
    fused = rrf(dense, words)
    fused = fused.withColumn("score", F.round("score", DIGITS))
    ranked = with_rank(fused, [("score", "desc"), "item_id"], ["query_id"], "rank", limit=k, bounded=True)
    return adaptive_k(ranked.drop("rank"), k, bounded=True) if cut else ranked
