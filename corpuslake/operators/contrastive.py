"""Text encoding, in-batch contrastive metrics and router statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage
from corpuslake.functions.vectors import logsumexp, softmax

CACHED_WORDS = 200_000  # hashed words kept per Python worker
TILE_ROWS = 2_048  # pairs of one batch that meet in one task
PARTIAL = "batch_id bigint, pair_id bigint, top double, total double, first bigint, own double, cosine double"


class HashedBagOfWords:
    """Deterministic stand-in for a neural encoder: word counts in `dim` hashed buckets."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.words = regex.compile(r"[\p{L}\p{N}]+")
        self.buckets: dict[str, int] = {}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word, n in Counter(self.words.findall((text or "").lower())).items():
                out[row, self.bucket(word)] += n
        return out

    def bucket(self, word: str) -> int:
        if word not in self.buckets:
            if len(self.buckets) >= CACHED_WORDS:
                self.buckets.clear()
            self.buckets[word] = int(md5(word.encode()).hexdigest()[:15], 16) % self.dim
        return self.buckets[word]


def once(udf):
    """Keep Catalyst from copying a costly Python call into filters over its result."""
    return udf.asNondeterministic()


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, norms, out=vectors.astype(float), where=norms > 0)


def encode_table(df: DataFrame, make_encoder: Callable[[], Callable], text: str = "text", out: str = "embedding",
                 batch: int = 32) -> DataFrame:
    """Unit-length vector per text. The encoder is built once per task and called on `batch` texts."""

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for texts in batches:  # only `batch` texts at a time become Python strings
            parts = [_lists(unit_rows(np.asarray(encoder(texts.slice(i, batch).to_pylist())))) for i in range(0, len(texts), batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, once(encode)(text))


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(matrix.ravel()))


def _stack(column: pd.Series) -> np.ndarray:
    return unit_rows(np.array(column.tolist(), dtype=float))


def _tile_partials(queries: pd.DataFrame, positives: pd.DataFrame, temperature: float, weight: float) -> pd.DataFrame:
    """Per query: largest logit, sum of exp, first pair reaching the largest, own logit if present.

    Logits are compared at nine decimals, so equal vectors tie however the product was summed.
    """
    q, p = _stack(queries["qv"]), _stack(positives["pv"])
    ids = positives["pair_id"].to_numpy()
    sim = np.einsum("qd,pd->qp", q, p)
    logits = sim / temperature
    top = logits.max(axis=1)
    near = np.round(logits, 9) >= np.round(top, 9)[:, None]
    first = np.where(near, ids[None, :], np.iinfo(np.int64).max).min(axis=1)
    mine = queries["pair_id"].to_numpy()[:, None] == ids[None, :]
    has_own, own_at = mine.any(axis=1), mine.argmax(axis=1)
    rows = np.arange(len(q))
    out = pd.DataFrame({
        "batch_id": queries["batch_id"].to_numpy(), "pair_id": queries["pair_id"].to_numpy(), "top": top,
        "total": np.exp(logits - top[:, None]).sum(axis=1), "first": first,
        "own": np.where(has_own, logits[rows, own_at], np.nan), "cosine": np.where(has_own, sim[rows, own_at], np.nan)})
    out = out.astype({"own": object, "cosine": object}).where(out.notna(), None)
    extra = []
    if "negs" in queries:
        for i in np.flatnonzero(has_own):  # hard negatives count once, next to the query's own positive
            negs = queries["negs"].iloc[i]
            if negs is not None and len(negs):
                hard = unit_rows(np.array([list(v) for v in negs], dtype=float)) @ q[i] / temperature * weight
                extra.append((out["batch_id"].iloc[i], out["pair_id"].iloc[i], hard.max(), np.exp(hard - hard.max()).sum(),
                              np.iinfo(np.int64).max, None, None))
    return out if not extra else pd.concat([out, pd.DataFrame(extra, columns=out.columns)], ignore_index=True)


def info_nce(df: DataFrame, temperature: float = 0.05, hard_weight: float = 1.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per batch: loss, accuracy and mean positive similarity from `batch_id, pair_id, qv, pv [, negs]`.

    Logits of a batch are a matrix product inside tasks; only one partial (maximum, sum of exp) per
    query and tile is emitted, never a row per pair. A batch larger than `tile_rows` is cut into
    tiles of queries x positives, whose partials merge exactly.
    """
    wanted = ["batch_id", "pair_id", "qv", "pv"] + (["negs"] if "negs" in df.columns else [])
    rows = df.select(*wanted)
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= tile_rows:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return _tile_partials(pdf, pdf, temperature, hard_weight)
        partial = rows.groupBy("batch_id").applyInPandas(whole, PARTIAL)
    else:
        tiles = cut_lineage(
            sizes.select(F.col("batch_id").alias("__b"), F.ceil(F.col("n") / tile_rows).cast("int").alias("__t")), "batch-tiles")
        cut = rows.join(tiles, F.col("batch_id") == F.col("__b")).drop("__b")
        cut = cut.withColumn("__own", F.pmod(F.xxhash64("pair_id"), F.col("__t")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("__t") - 1))
        queries = cut.drop("pv").withColumn("qt", F.col("__own")).withColumn("pt", every).drop("__own", "__t")
        positives = cut.select("batch_id", "pair_id", "pv", F.col("__own").alias("pt"), "__t")
        positives = positives.withColumn("qt", F.explode(F.sequence(F.lit(0), F.col("__t") - 1))).drop("__t")
        positives = positives.toDF(*positives.columns)  # columns of its own, for the grouping with itself

        def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame(columns=["batch_id", "pair_id", "top", "total", "first", "own", "cosine"])
            return _tile_partials(left, right, temperature, hard_weight)

        partial = queries.groupBy("batch_id", "qt", "pt").cogroup(
            positives.groupBy("batch_id", "qt", "pt")).applyInPandas(tile, PARTIAL)
    parts = partial.groupBy("batch_id", "pair_id").agg(
        F.collect_list(F.struct("top", "total", "first")).alias("parts"), F.max("own").alias("own"), F.max("cosine").alias("cosine"))
    top = F.array_max(F.transform("parts", lambda s: s["top"]))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, s: acc + s["total"] * F.exp(s["top"] - F.col("top")))
    best = F.array_min(F.transform(F.filter("parts", lambda s: F.round(s["top"], 9) >= F.round(F.col("top"), 9)), lambda s: s["first"]))
    scored = parts.withColumn("top", top).withColumn("total", total).withColumn("best", best)
    return scored.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(F.col("top") + F.log("total") - F.col("own")).alias("loss"),
        F.avg((F.col("best") == F.col("pair_id")).cast("double")).alias("accuracy"),
        F.avg("cosine").alias("mean_positive_sim"))


def expert_load(df: DataFrame, k: int, logits: str = "logits") -> DataFrame:
    """Per expert: share of tokens that have it in their top k, and its mean probability."""
    order = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, k), lambda s: s["i"])
    rows = df.select(softmax(logits).alias("p"), chosen.alias("chosen"))
    per = rows.select(F.posexplode("p").alias("expert", "prob"), "chosen")
    per = per.select("expert", "prob", F.array_contains("chosen", F.col("expert")).cast("double").alias("hit"))
    return per.groupBy(F.col("expert").cast("bigint").alias("expert")).agg(F.avg("hit").alias("load"), F.avg("prob").alias("mean_prob"))


def load_balance_loss(df: DataFrame, k: int, alpha: float = 0.01, logits: str = "logits") -> DataFrame:
    """alpha x experts x sum of load x mean probability."""
    return expert_load(df, k, logits).agg(
        (F.lit(alpha) * F.count(F.lit(1)) * F.sum(F.col("load") * F.col("mean_prob"))).alias("aux_loss"))


def router_z(df: DataFrame, coef: float = 1e-3, logits: str = "logits") -> DataFrame:
    """Mean squared logsumexp of the logits, times `coef`."""
    return df.agg((F.avg(F.pow(logsumexp(logits), F.lit(2))) * coef).alias("z_loss"))
