"""Operator 8, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, and only the bag has a label. Every passage is encoded; a gated attention
network gives each passage a weight; the weighted mean of the encodings is scored. Encoder, attention and
score are learned together from the labels of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.langid import remainder
from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import replacing, text_of, unit
from corpuslake.session import cut_lineage

PASSAGE = 512           # bytes
GRAMS = 256             # hashed pairs of bytes
HIDDEN, GATE = 24, 12
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4_000
EPOCHS, BATCH, RATE = 40, 64, 0.01
THRESHOLD = 0.3

_KIND = np.zeros(256, dtype=np.intp)  # 0 other signs, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line break, 6 letters beyond ASCII
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 6
_KIND[0x20], _KIND[0x0A] = 4, 5
KINDS = 7
SHAPE = KINDS + KINDS * KINDS + 2
WIDTH = GRAMS + SHAPE


def passages(text: str, size: int = PASSAGE) -> np.ndarray:
    """One row of features per passage of the whole text; the empty text is one empty passage.

    Hashed byte pairs, shares of kinds of bytes and of changes between them, the share of distinct 4-grams and
    the fill of the passage.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = max(1, -(-len(raw) // size))
    x = np.zeros((count, WIDTH), dtype=np.float32)
    if not len(raw):
        return x
    home = np.arange(len(raw)) // size
    filled = np.bincount(home, minlength=count).astype(np.float32)[:, None]
    kind = _KIND[raw]
    x[:, GRAMS:GRAMS + KINDS] = np.bincount(home * KINDS + kind, minlength=count * KINDS).reshape(count, KINDS) / filled
    if len(raw) > 1:
        wide = raw.astype(np.uint32)
        pair = ((((wide[:-1] << 8) | wide[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.intp)
        grams = np.bincount(home[1:] * GRAMS + pair, minlength=count * GRAMS).reshape(count, GRAMS)
        x[:, :GRAMS] = np.sqrt(grams / filled)
        change = kind[:-1] * KINDS + kind[1:]
        changes = np.bincount(home[1:] * KINDS * KINDS + change, minlength=count * KINDS * KINDS).reshape(count, -1)
        x[:, GRAMS + KINDS:GRAMS + KINDS + KINDS * KINDS] = changes / filled
    if len(raw) > 3:
        four = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        distinct = np.unique((home[3:].astype(np.uint64) << np.uint64(32)) | four)
        x[:, -2] = np.bincount((distinct >> np.uint64(32)).astype(np.intp), minlength=count) / filled[:, 0]
    x[:, -1] = filled[:, 0] / size
    return x


@dataclass
class Attention:
    """Weights: encoder `e`, gates `v` and `u` with `w`, score `c`; the last row of `e`, `v`, `u` and entry of `c` is an offset."""
    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.e[:-1] + self.e[-1])

    def attend(self, h: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Weights of the passages inside each bag, and the two gates."""
        t = np.tanh(h @ self.v[:-1] + self.v[-1])
        s = 1.0 / (1.0 + np.exp(-np.clip(h @ self.u[:-1] + self.u[-1], -30, 30)))
        a = (t * s) @ self.w
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), lengths))
        return a / np.repeat(np.add.reduceat(a, starts), lengths), t, s

    def score(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h = self.encode(x)
        a, _, _ = self.attend(h, starts, lengths)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return 1.0 / (1.0 + np.exp(-np.clip(z @ self.c[:-1] + self.c[-1], -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Attention:
    """Cross-entropy of the bag labels, by back-propagation with Adam over batches of bags."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    m = Attention(rows.mean(axis=0), rows.std(axis=0) + 0.05,
                  rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH + 1, HIDDEN)), rng.normal(0, 0.3, (HIDDEN + 1, GATE)),
                  rng.normal(0, 0.3, (HIDDEN + 1, GATE)), rng.normal(0, 0.3, GATE), np.zeros(HIDDEN + 1))
    names, step = ["e", "v", "u", "w", "c"], 0
    first = {n: np.zeros_like(getattr(m, n)) for n in names}
    second = {n: np.zeros_like(getattr(m, n)) for n in names}
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            x = np.concatenate([bags[i] for i in chosen]).astype(float)
            lengths = np.array([len(bags[i]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            n, x = (x - m.mean) / m.scale, None
            h = np.tanh(n @ m.e[:-1] + m.e[-1])
            a, t, s = m.attend(h, starts, lengths)
            z = np.add.reduceat(a[:, None] * h, starts, axis=0)
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ m.c[:-1] + m.c[-1], -30, 30)))
            d = (p - labels[chosen]) / len(chosen)
            dz = np.repeat(d[:, None] * m.c[:-1], lengths, axis=0)
            along = (h * dz).sum(axis=1)
            da = a * (along - np.repeat(np.add.reduceat(a * along, starts), lengths))  # through the softmax
            dt, ds = da[:, None] * m.w * s * (1 - t * t), da[:, None] * m.w * t * s * (1 - s)
            dh = (a[:, None] * dz + dt @ m.v[:-1].T + ds @ m.u[:-1].T) * (1 - h * h)
            slopes = {"c": np.append(d @ z, d.sum()), "w": da @ (t * s), "v": np.vstack([h.T @ dt, dt.sum(axis=0)]),
                      "u": np.vstack([h.T @ ds, ds.sum(axis=0)]), "e": np.vstack([n.T @ dh, dh.sum(axis=0)])}
            step += 1
            for name in names:
                weight = getattr(m, name)
                slope = slopes[name] + 1e-4 * weight
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope * slope
                rate = RATE * (1 - epoch / epochs) + 1e-4
                weight -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return m


def train(df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE) -> Attention | None:
    """Fit on at most `sample` labelled documents among those that `learn` (on the key) selects, drawn by a seeded hash.

    Null keys and labels are not learned from; a key that is labelled differently counts with its smallest label;
    a key with several texts gives several documents. Nothing to learn from gives None.
    """
    usable = labels.where(F.coalesce(learn, F.lit(False)) & F.col(key).isNotNull() & F.col(label).isNotNull())
    usable = usable.groupBy(F.col(key).alias("of")).agg(F.min(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    usable = usable.withColumn("u", unit(F.md5(F.concat(F.lit("quality-1|"), F.col("of").cast("string")))))
    total = usable.count()
    chosen = usable.where(F.col("u") < F.lit(1.1 * sample / max(total, 1))).orderBy("u").limit(sample).select("of", "label")
    chosen = cut_lineage(chosen, "quality-sample")  # bounded by `sample`
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), rows["key"] == chosen["of"]).select("key", "text", "label").limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [passages(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], ["label", "x"])

    learned = sorted(((r["label"], bytes(r["x"])) for r in rows.mapInArrow(run, "label int, x binary").toLocalIterator()))
    if not learned:
        return None
    bags = [np.frombuffer(x, dtype=np.float16).reshape(-1, WIDTH).astype(np.float32) for _, x in learned]
    return fit(bags, np.array([y for y, _ in learned], dtype=float))


def score_quality(df: DataFrame, model: Attention | None, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with `score`, the probability of label 1 from all passages of the whole text.

    A null text counts as empty, and the empty text is scored like any other; without a model every score is 0.5.
    Rows are independent: repeated rows repeat their score, an empty table stays empty; an existing column of the
    name is replaced.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            scores = np.full(len(part), 0.5)
            for at in range(0, len(part) if model is not None else 0, 64):
                bags = [passages(t) for t in part.iloc[at:at + 64]]
                scores[at:at + 64] = model.score(np.concatenate(bags), np.array([len(b) for b in bags]))
            yield pd.Series(scores)

    return df.withColumn(out, score(text_of(text)))


@query("op8_attention_quality")
def op8_attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = train(documents, table(spark, sf, "labels"), ~held_out)
    scored = score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
