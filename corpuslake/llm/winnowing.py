"""Operator 6, document fingerprints by winnowing.

All k-grams of a text are hashed; of every window of consecutive hashes the smallest is chosen, the rightmost
one where several are equal, and kept with its position. Two texts that share any passage of at least
`K + WINDOW - 1` code points share a fingerprint, because the choice depends on the window alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import text_of

K = 32
WINDOW = 64
#: Documents per range of keys, and the most ranges; a range is streamed, not held.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000, 256, 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(33))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling polynomial hash of every run of `k` codes, well mixed."""
    with np.errstate(over="ignore"):
        powers = {}  # hashes of runs of 1, 2, 4, ... codes
        width, base = 1, _BASE
        hashes = codes.astype(np.uint64) + np.uint64(1)
        while width <= k:
            powers[width] = (hashes, base)
            if 2 * width > len(codes) or 2 * width > k:
                break
            hashes = hashes[:-width] * base + hashes[width:]
            width, base = 2 * width, base * base
        result, covered = None, 0
        for width in sorted(powers, reverse=True):  # put k together from powers of two
            if covered + width <= k:
                hashes, base = powers[width]
                tail = hashes[covered:]
                result = tail if result is None else result[:len(tail)] * base + tail
                covered += width
        result = result[:len(codes) - k + 1]
        result = (result ^ (result >> _MIX[1])) * _MIX[0]
    return result ^ (result >> _MIX[1])


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every `window` consecutive values, by doubling."""
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def winnow(text: str, k: int = K, window: int = WINDOW) -> np.ndarray:
    """The fingerprint: chosen hashes in text order, each as hash * 2**32 + position.

    A text shorter than k is one gram, a text with fewer grams than a window is one window; the empty text has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, dtype=np.uint64)
    return choose(gram_hashes(codes, min(k, len(codes))), window)


def choose(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest hash (by its upper 32 bits) of every window, the rightmost of equal ones, as hash * 2**32 + position."""
    last = np.uint64((1 << 32) - 1)
    keys = (hashes & ~last) | (last - np.arange(len(hashes), dtype=np.uint64))  # equal hashes: the rightmost is smaller
    chosen = sliding_min(keys, min(window, len(keys)))
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    return (chosen & ~last) | (last - (chosen & last))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of distinct hashes that two fingerprints have in common; two empty fingerprints are alike."""
    a, b = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def as_bytes(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u8").tobytes()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the second half replaced by the start of the
    next document in key order, the first after the last), and how like they are to the document's and the next one's.

    A null text counts as empty. Null keys come first; rows with equal keys are ordered by text; repeated rows follow
    one another. A single document is its own next one; an empty table gives no row. Other columns are not read.

    Documents are dealt to ranges of keys and streamed in order; the first of each range is also sent to the range
    before it, so each text is shuffled once.
    """
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    count = rows.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, count // RANGE_ROWS))
    fractions = [i / ranges for i in range(1, ranges)]
    quantiles = rows.agg(F.percentile_approx("doc_id", fractions, 10 * ranges).alias("q")).first()["q"]
    edges = np.unique(np.array(quantiles or [], dtype=np.int64))  # at most MOST_RANGES numbers

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(edges, known, side="right")).astype("int32"))

    rows = rows.withColumn("range", place("doc_id"))
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id")).alias("first")).collect()
    order = sorted(r["range"] for r in firsts)  # at most MOST_RANGES
    first_of = {r["range"]: r["first"]["doc_id"] for r in firsts}
    ahead = [(first_of[r], r, order[i - 1]) for i, r in enumerate(order)]  # the first range follows the last one
    ahead = df.sparkSession.createDataFrame(ahead, "first_id bigint, own int, to int")
    sent = rows.join(F.broadcast(ahead), (rows["range"] == ahead["own"]) & rows["doc_id"].eqNullSafe(ahead["first_id"]), "left")
    places = F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("ahead")))
    places = F.when(F.col("to").isNotNull(), F.concat(places, F.array(F.struct(F.col("to").alias("at"), F.lit(1).alias("ahead"))))).otherwise(places)
    sent = sent.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.at", "p.ahead")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    ordered = sent.repartition(min(ranges, tasks), "at").sortWithinPartitions("at", "ahead", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last document, until the next one is known
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    if waiting is None and r["ahead"]:
                        continue
                    mine = winnow(r["text"], k, window)
                    if waiting is not None:
                        before, print_before = waiting
                        changed = edited(before["text"], r["text"])
                        print_changed = winnow(changed, k, window)
                        out.append({
                            "doc_id": before["doc_id"], "n_chars": len(before["text"]),
                            "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            "fingerprint": as_bytes(print_before), "edited_fingerprint": as_bytes(print_changed),
                            "near_edited": likeness(print_before, print_changed), "near_next": likeness(print_before, mine)})
                    waiting = None if r["ahead"] else (r, mine)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    return ordered.mapInArrow(run, COMPARED)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, window: int = WINDOW) -> DataFrame:
    """`df` with its fingerprints as an array of (hash, position); an existing column of that name is replaced."""

    @F.pandas_udf("array<struct<hash:bigint,position:bigint>>")
    def mark(texts: pd.Series) -> pd.Series:
        low = np.uint64((1 << 32) - 1)
        found = (winnow(t or "", k, window) for t in texts)
        return pd.Series([[{"hash": int(x >> np.uint64(32)), "position": int(x & low)} for x in f] for f in found])

    return df.withColumn(out, mark(text_of(text)))


@query("op6_winnowing_fingerprints")
def op6_winnowing_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    compared = compare_with_next(table(spark, sf, "documents"))
    return compared.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
                           F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
