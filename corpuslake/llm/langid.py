"""Operator 5, hierarchical language identification.

The family of a language is predicted first, by one-versus-one linear support vector machines between the
families; then one-versus-one machines that were trained on closely related languages only separate the
languages inside the family. Features are hashed byte n-grams of the lower-case letters of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import draw, replacing, unit
from corpuslake.session import cut_lineage

FEATURES = 4_096
#: Labelled documents per language that the machines are fitted on, at most.
SAMPLE_PER_LANGUAGE = 800
#: And over all languages, so that the driver's memory does not grow with their number: some 130 MB of features.
SAMPLE_IN_ALL = 16_000
STEPS, REGULAR = 400, 1e-4
UNKNOWN = "und"

# Families of closely related languages by ISO code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "sk", "cs", "pl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indic": ["hi", "ur", "bn", "pa", "mr", "ne", "gu"],
    "semitic": ["ar", "he", "mt", "am"],
    "baltic": ["lt", "lv"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_TABLE = np.full(256, 0x20, dtype=np.uint32)  # everything but letters is a gap
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def features(text: str, size: int = FEATURES) -> np.ndarray:
    """Logarithms of the counts of hashed 1-, 2- and 3-grams, with length one."""
    raw = _TABLE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 0x20) | (raw[:-1] != 0x20)])]  # gaps of any length are one
    two = (raw[:-1] << 8) | raw[1:]
    three = (two[:-1] << 8) | raw[2:]
    grams = np.concatenate([raw, two | 1 << 24, three | 2 << 24])
    slots = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(size).bit_length() + 1)
    x = np.log1p(np.bincount(slots, minlength=size)).astype(np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def has_letter(text: str) -> bool:
    """Whether some character is of the category L (letters), as where the model is trained."""
    return any(map(str.isalpha, text))


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Linear support vector machine (the last weight is the offset), classes weighted to equal influence.

    Gradient steps on the squared hinge loss with momentum; `y` is 1 or -1.
    """
    x, y = x.astype(np.float32), y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, speed = np.zeros(x.shape[1] + 1, dtype=np.float32), np.zeros(x.shape[1] + 1, dtype=np.float32)
    for _ in range(steps):
        pull = share * np.maximum(0.0, 1.0 - y * (x @ w[:-1] + w[-1])) * y
        gradient = REGULAR * w - 2.0 * np.append(pull @ x, pull.sum())
        speed = (0.9 * speed - 0.4 * gradient).astype(np.float32)
        w = w + speed
    return w


@dataclass(frozen=True)
class Hierarchy:
    families: list[str]
    languages: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]  # for each pair of families, and of languages of a family

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of every row by number of duels won, then by the sum of margins; and how sure its closest duel is."""
        wins, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        closest = np.full((len(x), len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            w = self.machines[names[i], names[j]]
            margin = x @ w[:-1] + w[-1]
            for k, m in ((i, margin), (j, -margin)):
                wins[:, k] += m >= 0 if k == i else m > 0
                margins[:, k] += m
                closest[:, k] = np.minimum(closest[:, k], m)
        best = np.lexsort((margins, wins), axis=1)[:, -1] if len(names) > 1 else np.zeros(len(x), dtype=int)
        margin = closest[np.arange(len(x)), best]
        return best, 1.0 / (1.0 + np.exp(-np.clip(3.0 * margin, -50, 50)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self._vote(x, self.families)
        out = np.empty(len(x), dtype=object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, also = self._vote(x[rows], self.languages[name])
                out[rows] = [self.languages[name][b] for b in best]
                sure[rows] = sure[rows] * also
        return list(out), sure


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy | None:
    known = sorted(set(langs))
    if not known:
        return None
    family = np.array([_FAMILY.get(lang, lang) for lang in langs])
    families, lang = sorted(set(family)), np.array(langs)
    languages = {f: sorted(set(lang[family == f])) for f in families}
    machines = {}
    for names, labels in [(families, family), *[(languages[f], lang) for f in families]]:
        for a, b in combinations(names, 2):
            rows = (labels == a) | (labels == b)
            machines[a, b] = fit_machine(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
    return Hierarchy(families, languages, machines)


def train(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
          sample: int = SAMPLE_PER_LANGUAGE) -> Hierarchy | None:
    """Fit on at most `sample` documents per language (`SAMPLE_IN_ALL` over all) among the rows that `learn` selects, drawn by a seeded hash.

    Rows without text, letters or language are not learned from. No such row at all gives None.
    """
    rows = df.where(F.coalesce(learn, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw("langid-1", key, text).alias("digest"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts, "langid-counts")
    sample = max(1, min(sample, SAMPLE_IN_ALL // max(1, counts.count())))
    counts = counts.withColumn("share", F.lit(2.0 * sample) / F.col("n")).select(F.col("lang").alias("of"), "share")  # one row per language, of known size: texts are not shuffled for it
    thin = rows.join(counts, rows["lang"] == counts["of"]).where(unit(F.col("digest")) < F.col("share"))  # about twice the sample
    first = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    thin = thin.withColumn("place", first).where(F.col("place") <= sample).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]  # halves what the driver holds
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

    learned = thin.mapInArrow(run, "lang string, x binary").collect()
    learned.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the order of arrival must not matter
    if not learned:
        return None
    langs = [r["lang"] for r in learned]
    x = np.empty((len(learned), FEATURES), dtype=np.float16)
    for row in range(len(learned)):
        x[row] = np.frombuffer(learned[row]["x"], dtype=np.float16)
        learned[row] = None  # its bytes are not needed twice
    return fit(x, langs)


def identify(df: DataFrame, model: Hierarchy | None, text: str = "text") -> DataFrame:
    """`df` with `lang_pred` and `score` (0 to 1), read from the whole text.

    A text that is null or has no letter is `und` with score 0, and so is every text if there is no model. The score
    is the product of how sure the closest duels of family and language are. Rows are independent: repeated rows
    repeat their result, an empty table stays empty; input columns with the names of the results are replaced.
    """
    kept = replacing(df.columns, ["lang_pred", "score"])
    rows = df.select(F.struct(*[F.col(c) for c in kept], F.lit(0).alias("__")).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                usable = [i for i, t in enumerate(texts) if model is not None and t is not None and has_letter(t)]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if usable:
                    found, sure = model.predict(np.stack([features(texts[i]) for i in usable]))
                    for i, name, s in zip(usable, found, sure):
                        names[i], scores[i] = name, float(s)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 ["row", "lang_pred", "score"])

    schema = rows.select("row").schema
    for field in df.sparkSession.createDataFrame([], "lang_pred string, score double").schema.fields:
        schema = schema.add(field)
    return rows.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "lang_pred", "score")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


@query("op5_hierarchical_langid")
def op5_hierarchical_langid(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = train(documents, ~held_out)
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
