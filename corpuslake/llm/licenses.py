"""Operator 4, licence scan with ordered signature rules.

A text becomes its sequence of lower-case words. Every match of a rule contains one of the rule's keywords, so rules
without any of them in the text are never tried, and most texts cost one pass to split them. Detections are resolved in order of priority, then length: one whose
interval lies inside the interval of a detection that was kept is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.license_rules import Rule, build_rules
from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import replacing, text_of

# Words of the contract, on UTF-8 bytes: all bytes of a letter beyond ASCII are 0x80 or more.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Phrases that are always reported, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.5
_BASE = [(label, re.compile(rf"(?<= ){phrase}(?= )".encode()), phrase.split()[-1].encode()) for phrase, label in BASE.items()]


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.first: dict[bytes, list[tuple[int, Rule]]] = defaultdict(list)
        for place, rule in enumerate(rules):
            for keyword in rule.keywords:
                self.first[keyword].append((place, rule))
        self.gate = frozenset(self.first) | {word for _, _, word in _BASE}

    def detections(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, str, int, int, int, float]]]:
        """Places of the base phrases (label, first word), and kept rule detections
        (label, rule, first word, last word, priority, score)."""
        present = self.gate.intersection(words)
        if not present:
            return [], []
        joined = b" " + b" ".join(words) + b" "
        starts = list(accumulate((len(w) + 1 for w in words), initial=1))  # offset of each word
        base = []
        for label, pattern, word in _BASE:
            if word in present:
                base += [(label, bisect_left(starts, m.start())) for m in pattern.finditer(joined)]
        tried = {place: rule for word in present for place, rule in self.first.get(word, ())}  # each rule once
        found = []
        for place, rule in tried.items():
            for m in rule.pattern.finditer(joined):
                first = bisect_left(starts, m.start())
                found.append((-rule.priority, m.start() - m.end(), place, first, first + m.group().count(b" "), rule))
        kept: list[tuple[str, str, int, int, int, float]] = []
        reach = Reach(len(words))
        for _, _, _, first, last, rule in sorted(found, key=lambda x: x[:4]):
            if reach.of(first) < last:
                reach.add(first, last)
                kept.append((rule.label, rule.name, first, last, rule.priority, rule.score))
        return base, sorted(kept, key=lambda x: x[2:4])


class Reach:
    """The farthest end of the kept intervals that begin at or before a word (a binary indexed tree of maxima)."""

    def __init__(self, size: int):
        self.ends = [-1] * (size + 1)

    def of(self, first: int) -> int:
        at, best = first + 1, -1
        while at:
            best, at = max(best, self.ends[at]), at & (at - 1)
        return best

    def add(self, first: int, last: int) -> None:
        at = first + 1
        while at < len(self.ends):
            self.ends[at] = max(self.ends[at], last)
            at += at & -at


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only


_DETECTION = pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("priority", pa.int32()), ("score", pa.float64())])
_PLACE = pa.struct([("label", pa.string()), ("first_word", pa.int64())])
ADDED = "n_words bigint, base array<struct<label:string,first_word:bigint>>, " \
        "detections array<struct<label:string,rule:string,first_word:bigint,last_word:bigint,priority:int,score:double>>"


def scan_licenses(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The columns of `df` but its text, with `n_words`, `base` (all places of the base phrases) and `detections`.

    Whole texts are scanned; a null text counts as empty; a text without any keyword has empty lists. Rows are
    independent of each other, so repeated rows repeat their result and an empty table stays empty. Input columns
    named like a result are replaced. A detection covers the words from `first_word` to `last_word`.
    """
    added = ["n_words", "base", "detections"]
    kept = replacing([c for c in df.columns if c != text], added)
    rows = df.select(F.struct(*[F.col(c) for c in kept], F.lit(0).alias("__")).alias("row"), text_of(text).alias("text"))
    rules = build_rules() if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, bases, detections = [], [], []
                for value in part.column("text"):
                    words = words_of(value.as_py())
                    base, found = scanner.detections(words)
                    counts.append(len(words))
                    bases.append([{"label": label, "first_word": first} for label, first in base])
                    detections.append([dict(zip(("label", "rule", "first_word", "last_word", "priority", "score"), d)) for d in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(counts, pa.int64()), pa.array(bases, pa.list_(_PLACE)), pa.array(detections, pa.list_(_DETECTION))],
                    ["row", *added])

    schema = rows.select("row").schema
    for field in df.sparkSession.createDataFrame([], ADDED).schema.fields:
        schema = schema.add(field)
    scanned = rows.mapInArrow(run, schema)
    return scanned.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *added)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    base, starts = F.transform("base", lambda b: b["label"]), F.transform("base", lambda b: b["first_word"])
    labels = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    scores = F.concat(F.transform("base", lambda _: F.lit(BASE_SCORE)), F.transform("detections", lambda d: d["score"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"))
