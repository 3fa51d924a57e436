"""Operator 1, packing documents into token sequences by cutting-stock column generation.

1. One pass splits every text into tokens and writes them; a document longer than a sequence gives full
   sequences, and the rest (every shorter document as a whole) counts as one of its length class.
2. The histogram of the classes goes to `cutting.plan`, whose size depends on the number of classes only.
3. Documents are ranked inside their class without a shuffle: a place inside the writing task, plus the
   number of documents of the class in the tasks before it. The plan is looked up by class and rank.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.cutting import Run, plan
from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import before, replacing
from corpuslake.session import cut_lineage

LENGTH = 2_048
STEP = 8
END = 1
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Words a Python worker remembers, and the longest one it remembers. Both bound memory, not results.
REMEMBERED, LONGEST = 400_000, 48

# Fixed value: how byte-level tokenizers of this family split a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII and Latin letters, the most frequent kind of word first.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LATIN_SPLIT = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?(?:[0-9]+|[^\s0-9{LETTERS}]+)|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\u024f]")

# Fixed value: the characters that byte-level models write for the 256 bytes. Visible ones of Latin-1 stand for
# themselves, the others for the characters from U+0100 on.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
HIDDEN = [b for b in range(256) if b not in set(VISIBLE)]
BYTES = {**{b: b for b in VISIBLE}, **{b: 0x100 + i for i, b in enumerate(HIDDEN)}}


class Words(dict):
    """Token ids of words as little-endian bytes.

    A new word goes to the tokenizer's model, without the offsets and copies that encoding a text makes. A text that
    holds one of the tokenizer's added tokens is encoded as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.find = regex.compile(SPLIT).findall
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = {"H": "<u2", "I": "<u4"}[self.code]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self._pack([t.id for t in self.model(word.encode().decode("latin-1").translate(BYTES))])
        if len(self) < REMEMBERED and len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, self.find(text) if NOT_LATIN.search(text) else LATIN_SPLIT.findall(text)))


@lru_cache(maxsize=2)
def words_for(path: str) -> Words:
    return Words(path)


TOKENS = "ids binary, doc_tokens bigint, task int, class int, place bigint, full bigint, full_before bigint"


def tokenize(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, step: int = STEP,
             end: int = END) -> DataFrame:
    """Every row of `df` without its text, with its token ids (the end id last) and its place in the packing order.

    `ids` is binary, unsigned little-endian, two bytes an id while the vocabulary allows. `class` is the length
    class of what is left after `full` sequences (0: nothing is left), `place` the number of earlier rows of the
    class in the same task, `full_before` the number of full sequences of earlier rows in the task.
    """
    added = [f.split()[0] for f in TOKENS.split(", ")]
    kept = [c for c in df.columns if c != text]
    rows = df.select(F.struct(*[F.col(c) for c in kept], F.lit(0).alias("__")).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = words_for(tokenizer), TaskContext.get().partitionId()
        last = np.array([end], dtype=words.kind).tobytes()
        places, full_before = np.zeros(length // step + 1, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(7)]
                for value in part.column("text"):
                    ids = words.encode(value.as_py()) + last
                    tokens = len(ids) // np.dtype(words.kind).itemsize
                    full, rest = divmod(tokens, length)
                    kind = -(-rest // step)
                    for column, x in zip(out, (ids, tokens, task, kind, int(places[kind]), full, full_before)):
                        column.append(x)
                    places[kind] += 1
                    full_before += full
                types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, t) for c, t in zip(out, types)]], ["row", *added])

    schema = rows.select("row").schema
    for field in spark_fields(df.sparkSession):
        schema = schema.add(field)
    return rows.mapInArrow(run, schema)


def spark_fields(spark: SparkSession):
    return spark.createDataFrame([], TOKENS).schema.fields


def histogram(tokens: DataFrame, length: int, step: int) -> np.ndarray:
    """Documents by length class: at most length / step numbers, whatever the size of the table."""
    counts = np.zeros(length // step, dtype=np.int64)
    for r in tokens.where(F.col("class") > 0).groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["class"] - 1] = r["n"]
    return counts


def _offsets(tokens: DataFrame) -> DataFrame:
    """Per writing task: rows of every class and full sequences in the tasks before it."""
    classes = before(tokens.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n")), ["class"], "task", "n", "ahead")
    ahead = classes.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("class", "ahead"))).alias("ahead"))
    full = before(tokens.groupBy("task").agg(F.sum("full").alias("n")), [], "task", "n", "full_ahead").drop("n")
    return ahead.join(full, "task").withColumnRenamed("task", "of")


class Lookup:
    """Runs of a plan, by class and rank."""

    def __init__(self, runs: list[Run], classes: int):
        self.edges: list[np.ndarray] = []
        self.pieces: list[list[list[Run]]] = []
        by_class: list[list[Run]] = [[] for _ in range(classes + 1)]
        for r in runs:
            by_class[r.origin].append(r)
        for mine in by_class:
            edges = sorted({r.first for r in mine} | {r.first + r.count for r in mine})
            at = {e: i for i, e in enumerate(edges)}
            inside: list[list[Run]] = [[] for _ in edges]
            for r in mine:
                for i in range(at[r.first], at[r.first + r.count]):
                    inside[i].append(r)
            self.edges.append(np.array(edges, dtype=np.int64))
            self.pieces.append([sorted(p, key=lambda r: r.start) for p in inside])

    def of(self, origin: int, rank: int) -> list[Run]:
        return self.pieces[origin][int(np.searchsorted(self.edges[origin], rank, side="right")) - 1]


def cut_pieces(tokens: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """One row per piece: the columns that were carried, `start`, `length`, `ids` (binary, unsigned little-endian
    32-bit), `doc_tokens`, `sequence_id`, and `slot`, which orders the pieces of a sequence."""
    runs, sequences = plan(histogram(tokens, length, step))
    lookup = Lookup(runs, length // step)  # a few runs per class
    offsets = cut_lineage(_offsets(tokens), "pack-offsets")
    placed = tokens.join(offsets, tokens["task"] == offsets["of"]).drop("of")
    placed = placed.withColumn("rank", F.col("place") + F.element_at("ahead", F.col("class")))
    placed = placed.withColumn("first_full", F.col("full_before") + F.col("full_ahead") + sequences)
    placed = placed.select("row", "ids", "doc_tokens", "class", "rank", "full", "first_full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(7)]
                columns = [part.column(i).to_pylist() for i in range(1, 7)]
                for i, (ids, tokens_, kind, rank, full, first_full) in enumerate(zip(*columns)):
                    wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * tokens_ else "<u4").astype("<u4")
                    pieces = [(j * length, (j + 1) * length, first_full + j, 0) for j in range(full)]
                    if kind:
                        for r in lookup.of(kind, rank):
                            begin = full * length + r.start * step
                            pieces.append((begin, min(begin + r.size * step, tokens_), r.sequence + rank - r.first, r.slot))
                    for begin, stop, sequence, slot in pieces:
                        for column, x in zip(out, (i, begin, stop - begin, wide[begin:stop].tobytes(), tokens_, sequence, slot)):
                            column.append(x)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                arrays = [pa.array(c, t) for c, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(arrays[0]), *arrays[1:]],
                                                 ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "slot"])

    schema = placed.select("row").schema
    for field in df_fields(tokens.sparkSession, "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, slot int"):
        schema = schema.add(field)
    pieces = placed.mapInArrow(run, schema)
    made = ["start", "length", "ids", "doc_tokens", "sequence_id", "slot", "offset"]
    carried = replacing([c for c in tokens.schema["row"].dataType.names if c != "__"], made)
    return pieces.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], *made[:-1])


def df_fields(spark: SparkSession, fields: str):
    return spark.createDataFrame([], fields).schema.fields


def with_offsets(pieces: DataFrame) -> DataFrame:
    """`offset` of each piece in its sequence, gapless from 0. A sequence holds at most `length` pieces."""
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("bigint"))).drop("slot")


def pack(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, step: int = STEP, end: int = END) -> DataFrame:
    """Pack all texts of `df` into sequences of at most `length` tokens; one row per piece of a document.

    The columns of `df` but its text are carried along, and replaced where the result has a column of the same
    name. A null text counts as empty; every document, also an empty one, ends with the id `end`; repeated rows are
    documents of their own; an empty table gives no piece. Each id lies in exactly one piece; a document is cut only
    if it is longer than a sequence, if the plan fills a gap with a part of it, or in the rounded remainder.
    Padding stems from counting lengths in steps: less than `step` tokens per piece.
    """
    tokens = cut_lineage(tokenize(df, text, tokenizer, length, step, end), "pack-tokens")
    return with_offsets(cut_pieces(tokens, length, step))


def packed_digests(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """The result of `pack` with `ids_crc32` in place of the ids, which then need not move with their sequence."""
    tokens = cut_lineage(tokenize(df, text, tokenizer, length), "pack-tokens")
    pieces = cut_pieces(tokens, length)
    carried = [c for c in pieces.columns if c != "ids"]
    at = carried.index("length") + 1
    return with_offsets(pieces.select(*carried[:at], F.crc32("ids").alias("ids_crc32"), *carried[at:]))


@query("op1_column_generation_packing")
def op1_column_generation_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_digests(table(spark, sf, "documents").select("doc_id", "text"))
