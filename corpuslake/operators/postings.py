"""Keyword search in a written inverted index.

Documents that are alike (of one language, say) are dealt to ranges of some hundred by a hash. The index holds one row
per term and range, a block: the documents with the term, its count and their length, and the largest weight the term has in
one. Blocks are written by a hash of their term, so a search reads the folders of the terms it asks for and no text.
On their way to a folder the blocks of a range are one row, since most blocks are shorter than a row's own overhead.

The largest weights of a range's blocks add up to a bound for all its documents. A search scores the most promising
ranges of each query first; the k-th best score found there rules out all ranges whose bound is below it. The asked
blocks of some ranges meet all queries that want one of them in a task, so a block travels once, however many ask for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.text import explode_values
from corpuslake.functions.vectors import let
from corpuslake.operators.ordering import with_rank
from corpuslake.operators.retrieval import BLOCK_QUERIES, CELLS, DIGITS, BestK, best_of, model_words
from corpuslake.session import cut_lineage, shared_dir

RANGE_DOCS = 256            # documents of a range, on average
BUCKETS = 64                # folders of the index
FILE_POSTINGS = 4_000_000   # postings of a file, on average
FIRST = 8                   # ranges that are scored before a bound is known
TILE_RANGES = 16            # ranges that are scored in one task, on average
TILE_QUERIES = 32_768       # queries that share the blocks of a tile, on average
UNPACKED = 64               # rows of whole folders that become blocks at a time


@dataclass(frozen=True)
class PostingIndex:
    """`blocks` has bucket, term, part, n, peak and, one entry per document, items, tfs and dls; `terms` has bucket, term, idf."""
    blocks: DataFrame
    terms: DataFrame
    k1: float
    b: float
    avgdl: float

    def weight(self, tf: Column, dl: Column) -> Column:
        return _weight(tf, dl, self.k1, self.b, self.avgdl)


def _weight(tf, dl, k1: float, b: float, avgdl: float):
    """Of columns or of arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each list begins; the last number is where the last one ends."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return whole.flatten(), np.concatenate([[0], np.cumsum(_numbers(pc.list_value_length(whole)))])


def _numbers(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return whole.to_numpy(zero_copy_only=False)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places `start` to `start + size` of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def counted_words(words: Column) -> Column:
    """The distinct words of a list and how often each occurs (`dl`, `terms`, `tfs`): runs of the sorted list, no shuffle."""
    def runs(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return let(firsts, lambda first: F.struct(
            F.size(w).alias("dl"), F.transform(first, lambda i: F.get(w, i)).alias("terms"),
            F.transform(first, lambda i, at: F.coalesce(F.get(first, at + 1), F.size(w)) - i).alias("tfs")))

    return let(F.sort_array(words), runs)


def _by_folder(docs: pa.Table) -> pa.Table:
    """The documents of a range turned into blocks, in one row per folder."""
    words, ends = _flat(pc.split_pattern(docs["terms"].combine_chunks(), " "))
    words = words.dictionary_encode()
    codes = _numbers(words.indices)
    folder_of = np.array([zlib.crc32(w.encode()) % BUCKETS for w in words.dictionary.to_pylist()])
    order = np.lexsort((codes, folder_of[codes]))
    codes, doc = codes[order], pa.array(np.repeat(np.arange(len(docs)), np.diff(ends))[order])
    block = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))  # first posting of each block
    terms = codes[block]
    folders, first = np.unique(folder_of[terms], return_index=True)  # and the first block of each folder
    first, block = np.append(first, len(block)), np.append(block, len(order))
    return pa.table({
        "bucket": pa.array(folders, pa.int32()), "part": pa.repeat(docs["part"][0], len(folders)),
        "terms": pc.binary_join(_lists(first, words.dictionary.take(pa.array(terms))), " "),
        "ns": _lists(first, pa.array(np.diff(block), pa.int32())),
        "items": _lists(block[first], docs["item_id"].combine_chunks().take(doc)),
        "tfs": _lists(block[first], _flat(docs["tfs"])[0].take(pa.array(order))),
        "dls": _lists(block[first], docs["dl"].combine_chunks().take(doc))})


def _to_blocks(k1: float, b: float, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), UNPACKED):
                rows = batch.slice(at, UNPACKED)
                ns, first = _flat(rows["ns"])
                ends = np.concatenate([[0], np.cumsum(_numbers(ns))])
                items, tfs, dls = (_flat(rows[c])[0] for c in ("items", "tfs", "dls"))
                of = pa.array(np.repeat(np.arange(len(rows)), np.diff(first)))
                peaks = np.maximum.reduceat(_weight(_numbers(tfs), _numbers(dls), k1, b, avgdl), ends[:-1])
                yield pa.RecordBatch.from_pydict({
                    "bucket": rows["bucket"].take(of), "term": _flat(pc.split_pattern(rows["terms"], " "))[0],
                    "part": rows["part"].take(of), "n": ns.cast(pa.int64()), "peak": pa.array(peaks),
                    "items": _lists(ends, items), "tfs": _lists(ends, tfs), "dls": _lists(ends, dls)})

    return run


def build_postings(corpus: DataFrame, k1: float = 1.2, b: float = 0.75, range_docs: int = RANGE_DOCS,
                   alike: Column | None = None) -> PostingIndex:
    """An index of `item_id, text` for the scores of `bm25`; `item_id` is unique.

    Texts are split once and counted in their rows. Two shuffles follow, one of counted words to ranges, where blocks are
    made, and one of all blocks of a range and folder to the folder. Null texts count as documents, but not in the mean
    length, as in `bm25`.

    Bounds are tight if the documents of a range share their words. Documents with different values of `alike` (a
    language, a topic; null is a value, too) do not share ranges. Results do not depend on it.
    """
    spark = corpus.sparkSession
    rows = corpus.select("item_id", "text", (F.lit(0) if alike is None else alike).alias("alike"))
    sizes = rows.groupBy("alike").agg(F.count(F.lit(1)).alias("docs"), F.count("text").alias("texts"))
    sizes = cut_lineage(sizes.withColumnRenamed("alike", "kind"), "posting-kinds")  # of known size
    n_docs, n_texts = sizes.agg(F.sum("docs"), F.sum("texts")).first()
    part = F.xxhash64("kind", F.pmod(F.xxhash64("item_id"), F.ceil(F.col("docs") / range_docs)))
    docs = rows.where(F.col("text").isNotNull()).join(sizes, F.col("alike").eqNullSafe(F.col("kind")))
    counted = docs.select("item_id", part.alias("part"), counted_words(model_words("text")).alias("c"))
    joined = F.array_join("c.terms", " ")  # a word holds no space
    counted = counted.select("item_id", "part", "c.dl", joined.alias("terms"), "c.tfs")
    counts = cut_lineage(counted, "posting-counts", compression="zstd")
    occurrences, n_postings = counts.agg(F.sum("dl"), F.sum(F.size("tfs"))).first()
    avgdl = (occurrences or 0) / max(n_texts or 0, 1) or 1.0
    slices = max(1, -(-(n_postings or 0) // (BUCKETS * FILE_POSTINGS)))

    lists = f"items array<{corpus.schema['item_id'].dataType.simpleString()}>, tfs array<int>, dls array<int>"
    folders = counts.where(F.size("tfs") > 0).groupBy("part").applyInArrow(
        _by_folder, f"bucket int, part bigint, terms string, ns array<int>, {lists}")
    # a folder is cut into slices of the ranges, since a frequent term is in all of them
    dealt = folders.repartition(F.col("bucket"), F.pmod("part", F.lit(slices)))
    blocks = dealt.mapInArrow(_to_blocks(k1, b, avgdl), f"bucket int, term string, part bigint, n bigint, peak double, {lists}")
    blocks = blocks.sortWithinPartitions("bucket", "term", "part")
    path = shared_dir(spark, "postings")
    blocks.write.partitionBy("bucket").option("compression", "zstd").parquet(path)  # ids soon outgrow Parquet's dictionary
    blocks = spark.read.schema(blocks.schema).parquet(path)

    df = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(n_docs or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = cut_lineage(df.select("bucket", "term", idf.alias("idf")), "posting-terms")
    return PostingIndex(blocks, terms, k1, b, avgdl)


def _tile(k: int, k1: float, b: float, avgdl: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(heads: pa.Table, blocks: pa.Table) -> pa.Table:
        """The best k documents of each query in the ranges it wants; about `CELLS` scores are held at a time."""
        query_ids, (items, starts) = _numbers(heads["query_id"]), _flat(blocks["items"])
        wanted, words, idfs = (_flat(heads[c]) for c in ("parts", "words", "idfs"))
        (wanted, wants), (words, asks), idfs = wanted, words, _numbers(idfs[0])
        wanted, words, items = _numbers(wanted), _numbers(words), _numbers(items)
        wanting = np.repeat(np.arange(len(heads)), np.diff(wants))
        weights = _weight(_numbers(_flat(blocks["tfs"])[0]), _numbers(_flat(blocks["dls"])[0]), k1, b, avgdl)
        part, word = _numbers(blocks["part"]), _numbers(blocks["word"])
        by_range = np.lexsort((word, part))
        frames = [BestK(0, k).frame(query_ids)]
        for at in range(0, len(heads) if len(blocks) else 0, BLOCK_QUERIES):
            best = BestK(min(BLOCK_QUERIES, len(heads) - at), k)
            here = slice(*wants[[at, min(at + BLOCK_QUERIES, len(heads))]])
            for own in np.split(by_range, np.flatnonzero(np.diff(part[by_range])) + 1):  # the blocks of a range, by word
                rows = wanting[here][wanted[here] == part[own[0]]]
                if not len(rows):
                    continue
                sizes, terms = starts[own + 1] - starts[own], word[own]
                postings, first = _spans(starts[own], sizes), np.cumsum(sizes) - sizes
                docs, doc = np.unique(items[postings], return_inverse=True)
                n = asks[rows + 1] - asks[rows]
                asked, row = _spans(asks[rows], n), np.repeat(np.arange(len(rows)), n)
                block = np.minimum(np.searchsorted(terms, words[asked]), len(terms) - 1)
                there = terms[block] == words[asked]
                asked, row, block = asked[there], row[there], block[there]
                cost = np.maximum(np.bincount(row, sizes[block], len(rows)), len(docs))
                step = (np.cumsum(cost) - 1) // CELLS
                for q in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(step)) + 1):
                    some = slice(*np.searchsorted(row, [q[0], q[-1] + 1]))
                    n = sizes[block[some]]
                    posting = _spans(first[block[some]], n)
                    cell = np.repeat(row[some] - q[0], n) * len(docs) + doc[posting]
                    scores = np.bincount(cell, np.repeat(idfs[asked[some]], n) * weights[postings[posting]], len(q) * len(docs))
                    scores = scores.reshape(len(q), len(docs))
                    best.add(scores, docs, scores > 0, rows[q] - at)
            frames.append(best.frame(query_ids[at:at + BLOCK_QUERIES]))
        found = pd.concat(frames[1:] or frames)
        types = heads.schema.field("query_id").type, blocks.schema.field("items").type.value_type, pa.float64()
        return pa.table([pa.array(found[c].tolist(), t) for c, t in zip(("query_id", "item_id", "score"), types)],
                        names=["query_id", "item_id", "score"])

    return run


def _scored(chosen: DataFrame, asked: DataFrame, words: DataFrame, blocks: DataFrame, index: PostingIndex, k: int) -> tuple[DataFrame, int]:
    """Documents of the chosen (query_id, part) that have a term of the query, the best k of each query and tile, and the number of tiles.

    A tile holds some ranges. The asked blocks of a range travel to its tile once for every `TILE_QUERIES` queries, and the
    terms of a query once to every tile in which it has a range.
    """
    parts = cut_lineage(chosen.select("part").distinct(), "chosen-ranges")  # of known size
    tiles = max(1, -(-parts.count() // TILE_RANGES))
    groups = max(1, -(-chosen.select("query_id").distinct().count() // TILE_QUERIES))
    tile = F.pmod(F.xxhash64("part"), F.lit(tiles)).alias("tile")
    heads = chosen.select("query_id", "part", tile, F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("of"))
    heads = heads.groupBy("of", "tile", "query_id").agg(F.collect_list("part").alias("parts")).join(asked, "query_id")
    met = blocks.select("bucket", "term", "part", "items", "tfs", "dls").join(words, ["bucket", "term"]).join(parts, "part", "left_semi")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("of")
    met = met.select(every, tile, "part", "word", "items", "tfs", "dls")
    schema = T.StructType([chosen.schema["query_id"], T.StructField("item_id", blocks.schema["items"].dataType.elementType),
                           T.StructField("score", T.DoubleType())])
    run = _tile(k, index.k1, index.b, index.avgdl)
    return heads.groupBy("of", "tile").cogroup(met.groupBy("of", "tile")).applyInArrow(run, schema), tiles


def range_bounds(queries: DataFrame, index: PostingIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search starts from: the terms of each query, the blocks in their folders, and a bound per query and range."""
    asked = explode_values(queries, F.array_distinct(model_words("text")), "term", "query_id")
    asked = asked.select("query_id", "term", _bucket("term").alias("bucket")).join(index.terms, ["bucket", "term"])
    asked = cut_lineage(asked, "asked-terms")
    folders = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most BUCKETS
    blocks = index.blocks.where(F.col("bucket").isin(folders))
    peaks = asked.join(blocks.select("bucket", "term", "part", "peak"), ["bucket", "term"])
    bounds = peaks.groupBy("query_id", "part").agg(F.sum(F.col("idf") * F.col("peak")).alias("bound"))
    return asked, blocks, cut_lineage(bounds, "range-bounds")


def first_ranges(bounds: DataFrame, first: int = FIRST) -> DataFrame:
    return with_rank(bounds, [("bound", "desc"), "part"], ["query_id"], "place", limit=first).drop("place")


def open_ranges(bounds: DataFrame, done: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Ranges not scored yet that may hold one of the best k; scores are compared after rounding."""
    floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(done.select("query_id", "part"), ["query_id", "part"], "left_anti").join(floors, "query_id", "left")
    return rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - F.lit(10.0 ** (1 - DIGITS)))).drop("floor")


def search_postings(queries: DataFrame, index: PostingIndex, k: int, first: int = FIRST) -> DataFrame:
    """Best k items per query (`query_id, text`): `query_id, item_id, score, rank`, the same as `bm25` gives.

    `query_id` is unique. Nothing but the numbers of the folders is on the driver. Bounds are one row per query and
    range; the asked terms are written first, so their joins are broadcast exactly when they are small.
    """
    asked, blocks, bounds = range_bounds(queries, index)
    words = asked.select("bucket", "term", "idf").distinct().withColumn("word", F.monotonically_increasing_id())
    words = cut_lineage(words, "asked-words")  # words travel as numbers
    lists = asked.join(words.select("bucket", "term", "word"), ["bucket", "term"]).groupBy("query_id").agg(F.collect_list(F.struct("word", "idf")).alias("w"))
    lists = cut_lineage(lists.select("query_id", F.col("w.word").alias("words"), F.col("w.idf").alias("idfs")), "asked-lists")
    words = words.select("bucket", "term", "word")
    done = cut_lineage(first_ranges(bounds, first), "first-ranges")
    found, tiles = _scored(done, lists, words, blocks, index, k)
    found = cut_lineage(best_of(found, tiles, k=k), "first-found")
    rest = cut_lineage(open_ranges(bounds, done, found, k), "open-ranges")
    more, tiles = _scored(rest, lists, words, blocks, index, k)
    return best_of(found.drop("rank").unionByName(more), tiles + 1, k=k)
