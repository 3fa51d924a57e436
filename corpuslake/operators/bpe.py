"""Byte-pair training on the distinct-word table, and encoding.

Only counting words touches the corpus. Training works on `(freq, symbols)` rows, one per distinct word. Ties are
broken by count descending, then left and right symbol ascending.

A round learns thousands of merges with a fixed number of jobs. All pairs with more than some count are linked, and
words are cut where a pair is not linked. A pair that a merge makes is at most as frequent as the pair of symbols at
its seam, so every pair that ever exceeds that count lies inside these segments. Distinct segments with their counts are
few, because most words fall into the same short ones; merging them one by one gives exactly the merges that the
whole table would give, down to that count.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from corpuslake.functions.text import explode_values
from corpuslake.functions.vectors import let
from corpuslake.functions.wordlists import SPECIAL_TOKENS
from corpuslake.session import cut_lineage, spread

CANDIDATES = 256        # best pairs looked at when more than PAIRS pairs share the highest count
PAIRS = 200_000         # best pairs that a round links, at most
SEGMENTS = 100_000      # distinct segments that the driver merges in a round, at most
FIRST_LOOK = 64         # pairs that the first round looks at
COUNTED = 200_000       # segments that a task counts before it hands its counts on
CACHED_WORDS = 200_000  # encoded words kept per Python worker


def spaced(word: Column | str) -> Column:
    """The word's characters, each between two blanks. A word never holds a blank itself."""
    return F.regexp_replace(word, "(?s)(.)", " $1 ")


def adjacent(symbols: Column, sign: int) -> Column:
    """Neighbouring symbols of a word as an array of `a, b, sign`."""
    def zipped(parts: Column) -> Column:
        n = F.size(parts) - 1
        return F.arrays_zip(F.slice(parts, F.lit(1), n).alias("a"), F.slice(parts, F.lit(2), n).alias("b"),
                            F.array_repeat(F.lit(sign), n).alias("sign"))

    return let(F.split(F.btrim(symbols), "  "), zipped)


def pair_rows(words: DataFrame, pairs: Column) -> DataFrame:
    """`left, right, n` for every element of an array of neighbours."""
    rows = explode_values(words.select("freq", pairs.alias("pairs")), F.col("pairs"), "p", "freq")
    return rows.select(F.col("p.a").alias("left"), F.col("p.b").alias("right"), (F.col("freq") * F.col("p.sign")).alias("n"))


def add_up(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def independent_merges(best: list[tuple[str, str, int]], known: set[str], room: int, min_frequency: int) -> list[tuple[str, str]]:
    """The longest head of the sorted pair list that equals as many one-by-one merges.

    A merge changes the counts of pairs that share a symbol with it, and creates pairs that are at
    most as frequent as those. So merges are taken while they share no symbol, and only while they
    are strictly more frequent than the first pair that does share one. A merge of equal symbols, or
    one whose result already exists, can only be the last.
    """
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    limit = best[-1][2] if len(best) == CANDIDATES else 0
    closed = False
    for left, right, n in best:
        clash = left in used or right in used
        if clash:
            limit = n
            break
        if closed or n < min_frequency:
            continue
        made = left + right
        closed = left == right or made in known or made in used
        taken.append((left, right, n))
        used.update((left, right, made))
    head = [t for i, t in enumerate(taken) if i == 0 or t[2] > limit]
    return [(left, right) for left, right, n in head[:room] if n >= min_frequency]


def merge_pair(parts: list[str], left: str, right: str) -> list[str]:
    """All occurrences of a pair merged, from left to right."""
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def merged_in_order(parts: list[str], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """A word after a list of merges, each applied once in its turn; a pair may have several turns."""
    last = -1
    while len(parts) > 1:
        found = min(((r, p) for p in zip(parts, parts[1:]) for r in ranks.get(p, ()) if r > last), default=None)
        if found is None:
            break
        last = found[0]
        parts = merge_pair(parts, *found[1])
    return parts


def parts_of(symbols: str) -> list[str]:
    return symbols.strip(" ").split("  ")


def symbols_of(parts: Sequence[str]) -> str:
    return f" {'  '.join(parts)} "


def merged_words(state: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """`freq, symbols` after some merges."""
    ranks: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, pair in enumerate(merges):
        ranks[pair].append(i)
    model = state.sparkSession.sparkContext.broadcast(dict(ranks))  # merges of one round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [symbols_of(merged_in_order(parts_of(s), model.value)) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["freq", "symbols"])

    return state.select("freq", "symbols").mapInArrow(run, "freq bigint, symbols string")


def linked_segments(state: DataFrame, linked: Sequence[tuple[str, str]]) -> DataFrame:
    """`symbols, freq`: the longest runs of symbols in which each neighbouring pair is linked, counted over all words."""
    pairs = state.sparkSession.sparkContext.broadcast(set(linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["symbols", "freq"])
            counts.clear()
            return batch

        for batch in batches:
            for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = parts_of(s)
                begin = 0
                for i in range(1, len(parts) + 1):
                    if i == len(parts) or (parts[i - 1], parts[i]) not in pairs.value:
                        if i - begin > 1:
                            counts[symbols_of(parts[begin:i])] += n
                        begin = i
            if len(counts) > COUNTED:
                yield made()
        if counts:
            yield made()

    runs = state.select("freq", "symbols").mapInArrow(run, "symbols string, freq bigint")
    return runs.groupBy("symbols").agg(F.sum("freq").alias("freq"))


def merge_segments(segments: list[tuple[list[str], int]], least: int, known: set[str], room: int) -> list[tuple[str, str]]:
    """One-by-one merges of the most frequent pair, until none occurs `least` times or `room` new tokens are made.

    Every change of a count goes on a heap; an entry whose count is no longer true is passed over.
    """
    parts = [p for p, _ in segments]
    counts: Counter[tuple[str, str]] = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (p, n) in enumerate(segments):
        for pair in zip(p, p[1:]):
            counts[pair] += n
            where[pair].add(i)
    heap = [(-n, *pair) for pair, n in counts.items() if n >= least]
    heapq.heapify(heap)
    merges, made = [], set()
    while heap and room > 0:
        n, left, right = heapq.heappop(heap)
        if counts[left, right] != -n:
            continue
        merges.append((left, right))
        if left + right not in known and left + right not in made:
            made.add(left + right)
            room -= 1
        changed = set()
        for i in where.pop((left, right)):
            before, freq = parts[i], segments[i][1]
            after = merge_pair(before, left, right)
            if len(after) == len(before):
                continue
            for pair in zip(before, before[1:]):
                counts[pair] -= freq
                changed.add(pair)
            for pair in zip(after, after[1:]):
                counts[pair] += freq
                where[pair].add(i)
                changed.add(pair)
            parts[i] = after
        for pair in changed:
            if counts[pair] >= least:
                heapq.heappush(heap, (-counts[pair], *pair))
    return merges


def train_bpe(words: DataFrame, vocab_size: int, min_frequency: int = 2, specials: Sequence[str] = SPECIAL_TOKENS,
              pairs: int = PAIRS, segments: int = SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """`vocab(token, id)` and `merges(rank, left, right)` from `words(word, freq)`.

    A round counts pairs, links the most frequent ones, counts the segments that they form, merges those segments on
    the driver and applies the merges to all words: five jobs, however many merges it learns. The number of linked
    pairs grows while their segments stay few. The driver holds the vocabulary being built, at most `pairs` pairs and
    at most `segments` distinct segments. If more pairs than that share the highest count, the round falls back
    to merges that provably do not touch each other.
    """
    spark = words.sparkSession
    whole = cut_lineage(spread(words.select("freq", spaced("word").alias("symbols")), "symbols"), "bpe-words")
    letters = explode_values(whole, F.split(F.btrim("symbols"), "  "), "s").distinct()
    tokens = list(dict.fromkeys([*specials, *[r["s"] for r in letters.orderBy("s").collect()]]))
    known, merges, look, state = set(tokens), [], FIRST_LOOK, whole
    while len(tokens) < vocab_size:
        state = state.where(F.instr("symbols", "  ") > 0)  # words of one symbol have no pairs
        counted = add_up(pair_rows(state, adjacent(F.col("symbols"), 1))).where(F.col("n") >= min_frequency)
        ordered = counted.orderBy(F.desc("n"), "left", "right").limit(look + 1)
        best = [(r["left"], r["right"], r["n"]) for r in ordered.collect()]
        if not best:
            break
        room = vocab_size - len(tokens)
        least = min_frequency if len(best) <= look else best[-1][2] + 1
        linked = [(left, right) for left, right, n in best if n >= least]
        if not linked and look < pairs:
            look = min(pairs, 8 * look)  # all of them share one count
            continue
        if not linked:
            batch = independent_merges(best[:CANDIDATES], known, room, min_frequency)
        else:
            while True:
                found = cut_lineage(linked_segments(state, linked), "bpe-segments")
                distinct = found.count()
                smaller = best[len(linked) // 2][2] + 1
                if distinct <= segments or not any(n >= smaller for _, _, n in best):
                    break
                least = smaller
                linked = [(left, right) for left, right, n in best if n >= least]
            batch = merge_segments([(parts_of(r["symbols"]), r["freq"]) for r in found.collect()], least, known, room)
            look = min(pairs, 4 * len(linked)) if distinct <= segments // 4 else max(len(linked), 2)
        merges += batch
        for left, right in batch:
            if left + right not in known:
                known.add(left + right)
                tokens.append(left + right)
        if len(tokens) < vocab_size:
            state = cut_lineage(merged_words(state, batch), "bpe-words")
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id bigint")
    ranked = [(i, left, right) for i, (left, right) in enumerate(merges)]
    return vocab, spark.createDataFrame(ranked, "rank bigint, left string, right string")


def segment(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """One word as tokens: the earliest learned merge that applies goes first."""
    parts = list(word)
    while len(parts) > 1:
        found = min(((ranks[p], p) for p in zip(parts, parts[1:]) if p in ranks), default=None)
        if found is None:
            break
        parts = merge_pair(parts, *found[1])
    return parts


def encoded_lists(words: pa.Array, encode: Callable[[str], list], kind: pa.DataType) -> pa.Array:
    """Lists of words as lists of what `encode` gives for a word, called once per distinct word of the batch.

    Everything else works on whole columns, so no Python object is made per word or token of a text.
    """
    distinct = words.flatten().dictionary_encode()
    lists = pa.array([None if w is None else encode(w) for w in distinct.dictionary.to_pylist()], pa.list_(kind))
    found = lists.take(distinct.indices)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = found.offsets.take(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()))
    return pa.ListArray.from_arrays(ends, found.values, mask=words.is_null())


def _encoder(spark, words: Column, merges: Sequence[tuple[str, str]], known: Sequence[str] | None, unknown: str,
             ids: dict[str, int] | None) -> Column:
    model = spark.sparkContext.broadcast(
        ({pair: i for i, pair in reversed(list(enumerate(merges)))}, set(known) if known is not None else None, ids))
    cache: dict[str, list] = {}
    same: dict[str, str] = {}

    def encode(batch: pa.Array) -> pa.Array:
        ranks, allowed, table = model.value

        def one(word: str) -> list:
            if word not in cache:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                    same.clear()
                parts = [p if allowed is None or p in allowed else unknown for p in segment(word, ranks)]
                cache[word] = [same.setdefault(p, p) for p in parts] if table is None else [table[p] for p in parts]
            return cache[word]

        return encoded_lists(batch, one, pa.string() if table is None else pa.int32())

    udf = F.arrow_udf(encode, "array<string>" if ids is None else "array<int>", ArrowUDFType.SCALAR)
    return udf.asNondeterministic()(words)  # never copied into filters over the result


def bpe_tokens(spark, words: Column, merges: Sequence[tuple[str, str]], known: Sequence[str] | None = None,
               unknown: str = "[UNK]") -> Column:
    """Tokens of an array of words; symbols outside `known` become `unknown`.

    Row-local, so encoding needs no shuffle. What is broadcast is the merge list, at most as long
    as the vocabulary; a word is segmented once per batch, frequent words once per task.
    """
    return _encoder(spark, words, merges, known, unknown, None)


def encode_bpe(df: DataFrame, words: Column, vocab: DataFrame, merges: DataFrame, out: str = "input_ids",
               unknown: str = "[UNK]") -> DataFrame:
    """Add token ids. Both model tables are bounded by the vocabulary size and read on the driver."""
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    pairs = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    return df.withColumn(out, _encoder(df.sparkSession, words, pairs, list(ids), unknown, ids))
