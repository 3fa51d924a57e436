"""Word counts, special tokens, padding and token accounting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import col, explode_values, normalize_text, pretokenize
from corpuslake.functions.wordlists import SPECIAL_TOKENS
from corpuslake.operators.ordering import with_rank


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """`word, freq` of the normalised corpus.

    Raw words are counted first, in the JVM with map-side partial sums; Python normalises each
    distinct raw word once instead of the whole corpus. Normalising may uncover punctuation, hence
    the second split.
    """
    raw = explode_values(df, pretokenize(text), "raw").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    split = explode_values(raw.select(normalize_text("raw").alias("raw"), "n"), pretokenize("raw"), "word", "n")
    return split.groupBy("word").agg(F.sum("n").alias("freq"))


def add_special_tokens(ids: Column | str, cls: int, sep: int, max_length: int | None = None) -> Column:
    """`[CLS] A [SEP]`, cut so that both special tokens stay."""
    body = col(ids) if max_length is None else F.slice(col(ids), 1, max_length - 2)
    return F.concat(F.array(F.lit(cls)), body, F.array(F.lit(sep)))


def add_special_tokens_pair(a: Column | str, b: Column | str, cls: int, sep: int) -> Column:
    """`[CLS] A [SEP] B [SEP]`."""
    end = F.array(F.lit(sep))
    return F.concat(F.array(F.lit(cls)), col(a), end, col(b), end)


def pad_batch(df: DataFrame, ids: str = "input_ids", batch: str = "batch_id", multiple: int = 64,
              max_length: int | None = None, pad_id: int = 0) -> DataFrame:
    """Pad to `max_length`, or to the longest row of the batch rounded up to `multiple`.

    Adds `attention_mask`. A batch has a fixed number of rows, so a window finds its longest row in one shuffle;
    padding to a fixed length needs none.
    """
    if max_length is not None:
        rows = df.withColumn("__to", F.lit(max_length))
    else:
        longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
        rows = df.withColumn("__to", (F.ceil(longest / multiple) * multiple).cast("int"))
    have = F.size(ids)
    missing = F.col("__to") - have
    rows = rows.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), have), F.array_repeat(F.lit(0), missing)))
    return rows.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), missing))).drop("__to")


def token_totals(df: DataFrame, ids: str = "input_ids", source: str = "source") -> DataFrame:
    """Samples and tokens per source; the row with a null source is the total."""
    return df.rollup(source).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.size(ids)).cast("bigint").alias("tokens"))


def compression_stats(df: DataFrame, ids: str = "input_ids", text: str = "text") -> DataFrame:
    """Tokens per sample and characters per token."""
    tokens, chars = F.size(ids), F.length(text)
    return df.agg(
        F.count(F.lit(1)).alias("samples"), F.sum(tokens).cast("bigint").alias("tokens"),
        F.avg(tokens).alias("avg_tokens"), F.min(tokens).cast("bigint").alias("min_tokens"),
        F.max(tokens).cast("bigint").alias("max_tokens"),
        F.percentile(tokens, F.lit(0.5)).alias("median_tokens"),
        (F.sum(chars) / F.sum(tokens)).alias("chars_per_token"))


def domain_term_coverage(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """For each `term`: is its lower-case form one token of the vocabulary, and which id."""
    lowered = terms.select("term", F.lower("term").alias("token"))
    return lowered.join(vocab, "token", "left").select(
        "term", F.col("id").isNotNull().alias("single"), F.col("id").cast("bigint").alias("id"))


def domain_term_hits(df: DataFrame, terms: Sequence[str], text: str = "text", source: str = "source") -> DataFrame:
    """Occurrences and documents per source and term.

    One-word terms are compared with whole words; terms of several parts (`USB-C`) are looked for
    as substrings. Both are row-local; only per-term sums are shuffled.
    """
    lowered = sorted({t.lower() for t in terms})
    single = [t for t in lowered if re.fullmatch(r"\w+", t)]
    joined = [t for t in lowered if t not in single]
    low = F.lower(text)
    parts = []
    if single:
        words = F.filter(pretokenize(low), lambda w: w.isin(*single))
        hits = F.transform("__words", lambda w, i: F.struct(
            w.alias("term"), F.lit(1).alias("hits"), (F.array_position("__words", w) == i + 1).cast("int").alias("docs")))
        parts.append(explode_values(df.select(source, words.alias("__words")), hits, "s", source))
    if joined:
        counts = F.transform(F.array(*[F.lit(t) for t in joined]), lambda t: F.struct(
            t.alias("term"),
            ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int").alias("hits"),
            F.lit(1).alias("docs")))
        parts.append(explode_values(df, F.filter(counts, lambda s: s["hits"] > 0), "s", source))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(source, F.col("s.term").alias("term")).agg(
        F.sum("s.hits").cast("bigint").alias("hits"), F.sum("s.docs").cast("bigint").alias("docs"))


def build_special_vocab(terms: DataFrame, order: str = "pos", extra: Sequence[str] = (),
                        defaults: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """`token, id`: defaults, bracketed domain terms, extras; the first of equal tokens counts."""
    spark = terms.sparkSession

    def listed(tokens, part):
        return spark.createDataFrame([(part, i, t) for i, t in enumerate(tokens)], "part int, pos bigint, token string")

    domain = terms.select(F.lit(1).alias("part"), F.col(order).cast("bigint").alias("pos"),
                          F.concat(F.lit("["), F.col("term"), F.lit("]")).alias("token"))
    rows = listed(defaults, 0).unionByName(domain).unionByName(listed(extra, 2))
    first = rows.groupBy("token").agg(F.min(F.struct("part", "pos")).alias("at"))
    ranked = with_rank(first.select("token", "at.part", "at.pos"), ["part", "pos", "token"], (), "id")
    return ranked.select("token", (F.col("id") - 1).alias("id"))
