"""Byte-pair training and encoding, token accounting, masks and packs against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.functions.wordlists import COVERAGE_TERMS, SPECIAL_TOKENS
from corpuslake.operators import bpe, shaping, splits
from corpuslake.operators.bpe import bpe_tokens, encode_bpe, segment, train_bpe
from corpuslake.operators.shaping import apply_mask, assign_batches, mask_report, pack_next_fit, pack_sequences, packed_layout, span_masks
from corpuslake.operators.tokens import (
    add_special_tokens, build_special_vocab, domain_term_coverage, domain_term_hits, pad_batch, token_totals, word_counts)

SENTENCES = [
    "The company reported strong EBITDA growth with ROI exceeding expectations.",
    "This HDMI cable supports 4K resolution and is made of durable polyester.",
    "According to the 10-K filing, the company's WACC decreased by 50 basis points.",
    "SKU: ABC123 - Bluetooth wireless earbuds with USB-C charging.",
]


def model_bpe(words, vocab_size, min_frequency=2):
    """One merge at a time: count descending, then left and right ascending."""
    state = [(list(w), n) for w, n in words.items()]
    tokens = list(dict.fromkeys([*SPECIAL_TOKENS, *sorted({c for s, _ in state for c in s})]))
    merges = []
    while len(tokens) < vocab_size:
        pairs = Counter()
        for s, n in state:
            for pair in zip(s, s[1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < min_frequency:
            break
        merges.append(best)
        if "".join(best) not in tokens:
            tokens.append("".join(best))
        merged = []
        for s, n in state:
            out, i = [], 0
            while i < len(s):
                if tuple(s[i:i + 2]) == best:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            merged.append((out, n))
        state = merged
    return tokens, merges


def words_frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, freq long")


@pytest.mark.parametrize("seed", range(3))
def test_training_equals_one_by_one_merging(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcde"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 12) for _ in range(60)}
    words["aaaaaaa"] = 9
    vocab, merges = train_bpe(words_frame(spark, words), vocab_size=40)
    tokens, expected = model_bpe(words, 40)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == expected
    assert [r.token for r in vocab.orderBy("id").collect()] == tokens


@pytest.mark.parametrize("pairs,segments", [(200_000, 100_000), (200_000, 40), (7, 100_000), (2, 3)])
def test_rounds_of_any_size_learn_the_same_merges(spark, monkeypatch, pairs, segments):
    """Few pairs and segments per round force ties beyond the look, smaller links and the fall-back."""
    monkeypatch.setattr(bpe, "FIRST_LOOK", min(pairs, 50))
    rng = random.Random(7)
    parts = ["ab", "ba", "aa", "cd", "dab", "é", "ce"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))): rng.choice([1, 2, 2, 3, 40]) for _ in range(150)}
    vocab, merges = train_bpe(words_frame(spark, words), vocab_size=110 if pairs > 2 else 40, pairs=pairs, segments=segments)
    tokens, expected = model_bpe(words, 110 if pairs > 2 else 40)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == expected
    assert [r.token for r in vocab.orderBy("id").collect()] == tokens


def test_a_thousand_merges_of_all_words(spark, sf):
    counts = word_counts(spark.read.parquet(f"{sf}/documents.parquet"))
    words = {r["word"]: r["freq"] for r in counts.collect()}
    vocab, merges = train_bpe(counts, vocab_size=1_100)
    tokens, expected = model_bpe(words, 1_100)
    assert len(expected) >= 1_000 and [(r.left, r.right) for r in merges.orderBy("rank").collect()] == expected
    assert [r.token for r in vocab.orderBy("id").collect()] == tokens


def test_training_stops_at_the_vocabulary_size_and_minimum_frequency(spark):
    words = {"hello": 5, "help": 3, "zq": 1}
    vocab, merges = train_bpe(words_frame(spark, words), vocab_size=17)
    assert vocab.count() == 17
    vocab, merges = train_bpe(words_frame(spark, words), vocab_size=500, min_frequency=4)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == model_bpe(words, 500, 4)[1]


def test_independent_merges_never_pass_a_clash():
    best = [("a", "b", 10), ("c", "d", 9), ("b", "c", 8), ("e", "f", 7)]
    assert bpe.independent_merges(best, set(), 10, 2) == [("a", "b"), ("c", "d")]
    assert bpe.independent_merges([("a", "b", 9), ("c", "d", 8), ("b", "c", 8)], set(), 10, 2) == [("a", "b")]
    assert bpe.independent_merges([("a", "a", 9), ("c", "d", 8)], set(), 10, 2) == [("a", "a")]
    assert bpe.independent_merges([("a", "b", 9), ("ab", "d", 8)], set(), 10, 2) == [("a", "b")]


def test_domain_terms_become_single_tokens(spark):
    texts = ["ebitda roi hdmi polyester sku wacc"] * 200
    counts = word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.word: r.freq for r in counts.collect()} == {t: 200 for t in COVERAGE_TERMS}
    vocab, merges = train_bpe(counts, vocab_size=120)
    assert vocab.count() <= 120
    terms = spark.createDataFrame([(t.upper(),) for t in COVERAGE_TERMS] + [("absent",)], "term string")
    covered = {r.term: r.single for r in domain_term_coverage(vocab, terms).collect()}
    assert covered.pop("absent") is False and all(covered.values())
    rows = spark.createDataFrame([(["roi", "sku", "qqq"],)], "w array<string>")
    ids = encode_bpe(rows, F.col("w"), vocab, merges).first().input_ids
    table = {r.token: r.id for r in vocab.collect()}
    assert ids == [table["roi"], table["sku"]] + [table["[UNK]"]] * 3


def test_segment_follows_merge_order(spark):
    merges = [("b", "c"), ("a", "b"), ("a", "bc")]
    ranks = {m: i for i, m in enumerate(merges)}
    assert segment("abc", ranks) == ["abc"] and segment("ab", ranks) == ["ab"] and segment("xabcab", ranks) == ["x", "abc", "ab"]
    rows = spark.createDataFrame([(["abc", "xb"],), (None,), ([],)], "w array<string>")
    got = rows.select(bpe_tokens(spark, F.col("w"), merges, ["abc", "b"]).alias("t")).collect()
    assert [r.t for r in got] == [["abc", "[UNK]", "b"], None, []]


def test_special_tokens_and_padding(spark):
    rows = spark.createDataFrame([(0, 0, list(range(10, 14))), (0, 1, list(range(10, 80))), (1, 2, [5])], "batch_id int, id int, input_ids array<int>")
    wrapped = rows.select("id", add_special_tokens("input_ids", 2, 3, 6).alias("w")).orderBy("id").collect()
    assert wrapped[0].w == [2, 10, 11, 12, 13, 3] and wrapped[1].w == [2, 10, 11, 12, 13, 3] and wrapped[2].w == [2, 5, 3]
    padded = {r.id: r for r in pad_batch(rows).collect()}
    assert [len(padded[i].input_ids) for i in range(3)] == [128, 128, 64]
    assert sum(padded[0].attention_mask) == 4 and padded[0].input_ids[4:] == [0] * 124
    fixed = pad_batch(rows, max_length=80)
    assert {len(r.input_ids) for r in fixed.collect()} == {80}
    totals = {r.source: (r.samples, r.tokens) for r in token_totals(rows.withColumn("source", F.lit("a"))).collect()}
    assert totals == {"a": (3, 75), None: (3, 75)}


def test_special_vocabulary_keeps_first_occurrence(spark):
    terms = spark.createDataFrame([("ROI", 1), ("PAD", 0), ("ROI", 3), ("SKU", 2)], "term string, pos long")
    got = [r.token for r in build_special_vocab(terms, extra=["[SKU]", "[NEW]"]).orderBy("id").collect()]
    assert got == [*SPECIAL_TOKENS, "[ROI]", "[SKU]", "[NEW]"]


def test_domain_term_hits(spark):
    rows = spark.createDataFrame([("a", s) for s in SENTENCES] + [("a", "roi ROI roisin")], "source string, text string")
    got = {r.term: (r.hits, r.docs) for r in domain_term_hits(rows, ["ROI", "HDMI", "USB-C", "10-K", "SEC"]).collect()}
    assert got == {"roi": (3, 2), "hdmi": (1, 1), "usb-c": (1, 1), "10-k": (1, 1)}


def test_spans_are_disjoint_and_exact(spark):
    lengths = [0, 1, 2, 3, 5, 20, 200, 4096] * 20
    rows = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate(lengths)], "doc_id long, input_ids array<int>")
    shares, sizes = [], []
    for r in span_masks(rows, seed=1).collect():
        length = len(r.input_ids)
        covered = [i for s in r.spans for i in range(s.start, s.end)]
        assert len(covered) == len(set(covered)) and covered == sorted(covered)
        assert all(0 < i < length - 1 for i in covered)
        assert min(int(length * 0.05), max(length - 2, 0)) <= len(covered) <= int(length * 0.30)
        if length == 4096:
            shares.append(len(covered) / length)
            sizes += [s.end - s.start for s in r.spans]
    assert 0.05 <= min(shares) < 0.12 and 0.22 < max(shares) <= 0.30
    assert 3 <= sum(sizes) / len(sizes) <= 4.5 and max(sizes) > 9  # pieces of no token fall out


def test_mask_and_report(spark):
    rows = spark.createDataFrame([(i, "a", list(range(100, 100 + n))) for i, n in enumerate([1, 2, 40, 500])], "doc_id long, source string, input_ids array<int>")
    spans = span_masks(rows, seed=4)
    assert [r.spans for r in spans.orderBy("doc_id").collect()] == [r.spans for r in span_masks(rows.repartition(3), seed=4).orderBy("doc_id").collect()]
    for before, after in zip(spans.orderBy("doc_id").collect(), apply_mask(spans, 4).orderBy("doc_id").collect()):
        inside = {i for s in before.spans for i in range(s.start, s.end)}
        assert after.input_ids == [4 if i in inside else t for i, t in enumerate(before.input_ids)]
        assert after.labels == [t if i in inside else -100 for i, t in enumerate(before.input_ids)]
    report = mask_report(spans).first()
    assert report.tokens == 543 and report.share == report.masked / 543


def test_packing_stops_at_the_first_overflow(spark):
    lengths = {0: [3, 4, 2, 1], 1: [20, 1], 2: [10], 3: [5, 6, 1]}
    rows = spark.createDataFrame(
        [(b, p, [b * 100 + p] * n, [1] * n) for b, ns in lengths.items() for p, n in enumerate(ns)],
        "batch_id long, pos long, input_ids array<int>, labels array<int>")
    for kw in ({}, {"hot_rows": 2}):
        packed = pack_sequences(rows, 10, **kw)
        layout = {r.batch_id: r for r in packed_layout(packed).collect()}
        assert layout[0].cu_seqlens == [0, 3, 7, 9, 10] and layout[0].position_ids == [0, 1, 2, 0, 1, 2, 3, 0, 1, 0]
        assert layout[1].cu_seqlens == [0, 10] and set(layout[1].labels) == {-100} and layout[1].max_seqlen == 10
        assert layout[2].cu_seqlens == [0, 10] and set(layout[2].labels) == {1}
        assert layout[3].cu_seqlens == [0, 5] and layout[3].input_ids == [300] * 5


def test_layout_of_next_fit_packs(spark):
    rows = spark.createDataFrame([(0, p, [p] * n) for p, n in enumerate([3, 4, 2, 2, 9, 1])], "batch_id long, pos long, input_ids array<int>")
    layout = {r.pack: r for r in packed_layout(pack_next_fit(rows, 10), ["batch_id", "pack"]).collect()}
    assert [layout[i].cu_seqlens for i in range(3)] == [[0, 3, 7, 9], [0, 2], [0, 9, 10]]
    assert layout[2].input_ids == [4] * 9 + [5] and layout[0].position_ids == [0, 1, 2, 0, 1, 2, 3, 0, 1]


@pytest.mark.parametrize("parts", [1, 3])
def test_next_fit_leaves_nothing_out(spark, parts):
    lengths = {0: [3, 4, 2, 2, 9, 1], 1: [20, 1, 0, 10], 2: []}
    rows = spark.createDataFrame([(b, p, [7] * n) for b, ns in lengths.items() for p, n in enumerate(ns)], "batch_id long, pos long, input_ids array<int>")
    got = {(r.batch_id, r.pos): (r.pack, r.start) for r in pack_next_fit(rows.repartition(parts), 10).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 3), (0, 2): (0, 7), (0, 3): (1, 0), (0, 4): (2, 0), (0, 5): (2, 9),
                   (1, 0): (0, 0), (1, 1): (1, 0), (1, 3): (2, 0)}


def next_fit_model(sizes, max_len):
    packs, pack, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i and used + n > max_len:
            pack, used = pack + 1, 0
        packs.append((pack, used))
        used += n
    return packs


@pytest.mark.parametrize("most", [500_000, 0])
def test_next_fit_of_one_batch_in_many_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(shaping, "with_states", lambda rows, states, split: splits.with_states(rows, states, split, most))
    draw = random.Random(3)
    sizes = {0: [draw.choice([1, 2, 3, 7, 9, 16, 17, 40]) for _ in range(3_000)], 1: [16] * 5, None: [5, 5, 5, 5], 3: [40], 4: [1] * 200}
    rows = spark.createDataFrame([(b, p, [0] * n) for b, ns in sizes.items() for p, n in enumerate(ns)], "batch_id int, pos int, input_ids array<int>")
    packed = pack_next_fit(rows.repartition(5), 16)
    assert not most or packed.where("batch_id = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = {(r.batch_id, r.pos): (r.pack, r.start) for r in packed.select("batch_id", "pos", "pack", "start").collect()}
    assert got == {(b, p): place for b, ns in sizes.items() for p, place in enumerate(next_fit_model(ns, 16))}


@given(st.lists(st.integers(1, 12), min_size=1, max_size=30), st.integers(1, 10))
def test_next_fit_table_says_what_every_state_becomes(sizes, max_len):
    sizes = np.array(sizes)
    used, packs = shaping._fit_any(sizes, max_len)
    for state in range(max_len + 1):
        assert (used[state], packs[state]) == shaping._fit(sizes, state, 0, max_len)[2:]


def test_next_fit_of_nothing(spark):
    rows = spark.createDataFrame([], "batch_id int, pos int, input_ids array<int>")
    assert pack_next_fit(rows).columns == ["batch_id", "pos", "input_ids", "pack", "start"] and pack_next_fit(rows).count() == 0


def test_batches(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "doc_id long, source string")
    got = assign_batches(rows, 4, ["doc_id"], ["source"]).where("source = 'a'").orderBy("doc_id").collect()
    assert [(r.batch_id, r.pos) for r in got] == [(i // 4, i % 4) for i in range(10)]


def test_a_word_is_encoded_once_per_batch():
    import pyarrow as pa
    from corpuslake.operators.bpe import encoded_lists

    rows = [["ab", "c", "ab"], None, [], ["c", None, "ab"], ["ab"] * 50]
    asked = []
    got = encoded_lists(pa.array(rows, pa.list_(pa.string())).slice(0), lambda w: asked.append(w) or list(w), pa.string())
    assert got.to_pylist() == [["a", "b", "c", "a", "b"], None, [], ["c", "a", "b"], ["a", "b"] * 50]
    assert sorted(asked) == ["ab", "c"]
    part = encoded_lists(pa.array(rows, pa.list_(pa.string())).slice(2, 2), list, pa.string())
    assert part.to_pylist() == [[], ["c", "a", "b"]]
    assert encoded_lists(pa.array([], pa.list_(pa.string())), list, pa.string()).to_pylist() == []
