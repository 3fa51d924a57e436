"""Packing: exact round trip, capacity, little padding, odd rows; the linear program against bounds."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import ODD
from tokenizers import Tokenizer

from corpuslake.llm.cutting import best_cut, knapsack, plan
from corpuslake.llm.packing import LENGTH, TOKENIZER, Words, op1_column_generation_packing, pack


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_sequences(rows, length=LENGTH):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return sequences


def test_pieces_give_back_every_token(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_column_generation_packing(spark, sf).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(tokenizer, docs[doc]), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = np.array(ids[p["start"]:p["start"] + p["length"]], dtype="<u4")
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = check_sequences(rows)
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) * LENGTH <= tokens * 1.02 + LENGTH


def test_odd_and_empty_tables(make, tokenizer):
    odd = make(ODD)
    packed = pack(odd, length=64, step=4)
    assert packed.columns == [c for c in odd.columns if c not in ("text", "sequence_id")] + ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = packed.collect()
    check_sequences(rows, 64)
    wanted = sorted(str((r[0], len(ids_of(tokenizer, r[1])))) for r in ODD)
    assert sorted(str((r["doc_id"], r["doc_tokens"])) for r in rows if r["start"] == 0) == wanted
    whole = Counter((r["doc_id"], r["doc_tokens"]) for r in ODD for r in rows if r["start"] == 0)
    assert len(whole) > 0
    text = {r[0]: r[1] for r in ODD if r[0] in (3, 4, 6, 7)}
    for doc, value in text.items():
        got = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]))
        assert np.frombuffer(got, dtype="<u4").tolist() == ids_of(tokenizer, value)
    assert pack(odd.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["it's 12 o'clock _a_b  \n\n x", "tab\there ", "ünïcödé×÷ 日本 ² Ⅷ don't we'll", "a\x1cb \x1f c", "<|endoftext|> x", "hello <|endoftext|> world", "'s'''t 'll", "a  b \n c \xa0d\u3000 e", "x" * 100 + "é" * 60])
def test_word_cache_agrees_with_the_tokenizer(tokenizer, text):
    assert np.frombuffer(Words(TOKENIZER).encode(text), dtype="<u2").tolist() == ids_of(tokenizer, text)[:-1]


def test_columns_named_like_steps_are_kept(make):
    names = ["task", "class", "place", "full", "full_before", "words"]
    odd = make(ODD, extra=", ".join(f"{n} string" for n in names[:4]))
    rows = pack(odd, length=64, step=4)
    assert set(names[:4]) <= set(rows.columns) and {(r["task"], r["class"], r["place"], r["full"]) for r in rows.collect()} == {("x", "y", "z", "w")}


def test_a_text_of_megabytes(make, tokenizer):
    text = "Long text, longer words: " * 120_000
    rows = sorted(pack(make([(1, text, "en", "a")])).collect(), key=lambda r: r["start"])
    assert np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype="<u4").tolist() == ids_of(tokenizer, text)


def test_knapsack_and_cut_prices():
    prices = np.array([0.1, 0.25, 0.2, 0.6, 0.55])
    value, pattern = knapsack(prices)
    assert value == pytest.approx(0.7) and sum(k * n for k, n in pattern.items()) <= 5
    gain, whole, part = best_cut(prices)
    best = max((prices[k - 1] - prices[a - 1] - prices[k - a - 1], k) for k in range(2, 6) for a in range(1, k // 2 + 1))
    assert (gain, whole) == pytest.approx(best) and 1 <= part < whole


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_document_and_nears_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 3_000, 64) * (rng.random(64) < 0.6)
    if seed == 3:
        demand[:] = 0
        demand[35] = 50_000  # two never fit without a cut
    runs, sequences = plan(demand)
    used, seen = Counter(), defaultdict(list)
    for r in runs:
        assert 0 <= r.first and r.first + r.count <= demand[r.origin - 1] and r.start + r.size <= r.origin
        seen[r.origin].append(r)
        for j in range(r.count):
            used[r.sequence + j] += r.size
    assert max(used.values()) <= 64 and max(used) < sequences
    for origin, mine in seen.items():  # each document is covered once, from start to end
        total = sum(r.size * r.count for r in mine)
        assert total == origin * demand[origin - 1]
        sizes = np.zeros(demand[origin - 1], dtype=int)
        for r in mine:
            sizes[r.first:r.first + r.count] += r.size
        assert (sizes == origin).all()
    bound = float((demand * np.arange(1, 65)).sum()) / 64
    assert sequences <= bound * 1.02 + 64
    assert plan(np.zeros(64, dtype=int)) == ([], 0)
