"""Sharding and mixing: laws, odd rows, empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from samples import ODD

from corpuslake.llm.mixing import inclusion_levels, pareto_mix, targets
from corpuslake.llm.sharding import interleaved_shards, op2_interleaved_shards


def check_shards(rows, sources, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for source, n in Counter(sources).items():
        mine = Counter(r["shard"] for r, s in zip(rows, sources) if s == source)
        share = n / len(rows)
        assert all(abs(mine[s] - share * sizes[s]) <= 2 for s in range(shards))


def test_shards_match_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = interleaved_shards(docs).collect()
    check_shards(rows, [r["source"] for r in rows], 8)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    again = interleaved_shards(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_shard_digest_columns(spark, sf):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_interleaved_shards(spark, sf).collect():
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "rows", None)


def test_shards_of_odd_and_empty_tables(make):
    odd = make(ODD)
    out = interleaved_shards(odd, shards=3)
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    rows = out.collect()
    check_shards(rows, [r["source"] for r in rows], 3)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert interleaved_shards(odd.limit(0)).collect() == []


def by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        spread = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else weight[s] * left / spread for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s]} - full
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 7, None: 40}, {"a": 1}, {"a": 0, "b": 3}, {"x": 10, "y": 1_000, "z": 2, "é": 900}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, source_rows long")
    got = {r["source"]: r["target"] for r in targets(frame).collect()}
    assert got == pytest.approx(by_hand(sizes))


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pareto_mix(docs).collect()
    sizes, taken, target, most = Counter(), Counter(), {}, defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert target == pytest.approx(by_hand(dict(sizes)))
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], 10) for s in target)
    assert sorted(map(str, pareto_mix(docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_mix_of_heavy_tails(make):
    """Sources in which one or a few documents are longer than all others together."""
    rows = [(0, "w " * 5_000, "en", "a")] + [(i, "w " * 10, "en", "a") for i in range(1, 100)]
    rows += [(1_000 + i, "w " * int(3 * 1.13 ** (i % 70)), "en", "b") for i in range(200)]
    rows += [(2_000 + i, "w " * (900 if i % 9 == 0 else 7), "en", "c") for i in range(300)]
    taken, target, shortest = Counter(), {}, defaultdict(lambda: 10 ** 9)
    for r in pareto_mix(make(rows)).collect():
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        shortest[r["source"]] = min(shortest[r["source"]], r["size"])
    # "a": without the long document all others can be taken, and the next step would be 5 000 words
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], shortest[s]) for s in "bc") and abs(taken["a"] - target["a"]) <= 990


def test_inclusion_probabilities_add_up(spark):
    words = [5, 5, 7, 20, 100, 400, 3_000]
    units = spark.createDataFrame([("a", w, 900.0) for w in words if w <= 900] + [("b", 3, 100.0)], "source string, words long, missing double")
    level = {r["s"]: r["level"] for r in inclusion_levels(units).collect()}
    p = [min(1.0, level.get("a", math.inf) * math.sqrt(w)) for w in words if w <= 900]
    assert "b" not in level and (sum(p) == len(p) or sum(x * w for x, w in zip(p, words)) == pytest.approx(900.0))


def test_level_with_certain_documents(spark):
    words = [1] * 50 + [10_000, 400]
    units = spark.createDataFrame([("a", w, 10_420.0) for w in words], "source string, words long, missing double")
    level = inclusion_levels(units).first()["level"]
    p = [min(1.0, level * math.sqrt(w)) for w in words]
    assert p[-2] == p[-1] == 1.0 and sum(x * w for x, w in zip(p, words)) == pytest.approx(10_420.0)


def test_mix_of_odd_and_empty_tables(make):
    odd = make(ODD)
    rows = pareto_mix(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    twice = [r["copies"] for r in rows if r["doc_id"] == 2]
    assert len(set(twice)) == 1
    assert pareto_mix(odd.limit(0)).collect() == []
    assert all(r["copies"] == 0 or r["size"] == 0 for r in pareto_mix(make([(1, None, None, None)])).collect())
