"""Positions, caps, mixing and shuffles: plain models, hot groups and other partitionings."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslake.operators import epochs
from corpuslake.operators.epochs import epoch_places, number_rows, shuffled_place
from corpuslake.operators.ordering import with_rank
from corpuslake.operators.sampling import (
    assign_shards, cap_per_source, cap_scanned, epoch_split, interleave_round_robin, mix_by_ratio, oversample_cap, shard,
    shuffle_blocks, shuffle_global, take_first)


@pytest.fixture(scope="module")
def skewed(spark):
    """2 400 rows of which `big` holds two thirds; a null source; repeated and missing sort values."""
    rows = [(i, "big" if i % 3 else ("s%d" % (i % 5) if i % 7 else None), None if i % 50 == 0 else (i * 37) % 11, float((i * i) % 101))
            for i in range(2400)]
    return spark.createDataFrame(rows, "doc_id long, source string, k int, score double").cache()


@pytest.mark.parametrize("order", [["doc_id"], [("doc_id", "desc")], ["k", "doc_id"], [("k", "desc"), "doc_id"], [("score", "desc"), "doc_id"]])
@pytest.mark.parametrize("by", [[], ["source"]])
def test_hot_groups_get_the_same_ranks(skewed, order, by):
    plain = {(r.doc_id, r.rank) for r in with_rank(skewed, order, by).collect()}
    split = {(r.doc_id, r.rank) for r in with_rank(skewed, order, by, hot_rows=100).collect()}
    assert plain == split and len(plain) == 2400
    head = with_rank(skewed, order, by, limit=130, hot_rows=100)
    assert {(r.doc_id, r.rank) for r in head.collect()} == {p for p in plain if p[1] <= 130}
    assert head.columns == [*skewed.columns, "rank"]


def test_hot_group_with_string_order_and_one_value(spark):
    rows = spark.createDataFrame([(i, "g", "word%04d" % (i % 700), 1) for i in range(1500)], "doc_id long, g string, w string, same int")
    rows = rows.withColumn("gaps", F.expr("IF(doc_id % 4 = 1, NULL, 5)"))
    for order in (["w", "doc_id"], ["same", "doc_id"], ["gaps", "doc_id"], [("gaps", "desc"), ("w", "desc"), "doc_id"]):
        plain = {(r.doc_id, r.rank) for r in with_rank(rows, order, ["g"]).collect()}
        assert plain == {(r.doc_id, r.rank) for r in with_rank(rows, order, ["g"], hot_rows=60).collect()}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(skewed, parts):
    rows = skewed.repartition(parts)
    assert {r.doc_id for r in cap_per_source(rows, 9).collect()} == {r.doc_id for r in cap_per_source(skewed, 9, hot_rows=50).collect()}
    got = [r.doc_id for r in shuffle_global(rows.select("doc_id"), 3).collect()]
    assert got == [r.doc_id for r in shuffle_global(skewed.select("doc_id").coalesce(1), 3).collect()]


def test_cap_counts_emitted_or_scanned_rows(spark):
    rows = spark.createDataFrame([(i, "a", i % 2) for i in range(10)], "doc_id long, source string, good int")
    assert [r.doc_id for r in cap_per_source(rows.where("good = 1"), 3).orderBy("doc_id").collect()] == [1, 3, 5]
    assert [r.doc_id for r in cap_scanned(rows, 3, F.col("good") == 1).collect()] == [1]


def model_oversample(sources, n):
    out = []
    for rows in sources:
        out += rows[:2 * n]
        if len(out) >= n:
            break
    return out[:n]


def test_oversample(spark):
    sources = [list(range(0, 4)), list(range(10, 60)), list(range(100, 130))]
    rows = spark.createDataFrame([(d, i) for i, s in enumerate(sources) for d in s], "doc_id long, source_rank long")
    for n in (1, 4, 5, 20, 54, 200):
        got = [r.doc_id for r in oversample_cap(rows, n).orderBy("position").collect()]
        assert got == model_oversample(sources, n)


def model_round_robin(sources):
    iterators, out = [iter(s) for s in sources], []
    live = list(iterators)
    while live:
        for it in list(live):
            try:
                out.append(next(it))
            except StopIteration:
                live.remove(it)
    return out


@pytest.mark.parametrize("listed", [None, ["s4", "big"], ["big", "absent", "s0", "s1"]])
def test_round_robin(skewed, listed):
    rows = skewed.select("doc_id", "source")
    table = {}
    for r in rows.orderBy("doc_id").collect():
        table.setdefault(r.source, []).append(r.doc_id)
    others = sorted((n for n in table if n not in (listed or [])), key=lambda n: (n is None, n or ""))
    want = model_round_robin([table[n] for n in [n for n in listed or [] if n in table] + others])
    assert len(want) == 2400
    for kw in ({}, {"hot_rows": 100}):
        got = interleave_round_robin(rows, sources=listed, **kw).orderBy("position").collect()
        assert [r.doc_id for r in got] == want
        assert [r.position for r in got] == list(range(len(want)))


@pytest.mark.parametrize("kind", ["date", "timestamp", "decimal(12,3)", "binary", "string", "double"])
def test_hot_groups_of_any_sortable_type(skewed, kind):
    values = {"date": "date_add(date'2020-01-01', CAST(doc_id % 400 AS INT))", "timestamp": "timestamp_seconds(doc_id % 500)",
              "decimal(12,3)": "CAST((doc_id * 7919) % 1000 AS DECIMAL(12,3)) / 8", "binary": "unhex(md5(CAST(doc_id % 300 AS STRING)))",
              "string": "md5(CAST(doc_id % 300 AS STRING))",
              "double": "CASE doc_id % 50 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') WHEN 3 THEN NULL ELSE doc_id % 91 END"}
    rows = skewed.selectExpr("doc_id", "source", f"{values[kind]} AS v")
    for order in (["v", "doc_id"], [("v", "desc"), "doc_id"]):
        plain = {(r.doc_id, r.rank) for r in with_rank(rows, order, ["source"]).collect()}
        assert plain == {(r.doc_id, r.rank) for r in with_rank(rows, order, ["source"], hot_rows=50).collect()}


def test_whole_table_orders_use_no_single_partition(skewed):
    for frame in (assign_shards(skewed, 4), take_first(skewed, 9), epoch_split(skewed, 3, 0, 1)):
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()


def test_shuffles_are_permutations(skewed):
    ids = sorted(r.doc_id for r in skewed.collect())
    rows = skewed.select("doc_id")
    first = [r.doc_id for r in shuffle_global(rows, 1).collect()]
    assert sorted(first) == ids and first != ids
    assert first != [r.doc_id for r in shuffle_global(rows, 2).collect()]
    blocks = shuffle_blocks(rows, 1, block=500, hot_rows=300).orderBy("position").collect()
    assert sorted(r.doc_id for r in blocks) == ids
    for number, part in itertools.groupby(blocks, key=lambda r: r.block):
        assert sorted(r.doc_id for r in part) == ids[number * 500:(number + 1) * 500]


def test_shards_partition_the_rows(skewed):
    rows = skewed.select("doc_id")
    parts = [{r.doc_id for r in shard(rows, 5, i).collect()} for i in range(5)]
    assert sum(map(len, parts)) == 2400 and len(set().union(*parts)) == 2400
    assert {r.shard for r in assign_shards(rows, 5).collect()} == set(range(5))


def test_epoch_split(skewed):
    rows = skewed.select("doc_id").where("doc_id < 100")
    wrapped = epoch_split(rows, 7, 0, 1).collect()
    assert len(wrapped) == 105 and {r.doc_id for r in wrapped} == set(range(100))
    assert {(r["rank"], r["slot"]) for r in wrapped} == {(i, j) for i in range(7) for j in range(15)}
    dropped = epoch_split(rows, 7, 0, 1, drop_last=True).collect()
    assert len(dropped) == 98 and len({r.doc_id for r in dropped}) == 98
    assert [r.doc_id for r in epoch_split(rows, 7, 1, 1).collect()] != [r.doc_id for r in wrapped]
    tiny = epoch_split(rows.where("doc_id < 2"), 7, 0, 1).collect()
    assert len(tiny) == 7 and {r.doc_id for r in tiny} == {0, 1}


@pytest.mark.parametrize("total", [1, 2, 3, 7, 10, 97, 1_000])
def test_shuffled_place_is_a_bijection_of_the_numbers(spark, total):
    rows = spark.range(total).withColumnRenamed("id", "idx").repartition(3)
    got = {e: {r.idx: r.place for r in shuffled_place(rows, total, 5, e).collect()} for e in (0, 1)}
    for epoch, places in got.items():
        assert sorted(places.values()) == list(range(total))
        side = epochs.grid(total)
        for index, place in places.items():
            walked = epochs._step(index, *side, 5, epoch)
            while walked >= total:
                walked = epochs._step(walked, *side, 5, epoch)
            assert walked == place
    assert total < 10 or got[0] != got[1]


def test_unused_places_are_always_left(spark):
    assert max(epochs.longest_walk(n, s, 0) for n in range(200) for s in range(3)) > 1
    for total in range(1, 60):
        rows, columns = epochs.grid(total)
        assert 0 <= rows * columns - total < rows


def test_places_are_spread_evenly(spark):
    """Every tenth of the numbers meets every tenth of the places about equally often."""
    rows = shuffled_place(spark.range(20_000).withColumnRenamed("id", "idx"), 20_000, 1, 2)
    cells = rows.groupBy(F.expr("idx DIV 2000").alias("i"), F.expr("place DIV 2000").alias("p")).count().collect()
    assert len(cells) == 100 and all(abs(r["count"] - 200) < 75 for r in cells)
    neighbours = rows.select((F.lead("place").over(Window.orderBy("idx")) - F.col("place")).alias("d")).groupBy("d").count()
    assert neighbours.agg(F.max("count")).first()[0] < 20


def test_epoch_places(skewed):
    numbered = number_rows(skewed.select("doc_id").where("doc_id < 100"))
    wrapped = epoch_places(numbered, 100, 7, 0, 1).collect()
    assert len(wrapped) == 105 and {r.doc_id for r in wrapped} == set(range(100))
    assert {(r["rank"], r["slot"]) for r in wrapped} == {(i, j) for i in range(7) for j in range(15)}
    for place in range(3):  # filters are pushed below the rounds, and stay small
        assert epoch_places(numbered, 100, 7, place, 1).where(f"rank = {place} AND slot < 5").count() == 5
    dropped = epoch_places(numbered, 100, 7, 0, 1, drop_last=True).collect()
    assert len(dropped) == 98 and len({r.doc_id for r in dropped}) == 98
    assert "Exchange" not in epoch_places(numbered, 100, 7, 1, 1)._jdf.queryExecution().executedPlan().toString()
    tiny = epoch_places(number_rows(skewed.select("doc_id").where("doc_id < 2")), 2, 7, 0, 1).collect()
    assert len(tiny) == 7 and {r.doc_id for r in tiny} == {0, 1}
    assert epoch_places(numbered.limit(0), 0, 7, 0, 1).collect() == []


def test_mix_ratio(skewed):
    a, b = skewed.select("doc_id").where("doc_id < 850"), skewed.select("doc_id").where("doc_id >= 850")
    parts = [r.part for r in mix_by_ratio(a, b, 0.15, 3).collect()]
    assert parts.count("a") == 850 and parts.count("b") == 150


def test_take_first(skewed):
    assert sorted(r.doc_id for r in take_first(skewed, 7, hot_rows=200).collect()) == list(range(7))


def test_first_rows_move_no_others(spark, docs):
    """The plan of a small head has no shuffle: every task hands in its own first rows."""
    plan = take_first(docs.select("doc_id", "text"), 20)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan
    small = {r.doc_id for r in take_first(docs, 20).collect()}
    large = {r.doc_id for r in with_rank(docs, ["doc_id"], (), "r", limit=20).collect()}
    assert small == large and len(small) == 20
