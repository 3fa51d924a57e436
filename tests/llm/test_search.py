"""Exact top-k search against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from corpuslake.llm.kdsearch import build_tree, exact_topk

FIELDS = "vec_id long, embedding array<double>, shard string, score string"


def brute(rows, k, asks):
    whole = {}
    usable = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(64 * x) for x in v]))
    out = set()
    for i, v in usable:
        if i is not None and asks(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w in usable if j != i)
            for rank, (s, none, j) in enumerate(scored[:k]):
                out.add((i, rank + 1, None if none else j, -s))
    return out


def test_many_shards_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist(), "a", "b") for i in range(400)]
    rows += [(1_000 + i, [0.5] * 6, "a", "b") for i in range(60)]  # one vector many times
    rows += [(2_000, None, "", ""), (2_020, [None] * 6, "", ""), (2_040, [float("nan")] * 6, "", ""), (2_060, [float("inf")] + [0.0] * 5, "", ""),
             (None, [2.0] * 6, "", ""), (2_080, [1.0, 2.0], "", ""), (2_100, [], "", ""), (2_120, [0.1] * 9, "", "")]
    got = exact_topk(spark.createDataFrame(rows, FIELDS), F.col("vec_id") % 20 == 0, k=7, shard_rows=50, block_queries=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 7, lambda i: i % 20 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(1 << 22) + i, float(i % 7), -float(1 << 22)], "", "") for i in range(50)]
    got = exact_topk(spark.createDataFrame(rows, FIELDS), F.col("vec_id") % 10 == 0, k=4, shard_rows=20)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, lambda i: i % 10 == 0)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(0, [1.0], "", ""), (0, [1.0], "", ""), (1, [2.0], "", ""), (1, [2.0], "", "")]
    got = exact_topk(spark.createDataFrame(rows, FIELDS), F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128)]
    none = spark.createDataFrame([], FIELDS)
    assert exact_topk(none, F.col("vec_id") == 0).collect() == []
    assert exact_topk(spark.createDataFrame(rows, FIELDS), F.col("vec_id") == 9).collect() == []


def test_boxes_are_tight_and_leaves_cover_all_points():
    points = np.random.default_rng(2).integers(-50, 50, (3_000, 5))
    nodes, boxes, order = build_tree(points)
    leaves = []
    for (left, right, first, stop), (low, high) in zip(nodes, boxes):
        here = points[order[first:stop]]
        assert (here.min(axis=0) == low).all() and (here.max(axis=0) == high).all()
        if left < 0:
            leaves += range(first, stop)
        else:
            assert abs((nodes[left][3] - nodes[left][2]) - (nodes[right][3] - nodes[right][2])) <= 1
    assert sorted(leaves) == list(range(3_000)) and sorted(order) == list(range(3_000))


def test_blocks_do_not_pass_through_the_driver(spark):
    rows = [(i, [float(i % 5), float(i % 3)], "", "") for i in range(200)]
    got = exact_topk(spark.createDataFrame(rows, FIELDS), F.col("vec_id") % 20 == 0, k=3, shard_rows=20, block_queries=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
