"""Pairs, contrastive metrics, ranking metrics and search against plain Python and numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslake.catalog.evaluation import PROBES
from corpuslake.functions.vectors import cosine, l2_normalize, logsumexp, softmax
from corpuslake.operators import cells, retrieval
from corpuslake.operators.cells import build_cells, search_cells
from corpuslake.operators.contrastive import HashedBagOfWords, encode_table, expert_load, info_nce, load_balance_loss, router_z
from corpuslake.operators.pairs import (
    check_pairs, explode_negatives, first_selected_passage, judged_to_triples, qa_pairs, union_pairs)
from corpuslake.operators.ranking import cap_queries, grade_labels, macro_average, mrr_by_query, ndcg_by_query, recall_at_k
from corpuslake.operators.retrieval import (
    adaptive_k, bm25, dense_topk, hybrid_search, matryoshka_search, maxsim, mine_hard_negatives, rerank, rrf, tag_prefilter,
    term_overlap, threshold_scores)
from corpuslake.plans.evaluation import evaluate_judgments

JUDGED = "pos long, query string, product_title string, esci_label string"


def test_triples(spark):
    rows = [(0, "q", "p0", "Exact"), (1, "q", "", "Exact"), (2, "q", "p2", "E"), (3, "", "p3", "E"), (4, "r", "p4", "S"), (5, "q", "p5", "Complement")]
    rows += [(10 + i, "q", f"s{i}", "substitute") for i in range(9)]
    frame = spark.createDataFrame(rows, JUDGED).repartition(5)
    for kw in ({}, {"hot_rows": 3}):
        got = judged_to_triples(frame, 7, **kw).orderBy("pos").collect()
        assert [(r.query, r.positive) for r in got] == [("q", "p0"), ("q", "p2")]
        assert all(r.hard_negatives == [f"s{i}" for i in range(7)] for r in got)
        assert {r.instruction for r in got} == {"Find the exact matching product"}
    other = spark.createDataFrame([(0, "q", "x", "exact")], "pos long, query string, product string, label string")
    assert judged_to_triples(other, 7).first().hard_negatives == []


def test_qa_and_passages(spark):
    qa = spark.createDataFrame([("What?", "Because."), ("", "x"), ("y", None)], "question string, context string")
    assert [(r.query, r.positive) for r in qa_pairs(qa).collect()] == [("What?", "Because.")]
    rows = spark.createDataFrame(
        [("a", (["x", "y", "z"], [0, 1, 1])), ("b", (["x"], [0])), (None, (["w"], [1]))],
        "query string, passages struct<passage_text:array<string>,is_selected:array<int>>")
    assert sorted((r.query, r.positive) for r in first_selected_passage(rows).collect()) == [("", "w"), ("a", "y")]


def test_union_and_checks(spark):
    a = spark.createDataFrame([(1, "q", "p", ["n1", "n2"], "i")], "pair_id int, query string, positive string, hard_negatives array<string>, instruction string")
    b = spark.createDataFrame([(2, "q2", "p2", "i")], "pair_id int, query string, positive string, instruction string")
    both = union_pairs(a, b, seed=1)
    assert sorted(len(r.hard_negatives) for r in both.collect()) == [0, 2]
    assert [(r.neg_no, r.negative) for r in explode_negatives(both).orderBy("neg_no").collect()] == [(0, "n1"), (1, "n2")]
    assert check_pairs(both) is both
    with pytest.raises(ValueError):
        check_pairs(b.withColumn("positive", F.lit(None).cast("string")))


def reference_info_nce(q, p, negs, tau, weight):
    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)
    q, p = unit(q), unit(p)
    logits = q @ p.T / tau
    if negs is not None:
        logits = np.concatenate([logits, np.einsum("qd,qnd->qn", q, unit(negs)) / tau * weight], axis=1)
    top = logits.max(1, keepdims=True)
    own = np.arange(len(q))
    loss = (top[:, 0] + np.log(np.exp(logits - top).sum(1)) - logits[own, own]).mean()
    return loss, (np.round(logits, 9).argmax(1) == own).mean(), (q * p).sum(1).mean()


@pytest.mark.parametrize("tile_rows", [1000, 7])
@pytest.mark.parametrize("with_negs", [False, True])
def test_info_nce(spark, tile_rows, with_negs):
    rng = np.random.default_rng(0)
    rows, expected = [], {}
    for batch, n in enumerate([1, 8, 25]):
        q, p, negs = rng.normal(size=(n, 6)), rng.normal(size=(n, 6)), rng.normal(size=(n, 3, 6))
        p[n // 2:] = q[n // 2:]
        if n > 8:
            p[5] = p[3]  # a tie: the first of two equal positives wins
        expected[batch] = reference_info_nce(q, p, negs if with_negs else None, 0.05, 1.5)
        rows += [(batch, i, q[i].tolist(), p[i].tolist(), negs[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(rows, "batch_id long, pair_id long, qv array<double>, pv array<double>, negs array<array<double>>")
    frame = frame if with_negs else frame.drop("negs")
    for r in info_nce(frame, 0.05, 1.5, tile_rows).collect():
        assert np.allclose([r.loss, r.accuracy, r.mean_positive_sim], expected[r.batch_id], atol=1e-9), r


def test_identical_pairs_are_all_right(spark):
    vectors = np.eye(4).tolist()
    frame = spark.createDataFrame([(0, i, v, v) for i, v in enumerate(vectors)], "batch_id long, pair_id long, qv array<double>, pv array<double>")
    assert info_nce(frame).first().accuracy == 1.0


def test_router_statistics(spark):
    flat = spark.createDataFrame([([0.0] * 8,)] * 5, "logits array<double>")
    assert abs(load_balance_loss(flat, 2).first().aux_loss - 0.02) < 1e-12
    assert sum(r.load for r in expert_load(flat, 2).collect()) == 2
    skewed = spark.createDataFrame([([9.0] + [0.0] * 7,)] * 5, "logits array<double>")
    assert load_balance_loss(skewed, 2).first().aux_loss > 0.02
    assert abs(router_z(flat).first().z_loss - math.log(8) ** 2 * 1e-3) < 1e-12


def test_vector_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        l2_normalize("a").alias("u"), l2_normalize("z").alias("z"), cosine("a", "z").alias("c"), softmax("a").alias("s"), logsumexp("a").alias("l")).first()
    assert np.allclose(row.u, [0.6, 0.8]) and row.z == [0.0, 0.0] and row.c == 0.0
    assert np.allclose(row.s, np.exp([3, 4]) / np.exp([3, 4]).sum()) and abs(row.l - math.log(math.e ** 3 + math.e ** 4)) < 1e-9


def test_grades(spark):
    rows = spark.createDataFrame([("Exact",), ("E",), ("s",), ("COMPLEMENT",), ("irrelevant",), ("?",), (None,)], "label string")
    assert [r.gain for r in grade_labels(rows).collect()] == [3, 0, 0, 1, 0, 0, 0]
    assert [r.gain for r in grade_labels(rows, accept_codes=True).collect()] == [3, 3, 2, 1, 0, 0, 0]


def model_ndcg(gains, scores, k=None):
    order = sorted(range(len(gains)), key=lambda i: -scores[i])
    discount = [1 / math.log2(r + 2) if k is None or r < k else 0 for r in range(len(gains))]
    dcg, at = 0.0, 0
    while at < len(order):
        tie = [i for i in order[at:] if scores[i] == scores[order[at]]]
        dcg += sum(gains[i] for i in tie) / len(tie) * sum(discount[at:at + len(tie)])
        at += len(tie)
    return dcg / sum(g * d for g, d in zip(sorted(gains, reverse=True), discount))


@pytest.fixture(scope="module")
def ranked(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q, n in enumerate([1, 2, 3, 40, 300]):
        rows += [(f"q{q}", q * 1000 + i, float(rng.integers(0, 12)) / 12, int(rng.integers(0, 4))) for i in range(n)]
    rows += [("none", 9001, 0.5, 0), ("none", 9002, 0.4, 0)]
    return spark.createDataFrame(rows, "query_id string, item_id long, score double, gain int").cache()


@pytest.mark.parametrize("kw", [{}, {"hot_rows": 25}])
def test_ranking_metrics(ranked, kw):
    table = {}
    for r in ranked.orderBy("item_id").collect():
        table.setdefault(r.query_id, []).append(r)
    for k in (None, 10):
        got = {r.query_id: r.ndcg for r in ndcg_by_query(ranked, k, **kw).collect()}
        want = {q: model_ndcg([r.gain for r in rs], [r.score for r in rs], k) for q, rs in table.items() if len(rs) > 1 and any(r.gain for r in rs)}
        assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-9 for q in want)
    first = {}
    for q, rs in table.items():
        order = sorted(rs, key=lambda r: (-r.score, r.item_id))
        hits = [i for i, r in enumerate(order, 1) if r.gain == 3]
        if len(rs) > 1:
            first[q] = 1 / hits[0] if hits else 0.0
    assert {r.query_id: r.rr for r in mrr_by_query(ranked, **kw).collect()} == first
    recall = {r.query_id: r.recall for r in recall_at_k(ranked, 5, **kw).collect()}
    for q, value in recall.items():
        order = sorted(table[q], key=lambda r: (-r.score, r.item_id))
        assert value == sum(r.gain > 0 for r in order[:5]) / sum(r.gain > 0 for r in order)


def test_cap_queries_and_macro_average(spark):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate("abacbdca")], "pos long, query_id string")
    assert sorted(r.pos for r in cap_queries(rows, 2).collect()) == [0, 1, 2, 4, 7]
    assert sorted(r.pos for r in cap_queries(rows, 3, reference_cut=True).collect()) == [0, 1, 2, 3]
    assert cap_queries(rows, 9, reference_cut=True).count() == 8
    scores = spark.createDataFrame([("a", 0.5), ("b", None)], "task string, score double")
    assert macro_average(scores).first().macro_average == 0.25


def test_evaluation_of_a_perfect_encoder(spark):
    rows = spark.createDataFrame([(0, "red shoe", "red shoe", "Exact"), (1, "red shoe", "blue hat", "irrelevant"), (2, "alone", "x", "Exact")], JUDGED)
    row = evaluate_judgments(rows).first()
    assert (row.ndcg, row.mrr, row.queries) == (1.0, 1.0, 1)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(2)
    items = rng.normal(size=(300, 8))
    items[100:200] = items[0]  # a third of the items are copies
    queries = np.concatenate([items[:5], rng.normal(size=(20, 8))])
    def frame(matrix, key):
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], f"{key} long, vector array<double>").repartition(6)
    return queries, items, frame(queries, "query_id"), frame(items, "item_id")


def brute(queries, items, k):
    scores = np.round(unit(queries) @ unit(items).T, 9)
    return {q: sorted(range(len(items)), key=lambda i: (-scores[q, i], i))[:k] for q in range(len(queries))}


def ranking(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.mark.parametrize("kw", [{}, {"block": 4, "shard": 70}])
def test_dense_search(space, kw):
    q, d, queries, items = space
    assert ranking(dense_topk(queries, items, 12, **kw)) == brute(q, d, 12)
    assert ranking(dense_topk(queries, items, 400, **kw)) == brute(q, d, 400)


@pytest.mark.parametrize("kw", [{}, {"cells": 1}, {"cells": 150, "sample": 60}])
def test_search_in_cells_is_exact(space, kw, monkeypatch):
    q, d, queries, items = space
    monkeypatch.setattr(cells, "ITEMS_PER_SHARD", 20)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 4)
    index = build_cells(items, **kw)
    assert index.items.count() == len(d) == index.cells.counts.sum()
    for k in (3, 12, 400):
        assert ranking(search_cells(queries, index, k)) == brute(q, d, k)


def test_search_in_cells_of_odd_tables(spark):
    fields = "query_id string, vector array<double>, item_id string"
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", None, "y"), ("c", [0.0, 0.0], "z"), ("d", [1.0, 0.0], "w")], fields)
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in search_cells(rows, build_cells(rows), 2).collect()}
    assert got[("a", 1)] == ("w", 1.0) and got[("a", 2)] == ("x", 1.0) and ("b", 1) not in got and got[("c", 1)][1] == 0.0
    assert search_cells(rows, build_cells(rows.limit(0)), 2).collect() == search_cells(rows.limit(0), build_cells(rows), 2).collect() == []


def test_recall_of_a_few_cells(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact, index = ranking(dense_topk(queries, items, 10)), build_cells(items)
    near = ranking(search_cells(queries, index, 10, probes=PROBES))
    recall = sum(len(set(exact[q]) & set(near[q])) for q in exact) / (10 * len(exact))
    print("recall", recall, "cells", len(index.cells.counts))
    assert set(near) == set(exact) and all(len(v) == 10 for v in near.values()) and recall >= 0.9


def test_matryoshka_with_all_candidates_is_exact(space):
    q, d, queries, items = space
    assert ranking(matryoshka_search(queries, items, d=3, top=300, k=7)) == brute(q, d, 7)


def test_hard_negatives_leave_the_positive_out(spark, space):
    q, d, queries, items = space
    known = spark.createDataFrame([(i, i) for i in range(5)], "query_id long, item_id long")
    got = {r.query_id: r.hard_negatives for r in mine_hard_negatives(queries, items, known, 6).collect()}
    want = {i: [x for x in found if not (i < 5 and x == i)] for i, found in brute(q, d, 6).items()}
    assert got == want


@pytest.mark.parametrize("kw", [{}, {"block": 3, "shard": 50}])
def test_maxsim(spark, space, kw):
    q, d, _, _ = space
    tokens = spark.createDataFrame([(i // 3, i, v.tolist()) for i, v in enumerate(q)], "query_id long, token_id long, vector array<double>")
    docs = spark.createDataFrame([(0 if i < 120 else i % 9, i, v.tolist()) for i, v in enumerate(d)], "doc_id long, token_id long, vector array<double>").repartition(5)
    sims = unit(q) @ unit(d).T
    owner = np.array([0 if i < 120 else i % 9 for i in range(len(d))])
    for r in maxsim(tokens, docs, **kw).collect():
        rows = [i for i in range(len(q)) if i // 3 == r.query_id]
        assert abs(r.score - sum(sims[i, owner == r.doc_id].max() for i in rows)) < 1e-9


TEXTS = ["red apple pie", "apple apple tart", "green pear", "pie chart of red things", "nothing here", "apple"]


def model_bm25(queries, texts, k1=1.2, b=0.75):
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    out = {}
    for q, text in enumerate(queries):
        scores = {}
        for i, words in enumerate(docs):
            s = 0.0
            for t in set(text.split()):
                tf, df = words.count(t), sum(t in w for w in docs)
                if tf:
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / avg))
            if s > 0:
                scores[i] = s
        if scores:
            out[q] = sorted(scores, key=lambda i: (-round(scores[i], 9), i))
    return out


@pytest.mark.parametrize("kw", [{}, {"block": 1, "shard": 2}])
def test_bm25_and_fusion(spark, kw):
    asked = ["apple pie", "red red", "zebra", "pear tart"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    corpus = spark.createDataFrame([(i, t, ["even"] if i % 2 == 0 else ["odd"]) for i, t in enumerate(TEXTS)], "item_id long, text string, tags array<string>")
    found = bm25(queries, corpus, 10, **kw)
    assert ranking(found) == model_bm25(asked, TEXTS)
    filtered = ranking(bm25(queries, tag_prefilter(corpus, ["even", "absent"]), 10))
    assert filtered and all(i % 2 == 0 for hits in filtered.values() for i in hits)
    other = spark.createDataFrame([(0, 1, 1), (0, 5, 2)], "query_id long, item_id long, rank long")
    fused = {(r.query_id, r.item_id): r.score for r in rrf(found, other).collect()}
    places = model_bm25(asked, TEXTS)[0]
    assert abs(fused[(0, 1)] - (1 / 61 + 1 / (60 + places.index(1) + 1))) < 1e-12


def test_hybrid(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(len(TEXTS))], "item_id long, vector array<double>")
    corpus = spark.createDataFrame([(i, t, ["even"] if i % 2 == 0 else ["odd"]) for i, t in enumerate(TEXTS)], "item_id long, text string, tags array<string>")
    queries = vectors.where("item_id < 2").select(F.col("item_id").alias("query_id"), F.lit("apple pie").alias("text"), "vector")
    both = hybrid_search(queries, corpus, vectors, k=4, depth=50).collect()
    assert {r["rank"] for r in both} == {1, 2, 3, 4}
    tagged = hybrid_search(queries, corpus, vectors, k=6, depth=50, tags=["odd"], cut=True).collect()
    assert tagged and all(r.item_id % 2 == 1 for r in tagged)


def test_adaptive_cut_threshold_and_rerank(spark):
    scores = {"a": [9.0, 8.5, 3.0, 2.9], "b": [5.0], "c": [4.0, 3.0, 2.0], "d": [1.0, 1.0]}
    rows = spark.createDataFrame([(q, i, s) for q, ss in scores.items() for i, s in enumerate(ss)], "query_id string, item_id long, score double")
    kept = ranking(adaptive_k(rows))
    assert kept == {"a": [0, 1], "b": [0], "c": [0], "d": [0]}
    out = threshold_scores(rows, 0.97)
    assert {(r.query_id, r.status) for r in out.collect()} == {("a", "kept"), ("b", "kept"), ("c", "kept"), ("d", "none")}
    wider = threshold_scores(rows, 0.97, fallback=rows)
    assert {(r.query_id, r.item_id) for r in wider.where("status = 'fallback'").collect()} == {("d", 0), ("d", 1)}
    exact = spark.createDataFrame([("a", 1, 0.0)], "query_id string, item_id long, score double")
    assert [r.status for r in threshold_scores(exact, 0.5).collect()] == ["none"]  # strictly above
    texts = rows.withColumn("query", F.lit("red apple")).withColumn("body", F.when(F.col("item_id") == 2, "an APPLE, red").otherwise("apple"))
    again = rerank(texts.where("query_id = 'a'"), term_overlap("query", "body"), depth=3)
    assert ranking(again) == {"a": [2, 0, 1]}


def test_encoder_table(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "text string").coalesce(1)
    got = [r.embedding for r in encode_table(rows, lambda: HashedBagOfWords(16), batch=2).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-12 and got[1] == got[2] == [0.0] * 16


def test_a_query_travels_once_per_shard_not_per_cell(space):
    queries, items = space[2:]
    index = build_cells(items, cells=60)
    assert sum(index.cells.shards()).max() == 1  # few items, so all cells share a shard
    found = search_cells(queries, index, 3, probes=40)
    plan = found._jdf.queryExecution().analyzed().toString()
    visited = [line for line in plan.splitlines() if "visits#" in line and "Relation" in line]
    assert visited  # rows of (query, shards with their cells), not of (query, cell)


def test_best_of_parts_equals_best_of_all():
    rng = np.random.default_rng(3)
    scores, ids = rng.normal(size=(7, 900)).round(1), np.arange(900)[::-1].copy()  # many ties
    whole, parts = cells.BestK(7, 5), cells.BestK(7, 5, lambda q, j: scores[q, j + at])
    whole.add(scores, ids)
    for at in range(0, 900, 45):
        parts.add(scores[:, at:at + 45], ids[at:at + 45])
    assert whole.items.tolist() == parts.items.tolist() and (parts.extras == parts.scores).all()
    for q in range(7):
        assert whole.items[whole.q == q].tolist() == [i for _, i in sorted(zip(-scores[q], ids))][:5]


def test_late_interaction_holds_few_similarities_at_a_time(spark, monkeypatch):
    from corpuslake.operators import retrieval

    rng = np.random.default_rng(4)
    rows = [(i % 7, i, rng.normal(size=4).tolist()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, token_id long, vector array<double>")
    heads = docs.withColumnRenamed("doc_id", "query_id")
    expected = {(r.query_id, r.doc_id): r.score for r in maxsim(heads, docs).collect()}
    made, multiplied = [], []
    matrix = retrieval._matrix
    monkeypatch.setattr(retrieval, "CELLS", 4_000)
    monkeypatch.setattr(retrieval, "_matrix", lambda vectors: multiplied.append(len(vectors)) or matrix(vectors))
    monkeypatch.setattr(retrieval, "meet", lambda h, items, kernel, schema, *a: (made.append((h, items, kernel)) or spark.createDataFrame([], schema), 1))
    maxsim(heads, docs)
    h, items, kernel = made[0]
    got = pd.concat(list(kernel(h.toPandas(), iter([items.toPandas()]))))
    got = got.groupby(["query_id", "doc_id", "token_id"])["best"].max().groupby(["query_id", "doc_id"]).sum().to_dict()
    assert multiplied[0] == 400 and max(multiplied[1:]) <= 10
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in got)


def test_matryoshka_scores_candidates_where_it_finds_them(space, spark):
    q, d, queries, items = space
    found = matryoshka_search(queries, items, d=3, top=20, k=5)
    assert " Join " not in found._jdf.queryExecution().analyzed().toString()
    tiled = matryoshka_search(queries, items, d=3, top=20, k=5, block=2, shard=70)
    assert ranking(tiled) == ranking(found)


def by_prefix(queries, items, d, top, k, names):
    """The definition of `matryoshka_search`, one query after the other."""
    coarse, fine = (np.round(unit(queries[:, :n]) @ unit(items[:, :n]).T, 9) for n in (d, queries.shape[1]))
    out = {}
    for q in range(len(queries)):
        near = sorted(range(len(items)), key=lambda i: (-coarse[q, i], names[i]))[:top]
        best = sorted(near, key=lambda i: (-fine[q, i], names[i]))[:k]
        out[q] = [(names[i], n, fine[q, i]) for n, i in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("kw", [{}, {"block": 8}, {"block": 8, "wide": 2}, {"block": 4, "shard": 100}])
def test_matryoshka_in_tiles(spark, kw, kind):
    rng = np.random.default_rng(4)
    items = rng.normal(size=(700, 12)).astype(np.float32)
    items[50:350:2, :4] = items[7, :4]  # many equal beginnings, and many equal vectors
    items[400:500] = items[9]
    items[500:600, :4] = items[11, :4] + rng.normal(size=(100, 4)).astype(np.float32) * 1e-7  # single precision cannot tell these apart
    queries = np.concatenate([items[[7, 9, 11, 60]], rng.normal(size=(60, 12)).astype(np.float32)])
    names = [f"{i * 37 % 701:03d}" if kind == "string" else i * 37 % 701 for i in range(700)]
    heads = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<float>").repartition(3)
    corpus = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, items)], f"item_id {kind}, vector array<float>").repartition(5)
    found = {}
    for r in matryoshka_search(heads, corpus, 4, 20, 6, **kw).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.item_id, r["rank"], r.score))
    assert found == by_prefix(queries.astype(float), items.astype(float), 4, 20, 6, names)


def test_matryoshka_kernel_in_small_steps(monkeypatch):
    rng = np.random.default_rng(5)
    queries, items = rng.normal(size=(50, 10)), rng.normal(size=(900, 10))
    items[300:700] = items[299]
    expected = by_prefix(queries, items, 3, 12, 12, range(900))
    for name, value in {"TILE_QUERIES": 8, "TILE_ITEMS": 24, "SEED_ITEMS": 30, "TILE_STEP": 5}.items():
        monkeypatch.setattr(retrieval, name, value)
    items = np.concatenate([items, np.full((4, 10), np.nan)])
    for step in (1, 5, 100, 2_000):
        best = retrieval.PrefixBest(np.concatenate([queries, np.full((1, 10), np.nan)]), 3, 12)
        for at in range(0, len(items), step):
            best.add(items[at:at + step], np.arange(at, min(len(items), at + step)))
        q, ids, _, fines = best.rows()
        assert {i: {(n, f) for n, f in zip(ids[q == i], fines[q == i])} for i in range(50)} == {i: {(n, f) for n, _, f in r} for i, r in expected.items()}
        assert q.max() == 49  # nothing is near a vector that is not a number


def test_matryoshka_hands_on_ranked_rows(spark, space):
    q, d, queries, items = space
    plan = matryoshka_search(queries, items, d=3, top=20, k=5, block=4)._jdf.queryExecution().analyzed().toString()
    assert plan.index("MapInArrow") < plan.index("Window")  # candidates are not ranked by a shuffle after the tasks
    assert plan.count("Window") == 1


def test_matryoshka_of_odd_tables(spark):
    fields = "query_id string, vector array<double>, item_id string"
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 0.0], None), ("a", [0.0, 1.0], "w"), (None, [1.0, 0.0], "v")], fields)
    for kw in ({}, {"block": 1}, {"block": 1, "shard": 2}):
        got = matryoshka_search(rows, rows, d=1, top=3, k=2, **kw)
        assert got.columns == ["query_id", "item_id", "score", "rank"]
        table = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in got.collect()}
        assert table[("b", 1)] == (None, 0.0) and table[("b", 2)] == ("v", 0.0)
        assert table[(None, 1)] == ("v", 1.0) and table[(None, 2)] == ("x", 1.0)
        assert table[("a", 1)] == ("v", 1.0) and table[("a", 2)] == ("x", 1.0) and len(table) == 6
        for none in (matryoshka_search(rows.limit(0), rows, 1, 3, 2, **kw), matryoshka_search(rows, rows.limit(0), 1, 3, 2, **kw)):
            assert none.collect() == []
