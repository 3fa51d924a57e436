"""The index of documents against late interaction over all pairs."""

import numpy as np
import pandas as pd
import pytest

from corpuslake.operators.cells import unit_matrix
from corpuslake.operators.late import LateScorer, build_late, search_late
from corpuslake.operators.retrieval import maxsim

SCHEMA = "{} long, token_id long, vector array<double>"


def rows_of(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect())


@pytest.fixture(scope="module")
def tokens(spark):
    """Documents around a few topics, one of very many tokens, two equal ones."""
    rng = np.random.default_rng(2)
    topics = rng.normal(size=(6, 12)) * 4
    rows = [(d, len_at, (topics[d % 6] + rng.normal(size=12)).tolist()) for d in range(80) for len_at in range(1 + d % 9)]
    rows += [(500, i, rng.normal(size=12).tolist()) for i in range(300)]
    rows += [(d, i, (topics[2] + i).tolist()) for d in (600, 601) for i in range(3)]
    rows += [(700, 0, [0.0] * 12), (701, 0, None)]
    asked = [(q, i, (topics[q % 6] + rng.normal(size=12)).tolist()) for q in range(9) for i in range(1 + q % 4)] + [(8, 99, None)]
    return spark.createDataFrame(asked, SCHEMA.format("query_id")), spark.createDataFrame(rows, SCHEMA.format("doc_id")).repartition(5)


@pytest.mark.parametrize("build,run,k", [({}, {}, 5), ({"cells": 12, "hot_tokens": 50}, {"block": 2, "shard": 20}, 3), ({"cells": 1}, {}, 200)])
def test_same_as_all_pairs(tokens, build, run, k):
    asked, docs = tokens
    expected = maxsim(asked.where("vector IS NOT NULL"), docs.where("vector IS NOT NULL"), k=k)
    got = search_late(asked, build_late(docs, **build), k, **run)
    assert rows_of(got) == rows_of(expected)


def test_hot_documents_stay_in_pieces(tokens):
    index = build_late(tokens[1], hot_tokens=50)
    assert {r.doc_id for r in index.hot.select("doc_id").distinct().collect()} == {500}
    assert index.documents.where("item_id = 500").count() == 0


def test_bounds_rule_out_most_pairs(tokens):
    asked, docs = tokens
    index = build_late(docs, cells=40, hot_tokens=50)
    table = index.documents.orderBy("item_id").toPandas()
    heads = asked.where("vector IS NOT NULL").toPandas().groupby("query_id")["vector"].agg(list)
    scorer = LateScorer(heads, index.centroids, index.radius, 2)
    for r in table.itertuples():
        scorer.add(np.array([r.item_id]), [r.cells], [r.vectors])
        for q, vectors in enumerate(heads):  # every bound holds
            score = (unit_matrix(pd.Series(vectors)) @ np.array(list(r.vectors)).T).max(axis=1).sum()
            mine = scorer.reach[scorer.owner == q][:, np.unique(r.cells)].max(axis=1).sum()
            assert mine >= score - 1e-9
    assert scorer.scored < 0.6 * len(table) * len(heads)


def test_empty_tables(tokens):
    asked, docs = tokens
    assert search_late(asked, build_late(docs.limit(0)), 3).count() == 0
    assert search_late(asked.limit(0), build_late(docs), 3).count() == 0


def test_documents_are_copied_per_group_of_blocks(tokens):
    asked, docs = tokens
    docs = docs.where("vector IS NOT NULL")
    expected = maxsim(asked.where("vector IS NOT NULL"), docs, k=3)
    assert rows_of(search_late(asked, build_late(docs, hot_tokens=50), 3, block=1, shard=10, wide=4)) == rows_of(expected)
