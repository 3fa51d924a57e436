"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from corpuslake.catalog import ORACLES, QUERIES  # noqa: E402

WITHOUT_SQL = {"encode_trained_bpe", "train_bpe_full", "dense_topk_probes"}


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf).toArrow()
    assert check.compare(ours, duck.sql(ORACLES[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).toArrow().num_rows > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["source", "chunks", "documents", "chars", "first_position", "last_position"] and frame.count() > 0
