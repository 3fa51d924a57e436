"""The inverted index against keyword search over all texts."""

import numpy as np
import pytest

from corpuslake.operators import postings
from corpuslake.operators.postings import build_postings, first_ranges, open_ranges, range_bounds, search_postings
from corpuslake.operators.retrieval import bm25


def rows_of(found):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 6)) for r in found.collect())


@pytest.fixture(scope="module")
def texts():
    """Words by Zipf's law; some documents repeat one word many times, so bounds differ between ranges."""
    rng = np.random.default_rng(5)
    made = [" ".join(f"w{w}" for w in rng.zipf(1.4, size=rng.integers(1, 60)) if w < 3_000) for _ in range(600)]
    made += ["w1 " * 500, "w7 " * 40 + "w9", "", "w1", "w1", "w2 w3 w5 w8 rare", None]
    return made


@pytest.fixture(scope="module")
def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(6)


@pytest.fixture(scope="module")
def queries(spark, texts):
    asked = ["w2 w3 rare", "w1", "w1 w1 w40 w41", "", None, "absent", texts[10], texts[601]]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")


@pytest.mark.parametrize("range_docs,first,k", [(16, 1, 3), (256, 8, 10), (100_000, 1, 7), (1, 4, 2)])
def test_same_as_full_search(corpus, queries, range_docs, first, k):
    index = build_postings(corpus, range_docs=range_docs)
    assert rows_of(search_postings(queries, index, k, first)) == rows_of(bm25(queries, corpus, k))


def test_other_parameters(corpus, queries):
    index = build_postings(corpus, k1=0.4, b=0.2, range_docs=32)
    assert rows_of(search_postings(queries, index, 4)) == rows_of(bm25(queries, corpus, 4, k1=0.4, b=0.2))


def test_ranges_are_skipped_and_folders_pruned(spark, corpus):
    index = build_postings(corpus, range_docs=16)
    one = spark.createDataFrame([(0, "w2 w3 rare")], "query_id long, text string")
    asked, blocks, bounds = range_bounds(one, index)
    done = first_ranges(bounds, 1)
    found = search_postings(one, index, 1)
    assert open_ranges(bounds, done, found, 1).count() < bounds.count() / 4  # the rare word is in one range only
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    folders = {r["bucket"] for r in asked.collect()}
    assert {r["bucket"] for r in blocks.select("bucket").distinct().collect()} == folders and len(folders) <= 3


def test_empty_tables_and_text_keys(spark, corpus, queries):
    nothing = build_postings(corpus.limit(0))
    assert search_postings(queries, nothing, 3).count() == 0
    index = build_postings(corpus)
    assert search_postings(queries.limit(0), index, 3).count() == 0
    named = corpus.selectExpr("concat('d', item_id) AS item_id", "text")
    got = search_postings(queries, build_postings(named, range_docs=64), 3)
    assert rows_of(got) == rows_of(bm25(queries, named, 3))


def test_kinds_of_documents_share_no_range(spark, corpus, queries):
    kinds = corpus.selectExpr("item_id", "text", "CASE WHEN item_id % 3 > 0 THEN concat('k', item_id % 3) END AS kind")
    index = build_postings(kinds, range_docs=32, alike=kinds["kind"])
    assert rows_of(search_postings(queries, index, 6)) == rows_of(bm25(queries, corpus, 6))
    parts = index.blocks.selectExpr("part", "explode(items) AS item").selectExpr("part", "item % 3 AS kind").distinct()
    assert parts.groupBy("part").count().where("count > 1").count() == 0


def test_slices_of_frequent_terms(corpus, queries, monkeypatch):
    monkeypatch.setattr(postings, "FILE_POSTINGS", 10)
    index = build_postings(corpus, range_docs=8)
    assert rows_of(search_postings(queries, index, 6)) == rows_of(bm25(queries, corpus, 6))


def moved(frame, metric="shuffleBytesWritten"):
    """Rows of a query that ran, and the bytes (or rows) its shuffles wrote."""
    rows = frame.collect()

    def written(plan):
        found = plan.metrics().get(metric) if plan.nodeName() == "Exchange" else None
        inside = [plan.executedPlan()] if plan.nodeName().startswith("AdaptiveSparkPlan") else []
        inside += [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
        inside += [plan.children().apply(i) for i in range(plan.children().size())]
        return sum(map(written, inside), found.get().value() if found is not None and found.isDefined() else 0)

    return rows, written(frame._jdf.queryExecution().executedPlan())


def test_blocks_travel_once_for_all_queries(spark, corpus, texts, monkeypatch):
    index, sums, cut_lineage = build_postings(corpus, range_docs=64), [], postings.cut_lineage

    def watched(df, name, **options):
        if name == "first-found":
            sums[-1] += moved(df)[1]
        return cut_lineage(df, name, **options)

    monkeypatch.setattr(postings, "cut_lineage", watched)
    for n in (1, 64):
        asked = spark.createDataFrame([(q, texts[10]) for q in range(n)], "query_id long, text string")
        sums.append(0)
        rows, last = moved(search_postings(asked, index, 1))
        assert len(rows) == n
        sums[-1] += last
    assert 0 < sums[1] < 3 * sums[0]


def test_blocks_of_a_range_reach_a_folder_in_one_row(corpus, monkeypatch):
    sizes, sort = [], type(corpus).sortWithinPartitions

    def watched(df, *columns):
        rows, written = moved(df, "shuffleRecordsWritten")
        sizes.append((len(rows), written))
        return sort(df, *columns)

    monkeypatch.setattr(type(corpus), "sortWithinPartitions", watched)
    index = build_postings(corpus, range_docs=64)
    (n_blocks, n_rows), = sizes
    n_parts = index.blocks.select("part").distinct().count()
    assert n_blocks == index.blocks.count() and n_rows <= corpus.count() + n_parts * postings.BUCKETS < n_blocks


@pytest.mark.parametrize("k,cells", [(1, 1), (5, 700), (1_000, 2_000_000)])
def test_small_tiles_and_steps(corpus, queries, monkeypatch, k, cells):
    for name, value in (("TILE_RANGES", 2), ("TILE_QUERIES", 3), ("BLOCK_QUERIES", 2), ("CELLS", cells), ("UNPACKED", 3)):
        monkeypatch.setattr(postings, name, value)
    index = build_postings(corpus, range_docs=32)
    assert rows_of(search_postings(queries, index, k, 2)) == rows_of(bm25(queries, corpus, k))
