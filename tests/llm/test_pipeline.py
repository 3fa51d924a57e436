"""The pipeline stage by stage, each against what its operator must do to its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from samples import ODD
from test_near import brute as near_brute
from test_suffixes import brute as suffix_brute

import __spark_entry__ as entry
from corpuslake.llm.catalog import ORACLES, QUERIES

import check  # noqa: E402  isort: skip


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(frame):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.collect()]


def test_stages(spark, sf, staged):
    documents = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    known, single, cleaned, mixed = (rows(f) for f in staged[:4])
    assert all(f.columns == corpus_pipeline.COLUMNS for f in staged[:4])
    lang = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op5_hierarchical_langid"](spark, sf).collect()}
    assert Counter(known) == Counter((d, t, lang[d], s) for d, t, _, s in documents if any(c.isalpha() for c in t))
    classes = {c for _, c, _ in near_brute(known)}
    assert sorted(r[0] for r in single) == sorted(classes)
    wanted = {r[0]: x for r, x in zip(single, suffix_brute([r[1] for r in single]))}
    assert sorted(r[0] for r in cleaned) == sorted(wanted)
    assert all(abs(len(r[1].encode()) - (wanted[r[0]][0] - wanted[r[0]][1])) <= 3 * wanted[r[0]][2] for r in cleaned)
    assert set(mixed) <= set(cleaned) and max(Counter(mixed).values()) <= 3
    assert staged[4].where("start = 0").count() == len(mixed) == staged[4].select("document").distinct().count()


def test_run_gives_the_rows_of_the_last_stage(spark, sf, staged):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    again = corpus_pipeline.run(spark, sf)
    assert again.agg({"length": "sum"}).first() == staged[4].agg({"length": "sum"}).first()
    assert again.columns[:5] == columns


def test_stages_take_odd_and_empty_tables(spark, sf, make, tmp_path_factory):
    for case in (make(ODD), make(ODD).limit(0)):
        docs = case
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path_factory.mktemp("odd") / name)
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {n for n in names if n.startswith("op")} == set(QUERIES) and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "mixture", "packing"]
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    ours = QUERIES[name](spark, sf).toArrow()
    assert check.compare(ours, check.connect(sf).sql(ORACLES[name]).to_arrow_table()) == []
