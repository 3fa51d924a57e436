"""Readers, writers and streaming runs."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslake.operators.fields import format_instruction
from corpuslake.session import shared_dir
from corpuslake.sources.arrays import read_json_records, write_json_array
from corpuslake.sources.readers import (
    read_first_available, read_instruction_json, read_parquet_text, scan_cache_dir, scan_page_dump)
from corpuslake.sources.writers import (
    extract_entities, materialize_once, read_text_shards, stored_rows, write_corpus, write_text_shards)
from corpuslake.streaming.clean import _carried, _leave, clean_text, drop_reason, page_reason, read_counts, read_stream, stream_cap, stream_clean, stream_counts


def lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_first_available(spark, tmp_path):
    lines(spark, ["a"]).write.parquet(f"{tmp_path}/second")
    options = [(f"{tmp_path}/first", "parquet"), (f"{tmp_path}/second", "parquet")]
    assert read_first_available(spark, options).count() == 1
    empty = read_first_available(spark, options[:1])
    assert empty.columns == ["text"] and empty.count() == 0


def test_text_scan_prunes_columns_and_pushes_filters(spark, sf):
    rows = read_parquet_text(spark, f"{sf}/documents.parquet")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "IsNotNull(text)" in plan
    limited = read_parquet_text(spark, f"{sf}/documents.parquet", ["text", "doc_id"], 5, "doc_id")
    assert [r.doc_id for r in limited.orderBy("doc_id").collect()] == list(range(5))
    with pytest.raises(ValueError):
        read_parquet_text(spark, f"{sf}/documents.parquet", limit=5)


def test_instruction_files(spark, tmp_path):
    records = [{"instruction": "Do", "output": "done", "input": "x"}, {"instruction": "Go", "output": "gone", "input": ""}]
    (tmp_path / "a.json").write_text(json.dumps(records))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    expected = {"<s>[INST] Do\n\nContext:\nx [/INST] done </s>", "<s>[INST] Go [/INST] gone </s>"}
    for name in ("a.json", "a.jsonl"):
        assert {r.text for r in format_instruction(read_instruction_json(spark, str(tmp_path / name))).collect()} == expected


ODD_RECORDS = [
    {"instruction": 'a } b " c \\ {', "output": "x\ny", "n": {"deep": [{"er": "}"}, {}]}}, {}, {"instruction": "", "output": "é\u2028}"},
    {"instruction": "{" * 50, "output": '"' * 40}, {"instruction": "\\" * 33 + '"', "output": None}, {"instruction": "long }" * 40, "output": "\\"}]


@pytest.mark.parametrize("size", [41, 1_000_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_array_is_cut_into_its_records_by_many_tasks(spark, tmp_path, size, indent):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        (tmp_path / "a.json").write_text(json.dumps(ODD_RECORDS, indent=indent, ensure_ascii=False))
        found = [json.loads(r.value) for r in read_json_records(spark, str(tmp_path / "a.json")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(json.dumps, found)) == sorted(map(json.dumps, ODD_RECORDS))


def test_array_gives_the_columns_of_spark_s_own_reader(spark, tmp_path):
    records = [r for r in ODD_RECORDS if r]
    (tmp_path / "a.json").write_text(json.dumps(records))
    own = spark.read.option("multiLine", True).option("primitivesAsString", True).json(f"{tmp_path}/a.json")
    ours = read_instruction_json(spark, f"{tmp_path}/a.json")
    assert ours.schema == own.schema and sorted(map(str, ours.collect())) == sorted(map(str, own.collect()))
    named = read_instruction_json(spark, f"{tmp_path}/a.json", ["output", "n", "absent"])
    assert sorted(map(str, named.collect())) == sorted(map(str, own.selectExpr("output", "to_json(n) AS n", "NULL AS absent").collect()))


@pytest.mark.parametrize("text", ["", "[]", " [ ]\n", "[1, \"}\", null]"])
def test_array_without_records(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert read_instruction_json(spark, f"{tmp_path}/a.json").count() == 0
    assert read_instruction_json(spark, f"{tmp_path}/a.json", ["x"]).count() == 0


def test_arrays_written_and_read(spark, tmp_path):
    rows = lines(spark, ["a", None, "}{", '"', "x\ny"]).repartition(3)
    write_json_array(rows, f"{tmp_path}/r.json")
    back = read_instruction_json(spark, f"{tmp_path}/r.json", ["doc_id", "text"])
    assert sorted((int(r.doc_id), r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in rows.collect())


def test_cache_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_cache_dir(spark, str(tmp_path))
    lines(spark, ["a", "b"]).write.parquet(f"{tmp_path}/generic.parquet")
    lines(spark, ["c"]).write.parquet(f"{tmp_path}/finance.parquet")
    got = sorted((r.source_rank, r.source, r.text) for r in scan_cache_dir(spark, str(tmp_path)).collect())
    assert got == [(0, "finance", "c"), (1, "generic", "a"), (1, "generic", "b")]


def test_page_dump_fills_missing_columns(spark, tmp_path):
    spark.createDataFrame([("T", "x")], "title string, text string").write.parquet(f"{tmp_path}/p")
    row = scan_page_dump(spark, f"{tmp_path}/p").first()
    assert row.title == "T" and row.url is None and row.categories is None


def test_corpus_is_one_snappy_column(spark, tmp_path):
    write_corpus(lines(spark, ["a", "b\nc"]), f"{tmp_path}/c")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert back.columns == ["text"] and sorted(r.text for r in back.collect()) == ["a", "b\nc"]
    assert all("snappy" in f for f in os.listdir(tmp_path / "c") if f.startswith("part"))


def test_materialise_once(spark, tmp_path):
    calls = []

    def make(n):
        def frame():
            calls.append(n)
            return lines(spark, ["x"] * n)
        return frame

    path = f"{tmp_path}/once"
    assert stored_rows(spark, path) is None
    assert materialize_once(spark, make(3), path) == 3
    assert materialize_once(spark, make(5), path) == 3 and calls == [3]
    assert materialize_once(spark, make(5), path, force=True) == 5


def test_text_shards_round_trip(spark, tmp_path):
    values = ["plain", "two\nlines", "r\r\nn", "back\\slash", "\\n not a break", "\\\\b", "", "tail\\"]
    write_text_shards(lines(spark, values).coalesce(1), f"{tmp_path}/s", shard_size=3)
    files = [f for f in os.listdir(tmp_path / "s") if f.startswith("part")]
    assert sorted(len((tmp_path / "s" / f).read_text().splitlines()) for f in files) == [2, 3, 3]
    assert sorted(r.text for r in read_text_shards(spark, f"{tmp_path}/s").collect()) == sorted(values)


def test_extract_entities(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Acme {i}", "Acme is a company. " + "x" * 1000) for i in range(5)], "doc_id long, title string, text string")
    assert extract_entities(rows, f"{tmp_path}/e", max_pages=3) == 3
    got = spark.read.parquet(f"{tmp_path}/e").orderBy("title").collect()
    assert [r.url for r in got] == [f"https://en.wikipedia.org/wiki/Acme_{i}" for i in range(3)]


@pytest.fixture()
def arriving(spark, docs, tmp_path):
    """The documents as five files in a folder."""
    path = f"{tmp_path}/in"
    docs.select("doc_id", "source", "text").repartition(5, "doc_id").write.parquet(path)
    return path


def test_stream_equals_batch_and_resumes(spark, docs, arriving, tmp_path):
    schema = "doc_id long, source string, text string"
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for _ in range(2):  # the second run finds nothing new
        stream_clean(read_stream(spark, arriving, schema, 1), out, state).awaitTermination()
    want = clean_text(docs.select("doc_id", "source", "text"))
    key = ["doc_id", "chunk_no", "text"]
    got = spark.read.parquet(out)
    assert got.count() == want.count() and got.select(*key).exceptAll(want.select(*key)).count() == 0
    spark.createDataFrame([(10_001, "new", "the " * 60)], schema).write.mode("append").parquet(arriving)
    stream_clean(read_stream(spark, arriving, schema, 1), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == want.count() + 1


def test_stream_counts(spark, docs, arriving, tmp_path):
    stream_counts(read_stream(spark, arriving, "doc_id long, source string, text string", 1), f"{tmp_path}/seen", f"{tmp_path}/state").awaitTermination()
    seen = read_counts(spark, f"{tmp_path}/seen")
    want = drop_reason(docs).groupBy("source", "reason").count()
    assert {tuple(r) for r in seen.collect()} == {tuple(r) for r in want.collect()}
    kept = clean_text(docs.select("doc_id", "source", "text")).select("doc_id").distinct().count()
    assert seen.where("reason = 'kept'").agg(F.sum("n")).first()[0] == kept


def test_counts_look_at_whole_texts(spark, tmp_path):
    from corpuslake.catalog import ORACLES, QUERIES

    words = "palabra " * 100  # the one English word stands behind 800 characters
    texts = [words + "the end", "the " + words, words, "word", None]
    rows = [(i, t, "es", f"src{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.reason, r.n) for r in QUERIES["stream_counts"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duck.sql(ORACLES["stream_counts"]).fetchall())
    reasons = {source: reason for source, reason, _ in got}
    assert reasons == {"src0": "kept", "src1": "kept", "src2": "not_english", "src3": "short", "src4": "kept"}


def test_page_reasons(spark):
    rows = spark.createDataFrame([("Acme", "Acme is a company." + "x" * 1000), ("1995", "x")], "title string, text string")
    assert [r.reason for r in page_reason(rows).collect()] == ["kept", "date_title"]


def test_stream_cap_is_exact_over_batches(spark, arriving, tmp_path):
    rows = read_stream(spark, arriving, "doc_id long, source string, text string", 1)
    for n in (1, 70, 10_000):
        out = f"{tmp_path}/cap{n}"
        stream_cap(rows, n, out, f"{tmp_path}/state{n}").awaitTermination()
        assert spark.read.parquet(out).select("doc_id").distinct().count() == min(n, 200)
        assert spark.read.parquet(out).count() == min(n, 200)
        stream_cap(rows, n, out, f"{tmp_path}/state{n}").awaitTermination()  # started again: nothing new
        assert spark.read.parquet(out).count() == min(n, 200)


def files_below(folder):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(folder) for name in names)


def test_counters_keep_as_many_files_however_many_batches_come(spark, tmp_path):
    schema, files = "doc_id long, source string, text string", []
    for i in range(6):
        spark.createDataFrame([(10 * i + j, "s", "x" * 5) for j in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = read_stream(spark, f"{tmp_path}/in", schema, 1)
        stream_counts(rows, f"{tmp_path}/seen", f"{tmp_path}/state").awaitTermination()
        stream_cap(rows, 7, f"{tmp_path}/cap", f"{tmp_path}/cap-state").awaitTermination()
        assert [r.n for r in read_counts(spark, f"{tmp_path}/seen").collect()] == [3 * (i + 1)]
        assert spark.read.parquet(f"{tmp_path}/cap").count() == min(3 * (i + 1), 7)
        files.append((files_below(f"{tmp_path}/seen"), files_below(f"{tmp_path}/cap-total")))
    assert files[1:] == [(2, 2)] * 5


def test_repeated_batch_counts_once(spark, tmp_path):
    def totals(batch_id, value):
        before, slot = _carried(spark, f"{tmp_path}/t", "total bigint", batch_id)
        stored = (0 if before is None else before.first()["total"]) + value
        _leave(spark.createDataFrame([(stored,)], "total bigint"), f"{tmp_path}/t", slot, batch_id)
        return stored

    assert [totals(b, 1) for b in (0, 0, 1, 1, 2, 2, 2, 3)] == [1, 1, 2, 2, 3, 3, 3, 4]
    assert read_counts(spark, f"{tmp_path}/absent").count() == 0


class FakeSession:
    """Stands for sessions of other clusters: a master, and the checkpoint folder if one is named."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default

    def getCheckpointDir(self):
        return None


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(FakeSession("yarn", "hdfs:///scratch"), "x").startswith("hdfs:///scratch/x-")
    with pytest.raises(ValueError):
        shared_dir(FakeSession("yarn"), "x")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second and os.path.dirname(first) == os.path.dirname(second)


def test_parts_arrive_one_after_the_other_in_many_files(spark, sf, tmp_path):
    from corpuslake.catalog import streams

    rows = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    seen, ids = 0, []
    for stream in streams.arriving(spark, str(tmp_path)):
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        stream.select("doc_id", F.input_file_name().alias("file")).writeStream.format("parquet") \
            .option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        now = spark.read.parquet(out).collect()
        new = [r for r in now if r["doc_id"] not in set(ids)]
        assert len({r["file"] for r in new}) > 1  # a part is not one file, so not one task
        assert not ids or min(r["doc_id"] for r in new) > max(ids)
        ids += [r["doc_id"] for r in new]
        seen = len(now)
    assert seen == len(ids) == rows.count()
