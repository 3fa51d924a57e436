"""JSON arrays read and written by many tasks.

Spark's own reader parses a multi-line file in one task, since a record may begin anywhere. Here the text reader cuts
the file at every closing brace, so its splits are read in parallel; whether a brace stands in a string, and how deep
it is, is found from what every split does to both possible states at its start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.operators.splits import BLOCK, with_block, with_states
from corpuslake.session import cut_lineage

STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
OPENING = re.compile(r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+\{', re.DOTALL)
SPLIT = ["__file", BLOCK]


def _walk(piece: str, inside: bool) -> tuple[bool, int, int]:
    """Whether a string is open behind the piece, the change of depth with the brace that ends it, where text outside strings begins."""
    begin = 0
    if inside:
        end = STRING_END.match(piece)
        if end is None:
            return True, 0, len(piece)
        begin = end.end()
    bare = STRING.sub("", piece[begin:])
    quote = bare.find('"')
    return quote >= 0, bare.count("{", 0, quote if quote >= 0 else len(bare)) - (quote < 0), begin


def _splits(part: pa.RecordBatch) -> list[tuple[str, int]]:
    return list(zip(part.column("__file").to_pylist(), part.column(BLOCK).to_pylist()))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: string open and change of depth, if it starts outside and if it starts inside a string."""
    def row(split, states) -> pa.RecordBatch:
        values = [*split, *states[0], *states[1]]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [*SPLIT, "out", "out_depth", "in", "in_depth"])

    split, states = None, []
    for part in batches:
        for now, piece in zip(_splits(part), part.column("value").to_pylist()):
            if now != split:
                if split is not None:
                    yield row(split, states)
                split, states = now, [(False, 0), (True, 0)]
            states = [(after, depth + change) for inside, depth in states for after, change, _ in [_walk(piece, inside)]]
    if split is not None:
        yield row(split, states)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the start of every split of a file, from the effects of those before."""
    file, inside, depth = None, False, 0
    for part in batches:
        found = []
        for row in part.to_pylist():
            if row["__file"] != file:
                file, inside, depth = row["__file"], False, 0
            found.append((row["__file"], row[BLOCK], inside, depth))
            depth += row["in_depth"] if inside else row["out_depth"]
            inside = row["in"] if inside else row["out"]
        columns = list(zip(*found)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*SPLIT, "__inside", "__depth"])


_FOUND = f"__file string, {BLOCK} bigint, n bigint, value string, from_left boolean, to_right boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of a split, and the parts of those that reach over its borders."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    names = [*SPLIT, "n", "value", "from_left", "to_right"]
    split, inside, depth, held, n, left = None, False, 0, [], 0, False
    for part in batches:
        found = []
        states = zip(part.column("__inside").to_pylist(), part.column("__depth").to_pylist())
        for now, piece, state in zip(_splits(part), part.column("value").to_pylist(), states):
            if now != split:
                if depth > 0:
                    found.append((*split, n, "".join(held), left, True))
                if state[0] is None:
                    raise ValueError(f"no start state for split {now}")
                split, (inside, depth), held, n = now, state, [], 0
                left = depth > 0
            after, change, begin = _walk(piece, inside)
            if depth > 0:
                held.append(piece + "}")
            elif opening := OPENING.match(piece, begin):
                held.append(piece[opening.end() - 1:] + "}")
            inside, depth, before = after, depth + change, depth
            if depth == 0 and not inside and (before > 0 or held):
                found.append((*split, n, "".join(held), left, False))
                held, n, left = [], n + 1, False
        columns = list(zip(*found)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    if split is not None and depth > 0:
        last = (*split, n, "".join(held), left, True)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """The text (`value`) of every object of a UTF-8 file of one array, of lines, or of one object; many tasks a file.

    Only outermost objects count; other values of an array are passed over, and so are arrays around the objects. An
    empty file or array has no rows. A record may reach over any number of splits. Text that is not JSON gives rows
    that do not parse.
    """
    scan = with_block(spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("__file"), "_metadata"))
    scan = scan.drop("_metadata")
    effects = scan.mapInArrow(_effects, f"__file string, {BLOCK} bigint, out boolean, out_depth bigint, in boolean, in_depth bigint")
    states = effects.repartition("__file").sortWithinPartitions(*SPLIT).mapInArrow(
        _starts, f"__file string, {BLOCK} bigint, __inside boolean, __depth bigint")
    found = cut_lineage(with_states(scan, states, SPLIT).mapInArrow(_records, _FOUND), "json-records")
    cut = F.col("from_left") | F.col("to_right")
    number = F.sum(F.when(F.col("from_left"), 0).otherwise(1)).over(Window.partitionBy("__file").orderBy(BLOCK, "n"))
    parts = found.where(cut).withColumn("record", number).groupBy("__file", "record").agg(  # at most two a split
        F.array_sort(F.collect_list(F.struct(BLOCK, "n", "value"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    return found.where(~cut).select("value").unionByName(joined)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array per partition, each on a single line; `path` should end in `.json`."""
    def brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
        first = True
        for part in batches:
            values = ["," + v for v in part.column("value").to_pylist()]
            if first and values:
                values[0], first = values[0][1:], False
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInArrow(brackets, "value string").write.option("lineSep", " ").text(path)
