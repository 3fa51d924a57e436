"""Span masks, batches and packed sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.hashing import seeded_hash
from corpuslake.functions.text import col
from corpuslake.functions.vectors import let
from corpuslake.operators.ordering import Order, with_rank
from corpuslake.operators.splits import BLOCK, with_block, with_states
from corpuslake.session import shared_dir

IGNORE_LABEL = -100
MIN_MASK_RATIO = 0.05


def _draws(seed: Column, tag: str, n: Column) -> Column:
    """n random numbers in [0, 1), sorted: 40-bit pieces of the MD5 of seed, tag and number."""
    def one(i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", seed.cast("string"), F.lit(tag), i.cast("string")))
        return F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))

    return F.array_sort(F.transform(F.sequence(F.lit(1), n), one))


def span_masks(df: DataFrame, ids: str = "input_ids", key: str = "doc_id", max_ratio: float = 0.30,
               mean_len: float = 3, seed: int = 0, epoch: int = 0, out: str = "spans") -> DataFrame:
    """Disjoint random spans inside `[1, length - 1)` that cover a random share of the sequence exactly.

    The share is uniform between `MIN_MASK_RATIO` and `max_ratio`. The covered tokens are cut at random points into
    pieces of `mean_len` tokens on average (the gaps between uniform points are exponential in the limit), and the
    free tokens at as many random points: the i-th span starts behind the free and the covered tokens before it. So
    spans never overlap and none has to be drawn twice. Everything depends on key, epoch and seed only; no shuffle.
    """
    base = seeded_hash(seed, epoch, F.col(key))
    length = F.size(ids)
    room = F.greatest(length - 2, F.lit(0))
    share = F.lit(MIN_MASK_RATIO) + F.get(_draws(base, "share", F.lit(1)), F.lit(0)) * F.lit(max_ratio - MIN_MASK_RATIO)
    covered = F.least(F.floor(length * share).cast("int"), room)
    pieces = F.greatest(F.round(covered / F.lit(float(mean_len))).cast("int"), F.lit(1))

    def spans(plan: Column) -> Column:
        free = room - plan["covered"]
        cuts = F.transform(plan["cuts"], lambda x: F.floor(x * plan["covered"]).cast("int"))
        cuts = F.concat(F.array(F.lit(0)), F.slice(cuts, F.lit(1), plan["pieces"] - 1), F.array(plan["covered"]))
        gaps = F.transform(plan["gaps"], lambda x: F.floor(x * (free + 1)).cast("int"))

        def span(gap: Column, i: Column) -> Column:
            start = F.lit(1) + gap + F.get(cuts, i)
            return F.struct(start.alias("start"), (F.lit(1) + gap + F.get(cuts, i + 1)).alias("end"))

        return F.filter(F.transform(gaps, span), lambda s: s["start"] < s["end"])

    plan = F.struct(covered.alias("covered"), pieces.alias("pieces"), _draws(base, "cut", pieces).alias("cuts"),
                    _draws(base, "gap", pieces).alias("gaps"))
    return df.withColumn(out, let(plan, spans))


def _stitch(ids: Column, spans: Column, inside, outside) -> Column:
    """Rebuild the sequence piece by piece: linear in its length, however many spans it has."""
    def end_before(i):
        return F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])

    def piece(span, i):
        gap = F.slice(ids, end_before(i) + 1, span["start"] - end_before(i))
        return F.concat(outside(gap), inside(F.slice(ids, span["start"] + 1, span["end"] - span["start"])))

    tail_from = end_before(F.size(spans))
    tail = F.slice(ids, tail_from + 1, F.size(ids) - tail_from)
    return F.concat(F.flatten(F.transform(spans, piece)), outside(tail))


def apply_mask(df: DataFrame, mask_id: int, ids: str = "input_ids", spans: str = "spans") -> DataFrame:
    """Covered tokens become `mask_id`; `labels` hold the originals there and -100 elsewhere."""
    def constant(value):
        return lambda part: F.array_repeat(F.lit(value), F.size(part))

    def same(part):
        return part

    labels = _stitch(col(ids), col(spans), same, constant(IGNORE_LABEL))
    masked = _stitch(col(ids), col(spans), constant(mask_id), same)
    return df.withColumn("labels", labels).withColumn(ids, masked)


def assign_batches(df: DataFrame, batch_size: int, order: Sequence[Order], shard: Sequence[str] = (), **kw) -> DataFrame:
    """Consecutive rows of a shard form a batch; adds `batch_id` and `pos` inside the batch."""
    rows = with_rank(df, order, shard, "__rank", **kw)
    return (rows.withColumn("batch_id", F.floor((F.col("__rank") - 1) / batch_size).cast("bigint"))
            .withColumn("pos", F.pmod(F.col("__rank") - 1, F.lit(batch_size)).cast("bigint")).drop("__rank"))


def pack_sequences(df: DataFrame, max_len: int = 4_096, batch: Sequence[str] = ("batch_id",), pos: str = "pos",
                   ids: str = "input_ids", **kw) -> DataFrame:
    """Sequences of a batch in order until the first that no longer fits; adds `start`.

    The rest of the batch is left out, as the packing rule says. If the first one alone is too long
    it is cut to `max_len` and carries no labels. Every sequence has at least one token, so only the
    first `max_len` rows of a batch can fit: the window never holds more.
    """
    rows = df.where(F.size(ids) > 0)
    rows = with_rank(rows, [pos], batch, "__rank", limit=max_len, **kw)
    so_far = Window.partitionBy(*batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__end", F.sum(F.size(ids)).over(so_far))
    cut = (F.col("__rank") == 1) & (F.col("__end") > max_len)
    rows = rows.where((F.col("__end") <= max_len) | cut)
    rows = rows.withColumn("start", F.when(cut, F.lit(0)).otherwise(F.col("__end") - F.size(ids)).cast("bigint"))
    if "labels" in df.columns:
        none = F.array_repeat(F.lit(IGNORE_LABEL), max_len)
        rows = rows.withColumn("labels", F.when(cut, none).otherwise(F.col("labels")))
    return rows.withColumn(ids, F.slice(ids, 1, max_len)).drop("__rank", "__end")


def _fit(sizes: np.ndarray, used: int, pack: int, max_len: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Packs and starts of consecutive sequences after a pack that holds `used` tokens, and the state behind them."""
    ends = np.cumsum(sizes)
    packs, starts = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    at, base = 0, -used
    while at < len(sizes):
        stop = max(int(np.searchsorted(ends, base + max_len, side="right")), at + (used == 0))  # an empty pack takes any sequence
        packs[at:stop] = pack
        starts[at:stop] = ends[at:stop] - sizes[at:stop] - base
        if stop > at:
            used = int(ends[stop - 1]) - base
        if stop < len(sizes):
            pack, used, base = pack + 1, 0, int(ends[stop - 1]) if stop else 0
        at = stop
    return packs, starts, min(used, max_len), pack


def _fit_any(sizes: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of tokens before, 0 to `max_len`: tokens in the last pack and packs opened behind `sizes`.

    A pack that starts at some sequence ends at the same place whatever came before, so the ways from all states are
    few: they are followed backwards once.
    """
    ends = np.cumsum(sizes)
    before, n = ends - sizes, len(sizes)
    following = np.maximum(np.searchsorted(ends, before + max_len, side="right"), np.arange(1, n + 1)).tolist()
    opened, left = [0] * n, (ends[-1] - before).tolist()
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            opened[i], left[i] = opened[following[i]] + 1, left[following[i]]
    states = np.arange(max_len + 1)
    first = np.searchsorted(ends, max_len - states, side="right")
    first[0] = max(first[0], 1)
    inside, at = first >= n, np.minimum(first, n - 1)
    used = np.where(inside, states + ends[-1], np.array(left)[at])
    return np.minimum(used, max_len), np.where(inside, 0, np.array(opened)[at] + 1)


def _runs(part: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Borders of the runs of rows that agree in all the columns."""
    same = np.ones(max(part.num_rows - 1, 0), dtype=bool)
    for name in columns:
        values = part.column(name)
        same &= pc.equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    borders = [0, *(np.flatnonzero(~same) + 1).tolist(), part.num_rows]
    return zip(borders[:-1], borders[1:])


_PIECE = "part int, block bigint, key string, table boolean, used array<int>, packs array<bigint>"


def _pieces(max_len: int):
    """What every split does to the batch at its beginning (for any state) and leaves of the batch at its end."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("key", pa.string()), ("table", pa.bool_()),
                        ("used", pa.list_(pa.int32())), ("packs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = key = head = None
        used = pack = 0

        def row(table: bool, used, packs) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"part": split[0], "block": split[1], "key": key, "table": table, "used": used, "packs": packs}], schema)

        def close_head() -> pa.RecordBatch:
            return row(True, *(x.tolist() for x in _fit_any(np.concatenate(head), max_len)))

        for part in batches:
            sizes = part.column("__n").to_numpy().astype(np.int64)
            for low, high in _runs(part, ("__part", BLOCK, "__key")):
                now = part.column("__part")[low].as_py(), part.column(BLOCK)[low].as_py()
                group = part.column("__key")[low].as_py()
                if now != split:
                    if split is not None:
                        yield close_head() if head else row(False, [used], [pack])
                    split, key, head = now, group, []
                elif group != key:
                    if head:
                        yield close_head()
                    key, head, used, pack = group, None, 0, 0
                if head is not None:
                    head.append(sizes[low:high])
                else:
                    used, pack = _fit(sizes[low:high], used, pack, max_len)[2:]
        if split is not None:
            yield close_head() if head else row(False, [used], [pack])

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which every split finds the batch at its beginning."""
    key, used, pack = None, 0, 0
    for part in batches:
        found = []
        for i in range(part.num_rows):
            if (now := part.column("key")[i].as_py()) != key:
                key, used, pack = now, 0, 0
            to, opened = part.column("used")[i].values, part.column("packs")[i].values
            if part.column("table")[i].as_py():
                found.append((part.column("part")[i].as_py(), part.column("block")[i].as_py(), used, pack))
                used, pack = to[used].as_py(), pack + opened[used].as_py()
            else:
                used, pack = to[0].as_py(), opened[0].as_py()
        columns = list(zip(*found)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                         ["__part", BLOCK, "__used", "__pack"])


def pack_next_fit(df: DataFrame, max_len: int = 4_096, batch: Sequence[str] = ("batch_id",), pos: str = "pos",
                  ids: str = "input_ids") -> DataFrame:
    """Every sequence of a batch, in order, in the current pack if it fits, else in a new one; adds `pack` and `start`.

    Nothing is left out but sequences without a token; one longer than `max_len` has a pack of its own and keeps its
    tokens. Rows are written once in the order of batch and `pos`, by ranges, so one batch may spread over any number
    of tasks. A split's effect on the batch that reaches into it is a table of `max_len` + 1 states; one task composes
    the tables of a batch, one per split, reading them one after the other. Rows that tie in batch and `pos` are taken
    in either order.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows, path = df.where(F.size(ids) > 0), shared_dir(spark, "next-fit")
    ordered = rows.repartitionByRange(tasks, *batch, pos).sortWithinPartitions(*batch, pos).withColumn("__part", F.spark_partition_id())
    ordered.write.option("maxRecordsPerFile", 0).parquet(path)  # one file a partition
    scan = with_block(spark.read.schema(ordered.schema).parquet(path))
    scan = scan.withColumn("__n", F.size(ids)).withColumn("__key", F.to_json(F.struct(*batch), {"ignoreNullFields": "false"}))
    pieces = scan.select("__part", BLOCK, "__key", "__n").mapInArrow(_pieces(max_len), _PIECE)
    pieces = pieces.repartition(tasks, "key").sortWithinPartitions("key", "part", "block")
    states = pieces.mapInArrow(_starts, f"__part int, {BLOCK} bigint, __used bigint, __pack bigint")
    names = rows.columns
    schema = rows.schema.add("pack", T.LongType()).add("start", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, key, used, pack = None, None, 0, 0
        for part in batches:
            sizes = part.column("__n").to_numpy().astype(np.int64)
            packs, starts = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
            for low, high in _runs(part, ("__part", BLOCK, "__key")):
                now = part.column("__part")[low].as_py(), part.column(BLOCK)[low].as_py()
                group = part.column("__key")[low].as_py()
                if now != split:
                    split, key = now, group
                    used, pack = part.column("__used")[low].as_py(), part.column("__pack")[low].as_py()
                    if used is None:
                        raise ValueError(f"no start state for split {now}")
                elif group != key:
                    key, used, pack = group, 0, 0
                packs[low:high], starts[low:high], used, pack = _fit(sizes[low:high], used, pack, max_len)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(packs), pa.array(starts)], [*names, "pack", "start"])

    return with_states(scan, states, ["__part", BLOCK]).mapInArrow(run, schema)


def packed_layout(df: DataFrame, batch: Sequence[str] = ("batch_id",), pos: str = "pos", ids: str = "input_ids") -> DataFrame:
    """One row per pack: tokens, `cu_seqlens`, `position_ids` and `max_seqlen`.

    `start` is the place of a sequence in its pack, as both packings give it. A pack holds at most `max_len` tokens, so
    the collected lists are bounded.
    """
    columns = [pos, ids, "start"] + (["labels"] if "labels" in df.columns else [])
    packs = df.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__s"))
    lens = F.transform("__s", lambda s: F.size(s[ids]))
    ends = F.concat(F.array(F.lit(0)), F.transform("__s", lambda s: s["start"].cast("int") + F.size(s[ids])))
    positions = F.flatten(F.transform(lens, lambda n: F.sequence(F.lit(0), n - 1)))
    labels = [F.flatten(F.transform("__s", lambda s: s["labels"])).alias("labels")] if "labels" in df.columns else []
    return packs.select(
        *batch, F.flatten(F.transform("__s", lambda s: s[ids])).alias(ids), *labels, ends.alias("cu_seqlens"),
        positions.alias("position_ids"), F.array_max(lens).alias("max_seqlen"))


def mask_report(df: DataFrame, ids: str = "input_ids", spans: str = "spans", source: str = "source") -> DataFrame:
    """Realised share of masked tokens per source."""
    masked = F.aggregate(spans, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    totals = df.groupBy(source).agg(F.sum(F.size(ids)).alias("tokens"), F.sum(masked).alias("masked"))
    return totals.withColumn("share", F.col("masked") / F.col("tokens"))
