"""Operator 10, removal of repeated passages over a sparse suffix array.

A byte goes if a string of `LENGTH` bytes that covers it also starts somewhere else. Such strings are found at
anchors: the k-gram with the smallest hash among all k-grams of the string, which depends on the string alone,
so equal strings have equal k-grams at equal distances. Only the suffixes that start at anchors are sorted.

1. Anchors of all texts, with hashes of their k-gram and of their context (all bytes that a string over the anchor
   can reach). A k-gram that occurs once cannot lie in a repeated string. A context that occurs twice makes all its
   strings repeated, without looking further.
2. What remains are different contexts around equal k-grams. Tasks sort the suffixes at these anchors into runs,
   front-coded against their predecessor, and exchange the runs.
3. A loser tree merges the runs. It keeps the length of the prefix that each candidate shares with the last
   suffix, decides by it, and compares bytes only beyond it. The common prefixes of neighbours come for free.
4. For every distance d, two anchors belong to equal strings if their suffixes share LENGTH - d bytes (neighbours in
   sorted order) and the d bytes before them are equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.jaccard import _mix, _power_tables
from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import replacing, text_of
from corpuslake.llm.winnowing import choose, gram_hashes
from corpuslake.session import cut_lineage

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM            # farthest distance of an anchor from the start of a string
#: Suffixes that a partition of the merge should hold, and that a task collects before it writes a run.
PART_ITEMS, RUN_ITEMS = 50_000, 100_000
#: Different contexts around one k-gram beyond which they are compared string by string, spread over all tasks.
CROWD = 200_000

_LOW = np.uint64((1 << 32) - 1)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, the hash of the k-gram there, and the hash of the context."""
    if len(raw) < LENGTH:
        return (np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64)] * 2)
    hashes = gram_hashes(raw, GRAM)
    places = (choose(hashes, LENGTH - GRAM + 1) & _LOW).astype(np.int64)
    first, stop = np.maximum(places - REACH, 0), np.minimum(places + LENGTH, len(raw))
    with np.errstate(over="ignore"):
        sums, inverse = _prefix_sums(raw)
        shape = ((places - first) * 1024 + (stop - places)).astype(np.uint64)
        context = _mix((sums[stop] - sums[first]) * inverse[first] + _mix(shape))
    return places, hashes[places], context


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power_tables(len(raw) + 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)])]), inverse


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that are known to share `known` bytes."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    different = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (different.bit_length() + 7) // 8


def front_coded(items: list[tuple[bytes, bytes, int, int]]) -> dict[str, bytes]:
    """A sorted run of (suffix, bytes before it in reverse, text hash, place): each suffix without the prefix it shares
    with its predecessor."""
    prefixes, last = [], b""
    for item in items:
        prefixes.append(shared(last, item[0], 0))
        last = item[0]
    return {
        "prefixes": bytes(prefixes), "sizes": bytes(len(i[0]) for i in items), "tails": b"".join(i[0][p:] for i, p in zip(items, prefixes)),
        "before_sizes": bytes(len(i[1]) for i in items), "before": b"".join(i[1] for i in items),
        "ids": np.array([i[2:] for i in items], dtype=np.int64).tobytes(),
    }


def decoded(run: dict[str, bytes]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(prefix shared with the predecessor, suffix, bytes before, text hash, place) in order."""
    ids = np.frombuffer(run["ids"], dtype=np.int64).reshape(-1, 2).tolist()
    tail = back = 0
    last = b""
    for prefix, size, before, (text, place) in zip(run["prefixes"], run["sizes"], run["before_sizes"], ids):
        last = last[:prefix] + run["tails"][tail:tail + size - prefix]
        tail += size - prefix
        yield prefix, last, run["before"][back:back + before], text, place
        back += before


def merged(runs: list[Iterator[tuple[int, bytes, bytes, int, int]]]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """All items of sorted runs in order, each with the prefix it shares with its predecessor in the result.

    A loser tree over the heads of the runs. `known[r]` is what the head of run r shares with the last item that left
    the tree. Of two heads the one with the longer known prefix is the smaller; only if both are equal are bytes
    compared, from there on, and the loser keeps the prefix that it shares with the winner.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (width - len(runs))
    known = [0] * width

    def winner(a: int, b: int) -> tuple[int, int]:
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        prefix = shared(x, y, known[a])
        a, b = (a, b) if x[prefix:prefix + 1] <= y[prefix:prefix + 1] else (b, a)
        known[b] = prefix
        return a, b

    losers = [0] * width
    round_ = list(range(width))
    at = width // 2
    while len(round_) > 1:
        following = []
        for i in range(0, len(round_), 2):
            best, losers[at + i // 2] = winner(round_[i], round_[i + 1])
            following.append(best)
        round_, at = following, at // 2
    best = round_[0]
    while heads[best] is not None:
        head = heads[best]
        yield known[best], *head[1:]
        heads[best] = next(runs[best], None)
        known[best] = heads[best][0] if heads[best] is not None else 0
        node = (best + width) // 2
        while node:
            best, losers[node] = winner(losers[node], best) if losers[node] < best else winner(best, losers[node])
            node //= 2


def repeated(prefixes: np.ndarray, sizes: np.ndarray, before: np.ndarray, before_sizes: np.ndarray) -> np.ndarray:
    """For sorted suffixes: which string at which distance (columns 0 .. REACH) has an equal one.

    `prefixes` are the common prefixes with the predecessor, `before` holds the bytes before each suffix in reverse.
    """
    n = len(prefixes)
    found = np.zeros((n, REACH + 1), dtype=bool)
    left = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for d in range(REACH + 1):
            if d:
                left = left * np.uint64(0x9E3779B97F4A7C15) + before[:, d - 1] + np.uint64(1)
            group = np.cumsum(prefixes < LENGTH - d)  # runs of suffixes that share LENGTH - d bytes
            usable = np.flatnonzero((before_sizes >= d) & (sizes >= LENGTH - d) & (np.bincount(group, minlength=n + 1)[group] > 1))
            if len(usable) < 2:
                continue
            keys = _mix(left[usable] + _mix(group[usable].astype(np.uint64)))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            found[usable[order[1:][same]], d] = True
            found[usable[order[:-1][same]], d] = True
    return found


ITEM = {"prefixes": pa.binary(), "sizes": pa.binary(), "tails": pa.binary(), "before_sizes": pa.binary(), "before": pa.binary(), "ids": pa.binary()}


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for text, value in zip(part.column("text"), part.column("hash").to_pylist()):
                raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                places, grams, contexts = anchors(raw)
                if len(places):
                    mark = zlib.crc32(raw) - (1 << 31)  # signed, so that it fits the upper half of a long
                    for column, x in zip(columns, (grams.view(np.int64), contexts.view(np.int64), np.full(len(places), value), (mark << 32) | places)):
                        column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["gram", "context", "hash", "place"])


def _write_runs(parts: int):
    """Suffixes at the listed places of each text, as sorted front-coded runs, one per partition of the merge."""
    def encoded(items: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for part, mine in items.items():
            mine.sort()
            run = front_coded(mine)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([run[c]], t) for c, t in ITEM.items()]], ["part", *ITEM])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held = {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    raw = r["text"].encode("utf-8", "surrogatepass")
                    for spot in r["spots"]:
                        m = spot["place"] & 0xFFFFFFFF
                        item = (raw[m:m + LENGTH], raw[max(0, m - REACH):m][::-1], r["hash"], spot["place"])
                        items.setdefault(spot["gram"] % parts, []).append(item)
                    held += len(r["spots"])
                    if held >= RUN_ITEMS:
                        yield from encoded(items)
                        items, held = {}, 0
        yield from encoded(items)
    return run


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by partition of the merge."""
    part, runs = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if runs and r["part"] != part:
                yield _spans_of(runs)
                runs = []
            part = r["part"]
            runs.append(decoded(r))
    if runs:
        yield _spans_of(runs)


def _spans_of(runs: list[Iterator[tuple[int, bytes, bytes, int, int]]]) -> pa.RecordBatch:
    """Bytes that repeated strings cover: (text hash, place with the mark of the text, first byte, end)."""
    prefixes, sizes, before, ids = [], [], [], []
    for prefix, suffix, back, text, place in merged(runs):
        prefixes.append(prefix)
        sizes.append(len(suffix))
        before.append(back)
        ids.append((text, place))
    table_ = np.frombuffer(b"".join(b.ljust(REACH, b"\0") for b in before), dtype=np.uint8).reshape(-1, REACH).astype(np.uint64)
    found = repeated(np.array(prefixes), np.array(sizes), table_, np.array([len(b) for b in before]))
    edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
    row, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)  # distances near .. far - 1 are repeated
    owner = np.array(ids, dtype=np.int64).reshape(-1, 2)[row]
    place = owner[:, 1] & 0xFFFFFFFF
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[:, 0]), pa.array(owner[:, 1] >> 32), pa.array(((place - far + 1) << 32) | (place - near + LENGTH))], ["hash", "mark", "span"])


def covered(size: int, spans: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in one of the spans (first * 2**32 + end)."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, np.minimum(spans >> 32, size), 1)
    np.add.at(change, np.minimum(spans & 0xFFFFFFFF, size), -1)
    return np.cumsum(change[:-1]) > 0


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(hash, mark, span) of the repeated bytes of each different text of `documents` (doc_id, text, hash, mark)."""
    spark = documents.sparkSession
    found = documents.select("text", "hash").mapInArrow(_find_anchors, "gram bigint, context bigint, hash bigint, place bigint")
    found = cut_lineage(found, "suffix-anchors")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("several"))
    grams = cut_lineage(grams.where(F.col("n") > 1).select(F.col("gram").alias("g"), "several"), "suffix-grams")  # so that a skewed join can be split
    found = cut_lineage(found.join(grams, F.col("gram") == F.col("g")).drop("g"), "suffix-shared")

    contexts = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.first("several").alias("several"),
                                                    F.first("hash").alias("hash"), F.first("place").alias("place"))
    contexts = cut_lineage(contexts, "suffix-contexts")
    twice = contexts.where(F.col("n") > 1).select(F.col("gram").alias("g"), F.col("context").alias("c"))
    whole = found.join(twice, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")))
    place = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    first = F.greatest(place - F.lit(REACH), F.lit(0).cast("bigint"))
    whole = whole.select("hash", F.shiftright("place", 32).alias("mark"), F.shiftleft(first, 32).bitwiseOR(place + F.lit(LENGTH)).alias("span"))

    rest = contexts.where("several")
    crowds = rest.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(F.col("gram").alias("g"))
    crowds = cut_lineage(crowds, "suffix-crowds")
    rest = rest.join(crowds.withColumn("crowd", F.lit(True)), F.col("gram") == F.col("g"), "left").drop("g")
    mark = F.shiftright("place", 32)
    spots = rest.groupBy("hash", mark.alias("mark")).agg(
        F.collect_list(F.struct("gram", "place", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("spots"))  # anchors of one text
    one = documents.groupBy("hash", "mark").agg(F.min("doc_id").alias("first_id"))
    spots = spots.join(one, ["hash", "mark"]).select(F.col("hash").alias("h"), F.col("mark").alias("k"), "first_id", "spots")
    spots = cut_lineage(spots, "suffix-spots")
    texts = documents.join(spots, (F.col("hash") == F.col("h")) & (F.col("mark") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = texts.select("hash", "text", "spots")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(tasks, -(-rest.count() // PART_ITEMS))
    sorted_here = texts.withColumn("spots", F.filter("spots", lambda s: ~s["crowd"]))
    runs = sorted_here.mapInArrow(_write_runs(parts), "part int, " + ", ".join(f"{c} binary" for c in ITEM))
    runs = runs.repartition(parts, "part").sortWithinPartitions("part")
    spans = runs.mapInArrow(_merge_runs, "hash bigint, mark bigint, span bigint")
    result = whole.unionByName(spans)
    if not crowds.isEmpty():
        result = result.unionByName(_crowded(texts.withColumn("spots", F.filter("spots", lambda s: s["crowd"]))))
    return cut_lineage(result, "suffix-spans")


def _crowded(texts: DataFrame) -> DataFrame:
    """The same for anchors in very large groups: every string over the anchor by its hash, so that no task gets a group."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if not r["spots"]:
                    continue
                raw = np.frombuffer(r["text"].encode("utf-8", "surrogatepass"), dtype=np.uint8)
                starts = np.unique(np.concatenate([
                    np.arange(max(0, m - REACH), min(m, len(raw) - LENGTH) + 1) for m in (s["place"] & 0xFFFFFFFF for s in r["spots"])]))
                with np.errstate(over="ignore"):
                    sums, inverse = _prefix_sums(raw)
                    one = _mix((sums[starts + LENGTH] - sums[starts]) * inverse[starts])
                    two = gram_hashes(raw, LENGTH)[starts]
                mark = np.full(len(starts), r["spots"][0]["place"] >> 32)
                columns = [one.view(np.int64), two.view(np.int64), np.full(len(starts), r["hash"]), mark, (starts << 32) | (starts + LENGTH)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["one", "two", "hash", "mark", "span"])

    found = cut_lineage(texts.mapInArrow(strings, "one bigint, two bigint, hash bigint, mark bigint, span bigint"), "suffix-strings")
    found = found.dropDuplicates()
    twice = found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("one").alias("o"), F.col("two").alias("t"))
    return found.join(twice, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))).select("hash", "mark", "span")


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `df` with `spans` (array of first byte and end), `n_bytes`, `kept` (the remaining bytes) and
    `kept_text` (the same as text, without letters that were cut apart).

    Every byte goes that is covered by a string of 200 bytes which also starts somewhere else, in the same document or
    another, the first occurrence included; strings are judged on the input. Texts are UTF-8 bytes, a null text counts as
    empty, a text below 200 bytes stays; repeated rows are copies of each other, so their strings repeat. Null keys are
    allowed; an empty table gives no row. Input columns named like a result are replaced.
    """
    added = ["spans", "n_bytes", "kept", "kept_text"]
    kept = replacing(df.columns, added)
    rows = df.select(F.struct(*[F.col(c) for c in kept if c != text], F.lit(0).alias("__")).alias("row"),
                     F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("given"), text_of(text).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("mark", F.crc32(F.encode("text", "UTF-8")) - F.lit(1 << 31))
    spans = repeated_spans(rows.select("doc_id", "text", "hash", "mark"))
    spans = spans.groupBy(F.col("hash").alias("h"), F.col("mark").alias("k")).agg(F.collect_set("span").alias("spans"))  # of one text
    found = rows.join(spans, (F.col("hash") == F.col("h")) & (F.col("mark") == F.col("k")), "left").select("row", "given", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("first", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for given, marks in zip(part.column("given"), part.column("spans")):
                    raw = (given.as_py() or "").encode("utf-8", "surrogatepass")
                    runs, rest = [], raw
                    if marks.is_valid and raw:
                        gone = covered(len(raw), np.array(marks.as_py(), dtype=np.int64))
                        turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                        runs = [{"first": a, "end": b} for a, b in turns.tolist()]
                        rest = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    left = None if not given.is_valid else rest.decode("utf-8", "ignore") if runs else given.as_py()
                    for column, x in zip(out, (runs, len(raw), rest, left)):
                        column.append(x)
                types = (pa.list_(pair), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("given"), *[pa.array(c, t) for c, t in zip(out, types)]],
                                                 ["row", "given", *added])

    schema = found.select("row", "given").schema
    for field in df.sparkSession.createDataFrame([], "spans array<struct<first:bigint,end:bigint>>, n_bytes bigint, kept binary, kept_text string").schema.fields:
        schema = schema.add(field)
    cleaned = found.mapInArrow(cut, schema)
    return cleaned.select(*[F.col("given").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept], *added)


REPEATED_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, n, j, substr(h, 512 * j + 1, 912) AS part FROM (SELECT doc_id, n, h, unnest(range((n + 255) // 256)) AS j FROM d)),
w AS (SELECT doc_id, 256 * j + o AS i, hash(substr(part, 2 * o + 1, 400)) AS k FROM (
  SELECT doc_id, j, part, unnest(range(least(256, n - 199 - 256 * j))) AS o FROM c WHERE n - 199 - 256 * j > 0)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w WHERE k IN (FROM twice)),
runs AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
spans AS (SELECT doc_id, min(i) AS first, max(i) + 200 AS stop FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0) AS a, first AS b FROM spans
  UNION ALL SELECT doc_id, max(stop), NULL FROM spans GROUP BY doc_id),
rest AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS r FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
total AS (SELECT doc_id, sum(stop - first)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(r, h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


@query("op10_suffix_array_dedup", REPEATED_SQL)
def op10_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = remove_repeated(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                          F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
