"""Operator 11, a trie of conversation prefixes from sorted sequences and range minima.

1. A turn becomes a digest, a conversation the sequence of its digests: a key whose first 16 * d bytes stand for its
   first d turns. Equal sequences are counted and stand for their conversations from here on.
2. Keys are sorted over all tasks by range. Neighbours in the order share as many turns as any two keys around them,
   so the conversations that start with a prefix are an interval: as far as the shared turns do not fall below its
   depth. A task has a sparse table of the range minima of the shared turns, in which every candidate prefix searches
   its left and its right end by itself, in steps of powers of two.
3. Candidates in order of (first key, depth) are in preorder, so a subtree is a range of them, and sums over it are
   differences of running sums.
4. Intervals that touch the edge of a task may go on in the next one. Their shares are added up in a table that holds,
   for each task, the prefixes of its first and its last key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.mixing import words_of
from corpuslake.llm.registry import query, table
from corpuslake.session import cut_lineage

#: Bytes of a turn in a key.
WIDTH = 16
#: Keys that a task should hold. More keys mean more tasks.
KEYS_PER_TASK = 200_000
#: Conversations of one sequence whose ids make one row before they are hashed in order.
IDS_PER_ROW = 4_096
#: Conversations of a family share the opening turns of its first one.
FAMILY, OPENINGS = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; the length of the role keeps role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv, turns`: one row per conversation, its turns (digest, words) in order of `turn`, null first.

    Texts go no further than the task that reads them. Turns of one conversation with equal numbers are ordered by
    their digests. A null conversation is none and left out.
    """
    said, heard = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
                                                   turn_digest(said, heard).alias("digest"), words_of(text).alias("words"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    return rows.groupBy("conv").agg(turns.alias("t")).select("conv", F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("turns"))


def with_shared_openings(convs: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % family, then the own turns after the first h;
    h is the CRC-32 of the id's decimal digits modulo `openings`. At most `family` conversations meet one opening."""
    convs = cut_lineage(convs, "trie-turns")
    first = convs.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, openings - 1).alias("head"))
    h = F.pmod(F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")), F.lit(openings)).cast("int")
    rows = convs.withColumn("h", h).withColumn("of", F.col("conv") - F.col("conv") % family)
    rows = rows.join(first, F.col("of") == F.col("base"), "left")
    opening = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.select("conv", F.concat(opening, own).alias("turns"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """`key, words, n, first, ends` for every distinct sequence: its digests in a row, the words of its turns, its
    conversations, the smallest of them, and the SHA-256 of their ids in ascending order, joined by commas.

    A hash of a list cannot be split. Its rows are joined in blocks first, in parallel; then blocks stream through one
    hash per sequence, so that no task holds the list.
    """
    key = F.unhex(F.array_join(F.col("turns.digest"), ""))
    rows = convs.select("conv", key.alias("key"), F.col("turns.words").alias("words")).withColumn("id", F.md5("key"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy("id", F.floor(F.col("conv") / IDS_PER_ROW).alias("block")).agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("first"), ids.alias("ids"))
    tasks = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, "id").sortWithinPartitions("id", "block").select("id", "key", "words", "n", "first", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "words", "n", "first", "ends"]
        types = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        done: list[list] = []
        now = None  # id, key, words, n, first, hash

        def made() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in done], t) for i, t in enumerate(types)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and now[0] == r["id"]:
                    now[3] += r["n"]
                    now[4] = min(now[4], r["first"])
                    now[5].update(b"," + r["ids"].encode())
                    continue
                if now is not None:
                    done.append([*now[1:5], now[5].hexdigest()])
                now = [r["id"], r["key"], r["words"], r["n"], r["first"], hashlib.sha256(r["ids"].encode())]
                if len(done) >= 10_000:
                    yield made()
        if now is not None:
            done.append([*now[1:5], now[5].hexdigest()])
        if done:
            yield made()

    return blocks.mapInArrow(run, "key binary, words array<bigint>, n bigint, first bigint, ends string")


class RangeMinimum:
    """A sparse table: level j holds the minima of all ranges of 2**j values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of values[left .. right], both included."""
        size = right - left + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(left), dtype=self.levels[0].dtype)
        for j in np.unique(level):
            at = level == j
            out[at] = np.minimum(self.levels[j][left[at]], self.levels[j][right[at] - (1 << int(j)) + 1])
        return out

    def last_right(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The largest r with values[start + 1 .. r] all at least `floor`."""
        end = start.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[j], 1 << j
            fits = end + 1 < len(level)  # the range of the next `step` values exists
            fits[fits] = level[end[fits] + 1] >= floor[fits]
            end[fits] += step
        return end

    def first_left(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The smallest l with values[l + 1 .. start] all at least `floor`."""
        end = start.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[j], 1 << j
            fits = end - step >= 0
            fits[fits] = level[end[fits] - step + 1] >= floor[fits]
            end[fits] -= step
        return end


def shared_turns(keys: list[bytes]) -> np.ndarray:
    """Turns that each key shares with the one before it; the first shares none, -1 marks that."""
    shared = np.full(len(keys), -1, dtype=np.int64)
    for i in range(1, len(keys)):
        a, b, d = keys[i - 1], keys[i], 0
        while d < len(a) and a[d:d + WIDTH] == b[d:d + WIDTH]:
            d += WIDTH
        shared[i] = d // WIDTH
    return shared


NODE = ("open boolean, node string, parent string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string")


def _sorted_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of sorted keys. A node whose interval touches an edge of the range is open: its numbers are
    what this range knows, without other open nodes below it."""
    columns = [[] for _ in range(5)]
    for batch in batches:
        for into, column in zip(columns, batch.columns):
            into.extend(column.to_pylist())
    keys, words, n, first, ends = columns
    if not keys:
        return
    count = len(keys)
    size = np.array([len(k) // WIDTH for k in keys], dtype=np.int64)
    shared = shared_turns(keys)
    minimum, smallest = RangeMinimum(shared), RangeMinimum(np.array(first, dtype=np.int64))
    before = np.concatenate([[0], np.cumsum(np.array(n, dtype=np.int64))])

    new = size - shared  # prefixes that the key before does not have
    at = np.repeat(np.arange(count), new)
    start = np.cumsum(new) - new
    depth = np.arange(len(at)) - start[at] + shared[at] + 1
    left, right = minimum.first_left(at, depth), minimum.last_right(at, depth)
    convs = before[right + 1] - before[left]
    conv = smallest.least(left, right)

    # the parent's interval is searched as well; its candidate belongs to the interval's first key
    up = np.maximum(depth - 1, 0)
    parent_left = minimum.first_left(at, up)
    parent = np.where(depth > 0, start[parent_left] + up - shared[parent_left] - 1, -1)
    is_open = (left == 0) | (right == count - 1)
    said = np.concatenate([np.array(w, dtype=np.int64) for w in words]) if size.sum() else np.zeros(0, dtype=np.int64)
    offset = np.cumsum(size) - size
    own = np.zeros(len(at), dtype=np.int64)
    own[depth > 0] = said[offset[at[depth > 0]] + depth[depth > 0] - 1]
    children = np.bincount(parent[(parent >= 0) & ~is_open], minlength=len(at))
    value = np.where(is_open, 0, (convs - 1) * own)
    leaf = ~is_open & (children == 0)
    stop = start[right] + new[right]  # preorder: the subtree ends with the last candidate of the last key
    value_sum, leaf_sum = np.concatenate([[0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(leaf)])
    here = np.arange(len(at))
    saved, leaves = value_sum[stop] - value_sum[here], leaf_sum[stop] - leaf_sum[here]

    names: dict[int, str] = {}  # digests of open prefixes: those of the first and the last key
    for i in {0, count - 1}:
        digest = hashlib.md5()
        for d in range(size[i] + 1):
            digest.update(keys[i][WIDTH * (d - 1):WIDTH * d] if d else b"")
            owner = int(minimum.first_left(np.array([i]), np.array([d]))[0])
            names[int(start[owner] + d - shared[owner] - 1)] = digest.hexdigest()
    for begin in range(0, len(at), 10_000):
        part = range(begin, min(begin + 10_000, len(at)))
        up_open = [parent[i] >= 0 and is_open[parent[i]] for i in part]
        rows = {
            "open": [bool(is_open[i]) for i in part],
            "node": [names.get(i) if is_open[i] else None for i in part],
            "parent": [names[int(parent[i])] if o else None for i, o in zip(part, up_open)],
            "conv_id": conv[part.start:part.stop], "depth": depth[part.start:part.stop],
            "parent_conv_id": [int(conv[parent[i]]) if parent[i] >= 0 and not o else None for i, o in zip(part, up_open)],
            "n_convs": convs[part.start:part.stop], "n_children": children[part.start:part.stop],
            "n_leaves": leaves[part.start:part.stop], "saved_tokens": saved[part.start:part.stop], "words": own[part.start:part.stop],
            "ends_sha256": [ends[at[i]] if size[at[i]] == depth[i] else None for i in part],
        }
        types = [pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 8, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole numbers of the open nodes, from the shares of all ranges; deepest nodes first, each adds to its parent."""
    nodes: dict[str, dict] = {}
    for batch in batches:
        for r in batch.to_pylist():
            known = nodes.get(r["node"])
            if known is None:
                nodes[r["node"]] = r
                continue
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                known[name] += r[name]
            known["conv_id"] = min(known["conv_id"], r["conv_id"])
            known["ends_sha256"] = known["ends_sha256"] or r["ends_sha256"]
    for r in nodes.values():
        if r["depth"]:
            nodes[r["parent"]]["n_children"] += 1
    more = {name: [(r["n_convs"] - 1) * r["words"], int(r["n_children"] == 0)] for name, r in nodes.items()}  # of open nodes only
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        saved, leaves = more[r["node"]]
        r["saved_tokens"] += saved
        r["n_leaves"] += leaves
        if r["depth"]:
            more[r["parent"]][0] += saved
            more[r["parent"]][1] += leaves
            r["parent_conv_id"] = nodes[r["parent"]]["conv_id"]
    if nodes:
        names = list(next(iter(nodes.values())))
        types = [pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 8, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in nodes.values()], t) for c, t in zip(names, types)], names)


def prefix_trie(units: DataFrame) -> DataFrame:
    """All nodes of the trie over `distinct_sequences`; the columns are those of `conversation_prefixes`.

    One task merges the open nodes: two keys' prefixes for every range, however many conversations there are.
    """
    spark = units.sparkSession
    units = cut_lineage(units, "trie-sequences")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // KEYS_PER_TASK))
    ordered = units.select("key", "words", "n", "first", "ends").repartitionByRange(tasks, "key").sortWithinPartitions("key")
    nodes = cut_lineage(ordered.mapInArrow(_sorted_nodes, NODE), "trie-nodes")
    merged = cut_lineage(nodes.where("open").repartition(1).mapInArrow(_merged, NODE), "trie-open")
    above = merged.select(F.col("node").alias("of"), F.col("conv_id").alias("of_conv"))
    closed = nodes.where(~F.col("open")).join(above, F.col("parent") == F.col("of"), "left")
    closed = closed.withColumn("parent_conv_id", F.coalesce("of_conv", "parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return closed.unionByName(merged, allowMissingColumns=True).select(*names, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_prefixes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                          shared: bool = False, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """One row per distinct prefix of the conversations of `df`, from the root (depth 0, no turns) on.

    `conv_id` (smallest member), `depth`, `parent_conv_id` (null for the root), `n_convs` (members), `n_children`,
    `n_leaves` (childless nodes in the subtree), `saved_tokens` (over the subtree: (n_convs - 1) times the words of the
    node's last text) and `ends_sha256` (of the ids of members that end here). `shared` rebuilds conversations first,
    see `with_shared_openings`.

    Turns are ordered by `turn`, null first, equal ones by their digests; a null role or text is empty; repeated rows
    are turns of their own; rows without conversation are left out; other columns are ignored whatever their names; an
    empty table has no conversations and no nodes, not even a root. Turns are compared by MD5. The digests of one
    conversation (some 50 bytes a turn, no texts) are one row.
    """
    convs = sequences(df, conv, turn, role, text)
    return prefix_trie(distinct_sequences(with_shared_openings(convs, family, openings) if shared else convs))


PREFIX_SQL = r"""
WITH steps AS (  -- remainders of all bytes for CRC-32, from its polynomial
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
turns AS (
  SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         md5(concat(strlen(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest, words) AS place FROM turns),
bytes AS (
  SELECT c, list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM (SELECT DISTINCT c FROM turns)),
ids AS (
  SELECT c, xor(list_reduce([4294967295] || b, lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 4 AS h FROM bytes, steps),
rebuilt AS (
  SELECT i.c, 0 AS own, t.place, t.digest, t.words FROM ids i JOIN numbered t ON t.c = i.c - i.c % 20 AND t.place <= i.h
  UNION ALL SELECT i.c, 1, t.place, t.digest, t.words FROM ids i JOIN numbered t ON t.c = i.c AND t.place > i.h),
prefixes AS (
  SELECT c, row_number() OVER w AS d, string_agg(digest, '') OVER w AS node, words FROM rebuilt
  WINDOW w AS (PARTITION BY c ORDER BY own, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT node, d, min(c) AS c, count(*) AS n, any_value(words) AS words FROM prefixes GROUP BY node, d),
children AS (SELECT left(node, 32 * (d - 1)::INT) AS parent, count(*) AS children FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(k.children, 0) AS children FROM nodes n LEFT JOIN children k ON n.node = k.parent),
above AS (SELECT left(node, 32 * unnest(range(0, d + 1))::INT) AS node, (n - 1) * words AS saved, (children = 0)::BIGINT AS leaf FROM own),
subtrees AS (SELECT node, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY node),
last AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
ends AS (
  SELECT p.node, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS ends FROM prefixes p JOIN last l ON p.c = l.c AND p.d = l.d GROUP BY p.node)
SELECT o.c AS conv_id, o.d::BIGINT AS depth, p.c AS parent_conv_id, o.n::BIGINT AS n_convs, o.children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM own o JOIN subtrees s ON o.node = s.node LEFT JOIN ends e ON o.node = e.node
LEFT JOIN nodes p ON o.d > 0 AND p.node = left(o.node, 32 * (o.d - 1)::INT)
"""


@query("op11_conversation_prefixes", PREFIX_SQL)
def op11_conversation_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_prefixes(table(spark, sf, "conversations"), shared=True)
