"""Conversation prefixes against a plain trie, at ranges of one key and of many, and on odd tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpuslake.llm import prefixes
from corpuslake.llm.prefixes import RangeMinimum, conversation_prefixes, op11_conversation_prefixes

FIELDS = "conv_id long, turn long, role string, text string, depth string, node string, n string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def digest(turn):
    role, text = turn
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def sequences(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            turns[conv].append(((turn is not None, turn or 0), digest(said), said))
    return {c: [said for _, _, said in sorted(v)] for c, v in turns.items()}


def rebuilt(convs, family=20):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, family))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def by_hand(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (words(node[-1][1]) if node else 0)
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, who in members.items())


def got(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in frame.collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FIELDS)


ROWS = (
    [(c, t, "user" if t % 2 else "system", "same opening" if t < 3 else f"own {c} {t}") for c in range(60) for t in range(c % 6)]
    + [(100 + c, t, "user", f"copy {t}") for c in range(50) for t in range(3)]
    + [(200, None, "user", "without a number"), (200, 0, None, None), (200, 0, None, None), (200, 1, "user", ""), (None, 0, "user", "lost"),
       (-25, 0, "user", "same opening"), (-20, 0, "user", "negative"), (300, 0, "a", "bc"), (301, 0, "ab", "c"), (302, 5, "u", "word " * 20_000)]
)


def test_range_minimum():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        values = rng.integers(0, 6, n)
        table = RangeMinimum(values)
        pairs = [(a, b) for a in range(n) for b in range(a, n)]
        left, right = (np.array(x) for x in zip(*pairs))
        assert table.least(left, right).tolist() == [values[a:b + 1].min() for a, b in pairs]
        start, floor = (np.array(x) for x in zip(*[(a, f) for a in range(n) for f in range(7)]))
        ends = []
        for a, f in zip(start, floor):
            r = a
            while r + 1 < n and values[r + 1] >= f:
                r += 1
            left_end = a
            while left_end > 0 and values[left_end] >= f:
                left_end -= 1
            ends.append((r, left_end))
        assert list(zip(table.last_right(start, floor).tolist(), table.first_left(start, floor).tolist())) == ends


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_every_prefix(spark, partitions):
    """With 40 ranges most hold a key or two, so nearly all nodes are merged across ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = frame_of(spark, ROWS)
        assert got(conversation_prefixes(frame)) == by_hand(sequences(ROWS))
        assert got(conversation_prefixes(frame, shared=True)) == by_hand(rebuilt(sequences(ROWS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS_PER_ROW", 7)
    rows = [(c, 0, "user", "copy") for c in range(-30, 90)]
    assert got(conversation_prefixes(frame_of(spark, rows))) == by_hand(sequences(rows))


def test_no_turns_and_no_rows(spark):
    rows = [(c, 0, "user", f"t{c}") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]  # all lose their only turn
    out = got(conversation_prefixes(frame_of(spark, rows), shared=True))
    assert out == by_hand(rebuilt(sequences(rows))) and len(out) == 1
    assert conversation_prefixes(frame_of(spark, rows).limit(0)).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_prefixes(spark, sf)) == by_hand(rebuilt(sequences(rows)))
