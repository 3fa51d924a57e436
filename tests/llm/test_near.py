"""Jaccard join and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from samples import ODD

import corpuslake.llm.jaccard as jaccard
from corpuslake.llm.graph import components
from corpuslake.llm.jaccard import keep_one, least_matches, near_duplicates, shingles, signature, survivors


def grams(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, class_id, n_links) of every row."""
    sets, n = [grams(r[1]) for r in rows], len(rows)
    texts, root, links = [r[1] or "" for r in rows], list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], least.get(find(i)), links[i]) for i, r in enumerate(rows))


def family(rng, size, words, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def corpus(seed, sizes):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{t} {passage}" if i % 3 else t for i, t in enumerate(t for s in sizes for t in family(rng, s, 120, 4))]
    texts += [" ".join(f"u{rng.randrange(10**7)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rng.shuffle(texts)
    return [(1_000 - i, t, "en", "a") for i, t in enumerate(texts)]


@pytest.mark.parametrize("paired,block", [(32, 256), (3, 8)])
def test_links_and_classes(make, monkeypatch, paired, block):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(5, [1, 2, 3, 5, 40, 25]) + ODD
    got = near_duplicates(make(rows)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)


def test_one_document_of_each_group_stays(make):
    rows = corpus(6, [2, 4, 9]) + ODD
    frame = make(rows)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    groups = {}
    for r in near_duplicates(frame).collect():
        groups.setdefault((r["class_id"], None if r["class_id"] is not None else r["text_key"]), []).append(r["doc_id"])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k in groups)


def test_empty_table(make):
    empty = make(ODD).limit(0)
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 60), (60, 55), (70, 50)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_shingles_agree_with_python():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("ab é\t\n\x0b x", k=rng.randrange(80)))
        assert len(shingles(text)) == len(grams(text))
    assert (shingles("a b c d e f") == shingles(" a\tb c\nd  e f ")).all()


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(4)
    kept = 0
    for share in (0.8, 0.85, 0.95):
        for _ in range(40):
            both = rng.integers(0, 1 << 62, int(400 * share), dtype=np.uint64)
            rest = rng.integers(0, 1 << 62, (2, (400 - len(both)) // 2), dtype=np.uint64)
            a, b = (signature(np.concatenate([both, r])).astype(np.uint8)[None] for r in rest)
            kept += len(survivors(a, b))
    assert kept == 120
    far = [signature(rng.integers(0, 1 << 62, 300, dtype=np.uint64)).astype(np.uint8)[None] for _ in range(40)]
    assert sum(len(survivors(far[i], far[i + 1])) for i in range(39)) == 0
    assert 0 < least_matches(40) < least_matches(200) < 160
