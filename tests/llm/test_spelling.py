"""Spelling variants against all pairs of words, and on odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from samples import ODD

from corpuslake.llm.spelling import count_words, group_variants, long_neighbours, op12_spelling_variants, spelling_variants, trie_neighbours


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(counts, ratio=5):
    found = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(found[w]), None if form[w] is None else counts[form[w]]))
    return sorted(out)


def runs(rows, typo=None):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if typo and h % typo == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def some_words():
    rng = random.Random(5)
    letters = "abé×"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(250)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "x" * 60, "x" * 61, "x" * 60 + "y", "y" + "x" * 60, "x" * 30 + "z" + "x" * 29}
    return {w: 5 ** rng.randint(0, 6) for w in sorted(words)}


@pytest.mark.parametrize("longest", [40, 7])
def test_neighbours_forms_and_roots(spark, longest):
    """With 7, most words take the way of the long ones."""
    counts = some_words()
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = rows_of(group_variants(frame, longest=longest))
    assert out == by_hand(counts) and max(r[4] for r in out) > 3 and any(r[1] != r[2] for r in out if r[1])
    both = [f(frame, longest).collect() for f in (trie_neighbours, long_neighbours)]
    assert not {tuple(r) for r in both[0]} & {tuple(r) for r in both[1]}


def test_counts_and_typos(spark, make):
    texts = [(1, "Ünder ÄNDERUNG Strasse-straße ÷×÷ naïveté", "de", "a"), (2, "Łódźiana résumé’s 漢字kanjis", "pl", "a")]
    texts += [(i, "wording words reword " * 3, "en", "b") for i in range(400)] + ODD
    frame = make(texts, extra="word string, n string, form string, root string")
    for typo in (None, 7, 199):
        assert {r["word"]: r["n"] for r in count_words(frame, typo=typo).collect()} == runs([r[:2] for r in texts], typo)
    counts = {w: n for w, n in runs([r[:2] for r in texts], 7).items() if n >= 5}
    assert rows_of(spelling_variants(frame, typo=7)) == by_hand(counts)
    assert spelling_variants(frame.limit(0)).collect() == []
    assert spelling_variants(make([(1, None, None, None), (2, "", None, None)])).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = {w: n for w, n in runs(rows, 199).items() if n >= 5}
    assert rows_of(op12_spelling_variants(spark, sf)) == by_hand(counts)
