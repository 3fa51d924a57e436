"""Removal of repeated passages against brute force, and the parts of the merge sort."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import ODD

import corpuslake.llm.suffixes as suffixes
from corpuslake.llm.suffixes import LENGTH, decoded, front_coded, merged, op10_suffix_array_dedup, remove_repeated, shared


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of every text."""
    starts = Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        starts.update(raw[i:i + LENGTH] for i in range(len(raw) - LENGTH + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - LENGTH + 1):
            if starts[raw[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = True
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghij éü"

    def noise(n):
        return "".join(rng.choices(letters, k=n))

    passages = [noise(n) for n in (199, 200, 201, 260, 700)] + ["ab" * 180, "z" * 450]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 60)
            parts += [noise(rng.randrange(120)), p[cut:] if rng.random() < 0.4 else p[:len(p) - cut] if rng.random() < 0.3 else p]
        texts.append("".join(parts) + noise(rng.randrange(300)))
    texts += [texts[3], texts[3], texts[7][:-5] + "!", "z" * 200, "z" * 199, "tail " + passages[3]]
    return texts


@pytest.mark.parametrize("seed,crowd,run", [(1, 10**6, 10**5), (2, 10**6, 40), (3, 3, 40)])
def test_removed_bytes(make, monkeypatch, seed, crowd, run):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "RUN_ITEMS", run)
    texts = corpus(seed) + [r[1] for r in ODD]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    wanted = brute(texts)
    for r in remove_repeated(make(rows)).collect():
        kept = bytes(r["kept"])
        got = (r["n_bytes"], r["n_bytes"] - len(kept), len(r["spans"]), hashlib.sha256(kept).hexdigest())
        assert got == wanted[r["doc_id"]], (r["doc_id"], got, wanted[r["doc_id"]])
        assert r["kept_text"] == (None if texts[r["doc_id"]] is None else kept.decode("utf-8", "ignore"))


def test_null_keys_repeated_rows_and_empty_tables(make):
    long = "".join(random.Random(9).choices("abcdef ", k=500))
    rows = [*ODD, (None, long, None, None), (None, long, None, None), (77, long[:300], None, None), (78, long[40:239], "en", "a")]
    wanted = Counter(zip((r[0] for r in rows), brute([r[1] for r in rows])))
    odd = make(rows)
    found = remove_repeated(odd)
    assert found.columns == [*odd.columns, "spans", "n_bytes", "kept", "kept_text"]
    got = Counter((r["doc_id"], (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
                  for r in found.collect())
    assert got == wanted
    assert remove_repeated(odd.limit(0)).collect() == []


def test_query_on_the_smallest_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    wanted = dict(zip((r["doc_id"] for r in docs), brute([r["text"] for r in docs])))
    for r in op10_suffix_array_dedup(spark, sf).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == wanted[r["doc_id"]]


def test_front_coding_and_merge():
    rng = random.Random(1)
    items = [("".join(rng.choices("ab", k=rng.randrange(0, 12))).encode(), b"x" * (i % 4), i, -i) for i in range(500)]
    runs = defaultdict(list)
    for item in items:
        runs[rng.randrange(7)].append(item)
    coded = [front_coded(sorted(r)) for r in runs.values()]
    for run, mine in zip(coded, runs.values()):
        assert [x[1:] for x in decoded(run)] == sorted(mine)
    for k in (0, 1, 2, 7):
        last, out = b"", []
        for prefix, suffix, before, text, place in merged([decoded(r) for r in coded[:k]]):
            assert prefix == shared(last, suffix, 0) and last <= suffix
            last = suffix
            out.append((suffix, before, text, place))
        assert sorted(out) == sorted(x for r in list(runs.values())[:k] for x in r)
