"""Licence scan, fingerprints, language and quality."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import ODD
from pyspark.sql import functions as F

from corpuslake.llm import langid, quality
from corpuslake.llm.license_rules import build_rules
from corpuslake.llm.licenses import Scanner, op4_license_scan, scan_licenses
from corpuslake.llm.winnowing import K, WINDOW, compare_with_next, fingerprints, op6_winnowing_fingerprints, winnow


def detections(make, *texts):
    found = scan_licenses(make([(i, t, "en", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    return [[(d["label"], d["first_word"], d["last_word"]) for d in r["detections"]] for r in found]


def test_rules_are_many_and_named():
    rules = build_rules()
    assert len(rules) > 300 and all(rule.keywords and "," not in rule.label for rule in rules)
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def variants(parsed):
    """Texts that a pattern matches; every alternative and every optional part occurs in one of them."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts = [chr(value)]
        elif name == "IN":
            parts = [c for k, v in value for c in ([chr(v)] if str(k) == "LITERAL" else [chr(x) for x in range(v[0], v[1] + 1)])]
        elif name == "BRANCH":
            parts = [t for option in value[1] for t in variants(option)]
        elif name == "SUBPATTERN":
            parts = variants(value[3])
        elif name == "MAX_REPEAT":
            assert value[:2] == (0, 1)
            parts = [*variants(value[2]), ""]
        else:
            assert name == "ASSERT"  # the blanks around a rule
            continue
        out = [t + parts[0] for t in out] + [out[0] + p for p in parts[1:]]
    return out


def test_every_alternative_of_every_rule_passes_its_gate():
    rules = build_rules()
    scanner, tried = Scanner(rules), 0
    for rule in rules:
        for text in variants(re._parser.parse(rule.pattern.pattern.decode())):
            words = text.split()
            assert rule.pattern.fullmatch(f" {' '.join(words)} ".encode(), 1, len(" ".join(words)) + 1) or rule.pattern.search(f" {' '.join(words)} ".encode())
            assert rule.keywords & {w.encode() for w in words}, (rule.name, text)
            kept = scanner.detections([w.encode() for w in words])[1]
            assert kept and max(d[5] for d in kept) >= 0.7, (rule.name, text)
            tried += 1
    assert tried > 2_000


@pytest.mark.parametrize("text,label", [
    ("licensed under GPL v2", "gpl-2.0"), ("GPL version 3", "gpl-3.0"), ("under the terms of the LGPL v3", "lgpl-3.0"), ("the GNU AGPL v3", "agpl-3.0"),
    ("licensed under the PSF license", "psf"), ("licensed under CC BY-SA 4.0", "cc-by-sa"), ("CC-BY 4.0", "cc-by"),
    ("The above copyright notice and this permission notice shall be included in all copies", "mit"),
    ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", "apache-2.0"),
    ("This work is dedicated to the public domain", "public-domain")])
def test_usual_mentions(make, text, label):
    assert label in {d[0] for d in detections(make, text)[0]}


def test_overlapping_detections_are_resolved(make):
    got = detections(
        make, "Released under the MIT License.", "under the terms of the GNU Lesser General Public License v2.1, see the GNU General Public License",
        "licensed under the Apache License, Version 2.0 (the thing)", "SPDX-License-Identifier: BSD-3-Clause", "no rights here", None)
    assert got[0] == [("mit", 0, 4)]
    assert [d[0] for d in got[1]] == ["lgpl-2.1", "gpl"]
    assert got[2] == [("apache-2.0", 0, 7)]
    assert [d[0] for d in got[3]] == ["bsd-3-clause"]
    assert got[4] == got[5] == []


def test_license_columns_against_plain_python(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in op4_license_scan(spark, sf).collect():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if tuple(words[i:i + len(phrase)]) == phrase]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) | set()
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])


def test_license_scan_of_odd_and_empty_tables(make):
    odd = make(ODD)
    rows = scan_licenses(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert scan_licenses(odd.limit(0)).collect() == []
    many = make([(1, "mit license " * 20_000, "en", "a")])
    row = scan_licenses(many).first()
    assert len(row["base"]) == 20_000 and row["base"][-1]["first_word"] == 39_998


def slow_winnow(text, k, window):
    """Rightmost smallest hash of every window, with the hashes that `winnow` itself gives for single grams."""
    if not text:
        return []
    k = min(k, len(text))
    hashes = [int(winnow(text[i:i + k], k, 1)[0]) >> 32 for i in range(len(text) - k + 1)]
    window, chosen = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        best = min(range(i, i + window), key=lambda j: (hashes[j], -j))
        if not chosen or chosen[-1] != (hashes[best], best):
            chosen.append((hashes[best], best))
    return chosen


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog, the quick brown fox", "日本語テキスト😀" * 5])
@pytest.mark.parametrize("k,window", [(3, 4), (5, 2), (7, 6), (32, 64)])
def test_winnowing_against_its_definition(text, k, window):
    got = [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in winnow(text, k, window)]
    assert got == slow_winnow(text, k, window)


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(3)
    letters = "abcdefgh "
    for _ in range(50):
        passage = "".join(rng.choices(letters, k=K + WINDOW - 1))
        a, b = (f"{''.join(rng.choices(letters, k=rng.randrange(300)))}{passage}{''.join(rng.choices(letters, k=rng.randrange(300)))}" for _ in "ab")
        assert len(np.intersect1d(winnow(a) >> np.uint64(32), winnow(b) >> np.uint64(32)))


def next_by_hand(rows):
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    texts = [t for _, _, t in order]
    keys = [k if known else None for known, k, _ in order]
    return [(keys[i], texts[i], texts[(i + 1) % len(texts)]) for i in range(len(texts))]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [(i, f"text {i} " * (i % 40), "en", "a") for i in range(700)]])
def test_edited_texts(make, rows):
    got = compare_with_next(make(rows)).collect()
    wanted = []
    for key, text, following in next_by_hand(rows):
        half = len(text) // 2
        wanted.append((key, len(text), hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_fingerprint_query(spark, sf, make):
    rows = op6_winnowing_fingerprints(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert r["fingerprint"] == "".join(f"{int(x):016x}" for x in winnow(texts[r["doc_id"]]))
    assert compare_with_next(make(ODD).limit(0)).collect() == []
    marks = fingerprints(make(ODD)).where("doc_id = 7").first()["fingerprint"]
    assert [(m["hash"], m["position"]) for m in marks] == slow_winnow("word " * 3_000, K, WINDOW)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held_out = langid.remainder("doc_id", 4) == 2
    model = langid.train(docs, ~held_out)
    assert model.families == ["germanic", "romance"]
    found = langid.identify(docs, model).where(held_out).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) and all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_and_empty_tables(make):
    odd = make(ODD)
    model = langid.train(odd, F.lit(True))
    rows = langid.identify(odd, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    for r in rows:
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and r["lang_pred"] in ("und", "en", "fr")
    assert langid.train(odd.limit(0), F.lit(True)) is None
    assert langid.identify(odd.limit(0), None).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_digits_and_fractions_are_no_letters(make):
    model = langid.train(make(ODD), F.lit(True))
    rows = langid.identify(make([(1, "² ½ Ⅷ ٣", None, "a"), (2, "ª", None, "a"), (3, "字", None, "a")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in rows} == {1: True, 2: False, 3: False}


def plain_language(model, x):
    """The vote of the machines, row by row: family first, then the language within it."""
    def vote(names):
        if len(names) == 1:
            return names[0]
        wins = {n: [0, 0.0] for n in names}
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                weights = model.machines[a, b]
                margin = sum(float(v) * float(w) for v, w in zip(weights[:-1], x)) + float(weights[-1])
                wins[a if margin >= 0 else b][0] += 1
                wins[a][1] += margin
                wins[b][1] -= margin
        return max(names, key=lambda n: (wins[n][0], wins[n][1]))

    return vote(model.languages[vote(model.families)])


def test_language_against_a_plain_vote(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, langid.remainder("doc_id", 4) != 2)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.op5_hierarchical_langid(spark, sf).collect():
        text = texts[r["doc_id"]]
        wanted = plain_language(model, langid.features(text)) if any(c.isalpha() for c in text) else "und"
        assert r["lang_pred"] == wanted and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_of_held_out_documents(spark, sf):
    folder = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held_out = quality.remainder("doc_id", 5) == 0
    model = quality.train(docs, labels, ~held_out)
    found = quality.score_quality(docs.where(held_out), model).join(labels, "doc_id").select("quality", "score").collect()
    good, bad = [r["score"] for r in found if r["quality"]], [r["score"] for r in found if not r["quality"]]
    ranked = np.mean([np.mean([(g > b) + 0.5 * (g == b) for b in bad]) for g in good])
    assert ranked > 0.9
    assert np.mean([(r["score"] >= quality.THRESHOLD) == bool(r["quality"]) for r in found]) > 0.9


def test_quality_of_odd_and_empty_tables(spark, make):
    odd = make(ODD)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 0, 0), (3, 1, None), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels, F.lit(True))
    rows = quality.score_quality(odd, model, out="row").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD) and all(0 <= r["row"] <= 1 for r in rows)
    assert quality.train(odd, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.score_quality(odd, None).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), model).collect() == []


def test_attention_gradient():
    """One step of training lowers the loss on a separable toy: one bad passage makes a bad document."""
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(200):
        bag = rng.normal(0, 0.1, (rng.integers(1, 6), quality.WIDTH)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), :8] += 1
        bags.append(bag)
        labels.append(float(i % 2))
    model = quality.fit(bags, np.array(labels), epochs=30)
    scores = model.score(np.concatenate(bags), np.array([len(b) for b in bags]))
    assert np.mean((scores > 0.5) == np.array(labels, dtype=bool)) > 0.97
