"""Filters, fields, formatting and chunks against plain Python models."""

import re
import unicodedata

from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions import wordlists as w
from corpuslake.operators.chunking import chunk_text
from corpuslake.operators.entities import classify_entity_page
from corpuslake.operators.fields import (
    concat_nonempty_fields, explode_long_fields, first_long_field, first_nonempty_field, format_instruction, format_query,
    turns_to_samples)
from corpuslake.operators.filters import filter_english, long_enough, min_length


def texts(spark, values, name="text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"doc_id bigint, {name} string")


def test_english_keeps_three_of_five(spark):
    rows = texts(spark, [
        "This is a normal English sentence about finance and investments.",
        "这是一个关于金融和投资的中文句子，不应该被保留下来。",
        "The company reported strong earnings for the fourth quarter.",
        "これは金融と投資に関する日本語の文章です。保持されるべきではありません。",
        "Revenue growth exceeded expectations with a significant margin improvement for all.",
    ])
    assert [r.doc_id for r in filter_english(rows).orderBy("doc_id").collect()] == [0, 2, 4]


def test_english_model(spark, docs):
    pattern = re.compile(r"\b(" + "|".join(w.ENGLISH_WORDS) + r")\b", re.IGNORECASE)

    def model(text):
        if not text or len(text) < 20:
            return True
        ratio = sum(ord(c) < 128 for c in text) / len(text)
        return ratio >= 0.85 and bool(pattern.search(text[:500]))

    extra = texts(spark, ["", None, "x" * 19, "x" * 20, "THE é" + "a" * 30, "the" + "é" * 40, "a" * 498 + " the", "theatre " * 5])
    rows = docs.select("doc_id", "text").unionByName(extra)
    for r in rows.select("text", tx.is_likely_english("text", head=500).alias("keep")).collect():
        assert r.keep == model(r.text), r.text


def test_strip_uses_unicode_whitespace(spark):
    rows = texts(spark, ["  a ", "\x1c\n", " b c "])
    assert [r.s for r in rows.orderBy("doc_id").select(tx.strip_ws("text").alias("s")).collect()] == ["a", "", "b c"]


def test_first_field_does_not_fall_through_but_long_field_does(spark):
    rows = spark.createDataFrame([(1, "short", "x" * 60), (2, "", "y" * 60), (3, None, None)], "id int, title string, text string")
    assert [r.id for r in first_nonempty_field(rows, ["title", "text"], "t", 20).collect()] == [2]
    assert sorted(r.id for r in first_long_field(rows, ["title", "text"], 50, "t").collect()) == [1, 2]


def test_explode_and_concat_fields(spark):
    rows = spark.createDataFrame([(1, "a" * 51, "b" * 50, "c" * 52)], "id int, title string, description string, text string")
    out = explode_long_fields(rows, ["title", "description", "text"], 50, "chosen").orderBy("field_no").collect()
    assert [(r.field_no, r.chosen[0]) for r in out] == [(0, "a"), (1, "c")]
    blank = spark.createDataFrame([("  ", None, " x "), ("", " ", None)], "a string, b string, c string")
    assert [r.j for r in concat_nonempty_fields(blank, ["a", "b", "c"], "j").collect()] == [" x ", ""]


def test_instruction_goldens(spark):
    def one(columns, row):
        return format_instruction(spark.createDataFrame([row], columns)).first().text

    ddl = "instruction string, context string, response string"
    assert one(ddl, ("Summarize", "Some text", " Done ")) == "<s>[INST] Summarize\n\nContext:\nSome text [/INST] Done </s>"
    assert one(ddl, ("Summarize", "   ", "Done")) == "<s>[INST] Summarize [/INST] Done </s>"
    assert one("instruction string, input string, output string", ("Add", "1+1", "2")) == "<s>[INST] Add\n\nContext:\n1+1 [/INST] 2 </s>"
    # the column is chosen by existence: an empty `response` hides `output`
    assert one("instruction string, response string, output string", ("Q", "", "A")) == "<s>[INST] Q [/INST]  </s>"


def test_query_format_ignores_braces_in_text(spark):
    rows = spark.createDataFrame([("a {query} b", "do {it}"), ("plain", None)], "query string, instruction string")
    out = [r.query_text for r in format_query(rows).collect()]
    assert out == ["Instruct: do {it}\nQuery: a {query} b", "plain"]


def test_turns_use_latest_system_text(spark):
    rows = spark.createDataFrame(
        [(1, 0, "system", "S"), (1, 1, "user", "U1"), (1, 2, "assistant", "A1"), (1, 3, "user", "U2"), (2, 0, "user", "x")],
        "conv_id long, turn long, role string, text string")
    assert [r.text for r in turns_to_samples(rows).collect()] == ["<s>[INST] U1\n\nContext:\nS [/INST] A1 </s>"]


def test_turns_of_long_conversations(spark):
    roles = ["user", "assistant", "user", "system", "user", "assistant", "assistant"]
    rows = [(c, t, roles[(t * t + t // 5) % 7] if t > 2 else None, f"{c}.{t}" if t % 11 else None)
            for c, n in ((1, 400), (2, 3), (3, 90), (None, 120)) for t in range(n)]
    rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    plain = sorted(turns_to_samples(rows).collect(), key=str)
    assert len(plain) > 50 and sorted(turns_to_samples(rows, hot_rows=50).collect(), key=str) == plain
    assert sorted(turns_to_samples(rows, hot_rows=0).collect(), key=str) == plain
    assert turns_to_samples(rows.limit(0), hot_rows=0).count() == 0


def test_length_variants(spark):
    rows = texts(spark, ["x" * n for n in (19, 20, 21, 50, 51, 99, 100, 101)])
    def lengths(kind, variant):
        return [len(r.text) for r in min_length(rows, kind, variant).orderBy("doc_id").collect()]
    assert lengths("finance", "loader")[0] == 21 and lengths("finance", "tokenizer")[0] == 20
    assert lengths("ecommerce", "loader")[0] == 51 == lengths("ecommerce", "tokenizer")[0]
    assert lengths("generic", "loader") == [101] and lengths("generic", "tokenizer") == [100, 101]
    assert lengths("wiki", "loader") == [100, 101]
    assert rows.select(F.count_if(long_enough("text", "cache")).alias("n")).first().n == 6


def model_chunks(text, inclusive):
    if len(text) <= 5000:
        return [text]
    pieces = [text[i:i + 2500] for i in range(0, len(text), 2000)]
    return [p for p in pieces if (len(p) >= 200 if inclusive else len(p) > 200)]


def test_chunks_match_the_model(spark):
    base = "".join(chr(97 + i % 26) for i in range(30_000))
    values = [base[:n] for n in (10, 5000, 5001, 6200, 6201, 8199, 8200, 8201, 12_345)] + ["😀é" * 3000]
    rows = texts(spark, values)
    for variant in ("loader", "tokenizer"):
        got = {}
        for r in chunk_text(rows, variant).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, value in enumerate(values):
            assert [r.text for r in got[i]] == model_chunks(value, variant == "tokenizer"), (variant, len(value))
            assert all(value[r.char_start:r.char_start + len(r.text)] == r.text for r in got[i])
    # a tail of exactly 200 characters is kept by the tokenizer only
    tail = texts(spark, [base[:6200]])
    assert chunk_text(tail, "tokenizer").count() - chunk_text(tail, "loader").count() == 1


def model_page(title, text, categories=None):
    low = title.lower()
    if title.startswith(w.NAMESPACE_PREFIXES):
        return "namespace"
    if "(disambiguation)" in low:
        return "disambiguation"
    if low.startswith(w.LIST_PREFIXES):
        return "list_page"
    if re.match(w.YEAR_PATTERN, title) or re.match(w.DECADE_PATTERN, title) or re.match(w.CENTURY_PATTERN, title, re.I):
        return "date_title"
    if low.split() and low.split()[0] in w.MONTHS:
        return "month_title"
    if len(text) < 1000:
        return "short"
    cats = [c.lower() for c in categories] if categories else [
        c.strip().lower() for c in re.findall(r"Category:([^\]\n]+)", text[-2000:], re.I)]
    if any(k in c for c in cats for k in w.OTHER_CATEGORIES):
        return "other_category"
    if any(k in c for c in cats for k in w.BUSINESS_CATEGORIES):
        return "business_category"
    intro = text[:800].lower()
    for name, phrases in (("other_intro", w.OTHER_INTROS), ("business_intro", w.BUSINESS_INTROS), ("stock_intro", w.STOCK_INTROS)):
        if any(p in intro for p in phrases):
            return name
    return "no_signal"


PAGES = [
    ("User:Ann", "x" * 1500, None), ("Acme (Disambiguation)", "x" * 1500, None), ("History of steel", "x" * 1500, None),
    ("1995", "x" * 1500, None), ("1990s", "x" * 1500, None), ("21ST Century fox", "x" * 1500, None), ("May 4", "x" * 1500, None),
    ("Maybe", "x" * 999, None), ("Maybe", "x" * 1500, None), ("   ", "x" * 1500, None),
    ("Acme", "y" * 1500 + "[[Category:Software companies]]", None),
    ("Acme", "y" * 1500 + "[[category: 1950 Births ]]", None),
    ("Acme", "y" * 1500 + "[[Category:Companies based in the United States]]", None),
    ("Acme", "Category:Banks]" + "y" * 2500, None),                      # too far from the end
    ("Acme", "y" * 1500 + "[[Category:Births]]", ["Retailers of Spain"]),  # the given list wins
    ("Acme", "y" * 1500 + "[[Category:Banks]]", []),                      # an empty list counts as missing
    ("Acme", "Acme is a company." + "y" * 1500, None), ("Acme", "Acme is a company; it was a mill." + "y" * 1500, None),
    ("Acme", "Shares: NYSE: ACM " + "y" * 1500, None), ("Acme", "z" * 801 + "is a company" + "y" * 500, None),
    ("user:lower", "Acme is a company." + "y" * 1500, None),
]


def test_page_rules_match_the_model(spark):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PAGES)], "doc_id int, title string, text string, categories array<string>")
    got = {r.doc_id: r.reason for r in classify_entity_page(rows, head=800, tail=2_000).collect()}
    for i, page in enumerate(PAGES):
        assert got[i] == model_page(*page), page


def test_whole_word_option_accepts_the_united_states(spark):
    rows = spark.createDataFrame([("Acme", "y" * 1500 + "[[Category:Companies of the Prestates]]")], "title string, text string")
    assert classify_entity_page(rows).first().reason == "other_category"
    assert classify_entity_page(rows, whole_word=True).first().reason == "business_category"


def test_normalise_and_split_agree_with_python(spark, docs):
    samples = ["Ünïcödé ÉTÉ", "a≠b", "ΑΣ ΣΑΣ", "x.y,z $5 <b> `q` €9", "İstanbul", "em space nbsp", "tab\tnew\nline", "--a__b--", ""]

    def punct(c):
        return unicodedata.category(c).startswith("P") or c in "$+<=>^`|~"

    def model(text):
        out, word = [], ""
        for c in text:
            if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
                out, word = out + [word] * bool(word), ""
            elif punct(c):
                out, word = out + [word] * bool(word) + [c], ""
            else:
                word += c
        return out + [word] * bool(word)

    rows = docs.select("doc_id", "text").unionByName(texts(spark, samples))
    for r in rows.select("text", tx.normalize_text("text").alias("n"), tx.pretokenize("text").alias("p")).collect():
        folded = "".join(c for c in unicodedata.normalize("NFD", r.text).replace("Σ", "σ").lower() if unicodedata.category(c) != "Mn")
        assert r.n == folded
        assert r.p == model(r.text)
