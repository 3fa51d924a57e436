"""Is a page about a company, an organisation or a product?"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import wordlists as w
from corpuslake.functions.text import strip_ws
from corpuslake.functions.vectors import let

MIN_PAGE_CHARS = 1_000
KEEP_REASONS = ("business_category", "business_intro", "stock_intro")


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _quote(words: Iterable[str], whole_word: bool) -> str:
    body = "|".join(r"\Q" + word + r"\E" for word in words)
    return rf"(?U)\b(?:{body})\b" if whole_word else body


def page_categories(text: Column, given: Column | None = None, tail: int | None = None) -> Column:
    """Lower-case categories: the given list, or the links in the text (in its last `tail` characters if that is given)."""
    tail = text if tail is None else F.right(text, F.lit(tail))
    found = F.regexp_extract_all(tail, F.lit(r"(?i)Category:([^\]\n]+)"), F.lit(1))
    found = F.transform(found, lambda c: F.lower(strip_ws(c)))
    if given is None:
        return found
    listed = F.transform(given, lambda c: F.lower(c))
    return F.when(F.size(given) > 0, listed).otherwise(found)


def entity_rule(title: Column, text: Column, given: Column | None = None, whole_word: bool = False,
                head: int | None = None, tail: int | None = None) -> Column:
    """Name of the first rule that decides: cheap tests first, no UDF.

    Phrases are looked for in the whole text or its first `head` characters, categories in the whole text or its last
    `tail` characters.

    Categories and the opening are bound with `let`, so that each is computed once per page that
    gets that far, however many words are looked for in it.
    """
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    low = F.lower(title)
    first_word = F.regexp_extract(low, r"(?U)^\s*(\S+)", 1)

    def first_of(rules: list[tuple[str, Column]], rest: Column) -> Column:
        chain = F.when(rules[0][1], rules[0][0])
        for name, test in rules[1:]:
            chain = chain.when(test, name)
        return chain.otherwise(rest)

    def by_intro(intro: Column) -> Column:
        phrases = (("other_intro", w.OTHER_INTROS), ("business_intro", w.BUSINESS_INTROS), ("stock_intro", w.STOCK_INTROS))
        return first_of([(name, _any(intro.contains(p) for p in listed)) for name, listed in phrases], F.lit("no_signal"))

    def by_category(categories: Column) -> Column:
        def holds(words: Iterable[str]) -> Column:
            return F.exists(categories, lambda c: c.rlike(_quote(words, whole_word)))

        tests = [("other_category", holds(w.OTHER_CATEGORIES)), ("business_category", holds(w.BUSINESS_CATEGORIES))]
        return first_of(tests, let(F.lower(text if head is None else F.substring(text, 1, head)), by_intro))

    return first_of([
        ("namespace", _any(title.startswith(p) for p in w.NAMESPACE_PREFIXES)),
        ("disambiguation", low.contains("(disambiguation)")),
        ("list_page", _any(low.startswith(p) for p in w.LIST_PREFIXES)),
        ("date_title", _any(title.rlike(p) for p in (w.YEAR_PATTERN, w.DECADE_PATTERN, "(?iU)" + w.CENTURY_PATTERN))),
        ("month_title", first_word.isin(*w.MONTHS)),
        ("short", F.length(text) < MIN_PAGE_CHARS),
    ], let(page_categories(text, given, tail), by_category))


def classify_entity_page(df: DataFrame, whole_word: bool = False, head: int | None = None, tail: int | None = None) -> DataFrame:
    """Add `reason` and `keep`; `categories` is used when the column exists."""
    given = F.col("categories") if "categories" in df.columns else None
    rows = df.withColumn("reason", entity_rule(F.col("title"), F.col("text"), given, whole_word, head, tail))
    return rows.withColumn("keep", F.col("reason").isin(*KEEP_REASONS))


def filter_entity_pages(df: DataFrame, whole_word: bool = False, head: int | None = None, tail: int | None = None) -> DataFrame:
    return classify_entity_page(df, whole_word, head, tail).where("keep").drop("keep", "reason")
