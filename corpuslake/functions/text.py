"""Column expressions over text. Everything stays in the JVM except `normalize_text`."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslake.functions.wordlists import ENGLISH_WORDS, QUERY_TEMPLATE, WHITESPACE

# Fixed value: ASCII symbols that are isolated like punctuation.
TOKEN_PATTERN = r"(?U)[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove all Unicode whitespace at both ends (`trim` alone removes spaces only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip_ws(c), F.lit("")) == ""


def filled(c: Column | str) -> Column:
    """The value as a string, with the empty string counted as missing."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def first_nonempty(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def first_long(columns: list[Column | str], min_len: int = 50) -> Column:
    """First value longer than `min_len`; shorter ones fall through."""
    texts = [col(c).cast("string") for c in columns]
    return F.coalesce(*[F.when(F.length(t) > min_len, t) for t in texts])


def long_values(columns: list[Column | str], min_len: int = 50) -> Column:
    texts = F.array(*[col(c).cast("string") for c in columns])
    return F.filter(texts, lambda t: F.length(t) > min_len)


def concat_nonblank(columns: list[Column | str], sep: str = " ") -> Column:
    """Unstripped values joined by `sep`, blank ones left out; all blank gives the empty string."""
    return F.concat_ws(sep, *[F.when(~is_blank(col(c).cast("string")), col(c).cast("string")) for c in columns])


def fill_template(template: str, **values: Column) -> Column:
    """Template with `{name}` slots, built by concatenation so that braces in the text are harmless."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece:
            slot = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
            parts.append(values[slot] if slot in values else F.lit(piece))
    return F.concat(*parts)


def query_text(query: Column | str, instruction: Column | str, template: str = QUERY_TEMPLATE) -> Column:
    prompt = fill_template(template, instruction=col(instruction), query=col(query))
    return F.when(col(instruction).isNotNull(), prompt).otherwise(col(query))


def instruction_text(instruction: Column, context: Column, response: Column) -> Column:
    """One chat sample; a blank context is left out, prompt and response are stripped."""
    instruction, response = F.coalesce(instruction, F.lit("")), F.coalesce(response, F.lit(""))
    with_context = F.concat(instruction, F.lit("\n\nContext:\n"), context)
    prompt = F.when(is_blank(context), instruction).otherwise(with_context)
    return F.concat(F.lit("<s>[INST] "), strip_ws(prompt), F.lit(" [/INST] "), strip_ws(response), F.lit(" </s>"))


def page_url(title: Column | str, url: Column | str | None = None,
             base: str = "https://en.wikipedia.org/wiki/") -> Column:
    made = F.concat(F.lit(base), F.replace(col(title), F.lit(" "), F.lit("_")))
    return made if url is None else F.coalesce(col(url), made)


def ascii_ratio(c: Column | str) -> Column:
    """Share of ASCII characters; texts without multi-byte characters skip the regular expression."""
    text = col(c)
    kept = F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))
    return F.when(F.octet_length(text) == F.length(text), F.lit(1.0)).otherwise(kept / F.length(text))


def is_likely_english(c: Column | str, min_ascii_ratio: float = 0.85, head: int | None = None) -> Column:
    """Short or missing text passes; longer text needs ASCII and a common English word.

    The word may stand anywhere, or in the first `head` characters if that is given.
    """
    text = col(c)
    short = text.isNull() | (F.length(text) < 20)
    word = (text if head is None else F.substring(text, 1, head)).rlike(r"(?iU)\b(" + "|".join(ENGLISH_WORDS) + r")\b")
    return short | (word & (ascii_ratio(text) >= min_ascii_ratio))


def fold(text: str) -> str:
    """Decompose, lower-case character by character, drop accents."""
    lowered = unicodedata.normalize("NFD", text).replace("Σ", "σ").lower()
    return lowered if lowered.isascii() else "".join(c for c in lowered if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def normalize_text(c: Column | str) -> Column:
    """NFD, lower case, no accents. Spark has no Unicode normaliser, hence Arrow batches, but only for texts that are
    not plain ASCII: the others are null to Python and lower-cased in the JVM."""
    text = col(c)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(_folded(F.when(~plain, text)))


def explode_values(df: DataFrame, values: Column, name: str, *keep: Column | str) -> DataFrame:
    """One row per non-null element of an array.

    The outer form keeps Catalyst from adding a filter on the array's size below the generator,
    which would compute the array twice. Whatever else the rows need has to be a column already:
    an expression over the array next to the generator would copy the array into every row.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def pretokenize(c: Column | str) -> Column:
    """Words between whitespace, with every punctuation character on its own."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN_PATTERN), F.lit(0))
