"""Rows that every operator must take."""

#: Nulls in any column, empty text, ties, repeated rows, non-ASCII letters, one source with most rows.
ODD = [
    (None, None, None, None), (None, "a lone text", "en", None), (1, "", "en", "a"), (2, "same words here", "en", "a"),
    (2, "same words here", "en", "a"), (3, "same words here", None, "b"), (4, "é ü ñ", "fr", "a"), (5, "   ", "de", "a"),
    (6, "x" * 5_000, "en", "a"), (7, "word " * 3_000, "en", "a"), (8, "1234 !!", None, "c"), (9, None, "en", "a"),
]
