"""Registered queries, each with the SQL that must give the same rows."""

from corpuslake.catalog import corpus, encoding, evaluation, pairs, sources, streams, texts  # noqa: F401
from corpuslake.catalog.registry import ORACLES, QUERIES  # noqa: F401
