"""All queries of the subpackage, each with the SQL that must give the same rows where SQL can."""

from corpuslake.llm import jaccard, kdsearch, langid, licenses, mixing, packing, prefixes, quality, sharding, spelling, suffixes, urls, winnowing  # noqa: F401
from corpuslake.llm.registry import ORACLES, QUERIES  # noqa: F401
