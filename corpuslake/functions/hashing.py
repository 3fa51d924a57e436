"""Seeded hashes that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(*parts) -> Column:
    """60-bit number from the MD5 of the parts joined by `|`.

    Used wherever the reference draws random numbers: the value depends on the key and the seed
    only, so retries, lost executors and other partitionings give the same rows.
    """
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
