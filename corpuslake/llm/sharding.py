"""Operator 2, proportional stratified interleaving into shards. DataFrame functions only.

Rows are put in a seeded random order inside each source; the r-th of n rows of a source gets the
fractional rank (r - 1/2) / n. Sorting all rows by fractional rank interleaves the sources in
proportion to their sizes, so every run of consecutive rows has the mixture of the whole table, and
cutting the order into equal runs gives the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import before, bucket_of, buckets_for, draw, replacing, same, text_of, unit
from corpuslake.session import cut_lineage

SEED = "shards-1"
SHARDS = 8


def interleaved_shards(df: DataFrame, shards: int = SHARDS, seed: str = SEED, key: str = "doc_id", text: str = "text",
                       source: str = "source") -> DataFrame:
    """Every row of `df` with `shard` (0-based) and `slot` (gapless from 0 inside the shard).

    Law: the row counts of two shards differ by one at most, and so do the counts of a source in two
    shards up to the rounding of its share. Equal texts are not kept together: with equal counts they
    cannot be. A null source is a source of its own; null keys and texts take part like any value;
    repeated rows are dealt like different rows; an empty table gives an empty result; input columns
    named `shard` or `slot` are replaced.

    No group is sorted in one task: a source is ranked in hash buckets and the interleaved order in
    buckets of the fractional rank, each with the number of rows in the buckets before it.
    """
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(source).alias("source"),
                     draw(seed, key, text).alias("digest"))
    rows = cut_lineage(rows, "shard-rows")
    total = rows.count()
    buckets = buckets_for(total)
    rows = rows.withColumn("part", bucket_of(unit(F.col("digest")), buckets))

    parts = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = before(parts, ["source"], "part", "n", "ahead")
    parts = parts.withColumn("of", F.sum("n").over(Window.partitionBy("source")))
    parts = cut_lineage(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "ahead", "of"), "shard-parts")
    ranked = rows.join(parts, same(rows, parts, [("source", "s"), ("part", "p")])).drop("s", "p")
    inside = Window.partitionBy("source", "part").orderBy("digest")
    rank = F.col("ahead") + F.row_number().over(inside)
    ranked = ranked.withColumn("fraction", (rank - F.lit(0.5)) / F.col("of"))
    ranked = cut_lineage(ranked.select("row", "digest", "fraction"), "shard-ranks")

    placed = ranked.withColumn("run", bucket_of(F.col("fraction"), buckets))
    runs = before(placed.groupBy("run").agg(F.count(F.lit(1)).alias("n")), [], "run", "n", "ahead")
    runs = cut_lineage(runs.select(F.col("run").alias("r"), "ahead"), "shard-runs")
    placed = placed.join(runs, placed["run"] == runs["r"]).drop("r")
    index = F.col("ahead") + F.row_number().over(Window.partitionBy("run").orderBy("fraction", "digest")) - 1
    placed = placed.withColumn("index", index)
    placed = placed.withColumn("shard", F.expr(f"(index * {shards}) div {max(total, 1)}"))
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("slot", F.col("index") - start)
    keep = replacing(df.columns, ["shard", "slot"])
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("shard").cast("int"), F.col("slot").cast("bigint"))


SHARDS_SQL = f"""
WITH steps AS (  -- remainders of all bytes for CRC-32, from its polynomial
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
base AS (
  SELECT doc_id, source, (strlen(text) + 1)::BIGINT AS size,
         xor(list_reduce([4294967295] || b, lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
         md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), md5(md5(text)))) AS digest FROM bytes, steps),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY digest)::DOUBLE - 0.5) / count(*) OVER (PARTITION BY source) AS fraction FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, digest) - 1 AS place, count(*) OVER () AS total FROM ranked),
dealt AS (SELECT *, place * {SHARDS} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, place - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM dealt
"""


@query("op2_interleaved_shards", SHARDS_SQL)
def op2_interleaved_shards(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    content = F.encode(text_of(), "UTF-8")
    sized = documents.select("doc_id", "source", F.md5(content).alias("text"), (F.octet_length(text_of()) + 1).cast("bigint").alias("size"),
                             F.crc32(content).alias("text_crc32"))
    dealt = interleaved_shards(sized)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
