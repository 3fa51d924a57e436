"""Operator 9, mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every source gets a target in words. A document is first allocated the whole copies that are certain, floor(target /
source size). The words that are still missing are a sample of documents, each taken at most once:

1. Inclusion probabilities are proportional to the square root of a document's words, p = min(1, level * sqrt(words)).
   The level is such that the expected words of the sample are the missing ones, so the longest documents may be
   certain, and the others are short against what is missing. A document longer than that has probability 0.
2. Documents are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), certain ones
   first. The size of the sample is fixed in words, because targets are: the head of the ranking that fits is taken.
3. What is still missing is less than the document that did not fit. The ranking is passed again, without the documents
   that are longer than the gap, until nothing fits or `ROUNDS` are over. One more document may close the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import bucket_of, draw, replacing, same, text_of, unit
from corpuslake.session import cut_lineage

SEED = "mix-1"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Passes over the ranking. The gap shrinks with each one, below the shortest document that did not fit.
ROUNDS = 4
#: The limit of a source is searched by histograms: in each of `LEVELS` steps the range that holds it is divided by so
#: many. Only the last range is sorted.
RUNS, LEVELS = 4_096, 2
WORDS = r"[^\x20\x09-\x0D]+"


def words_of(text: str = "text") -> Column:
    """Number of runs of characters that are not ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`sizes` (source, source_size, source_rows) with `weight` and `target`.

    The weights repeat over the sources in code point order, null last. All sources share the total
    by weight, no target exceeds `most` times its source; what is cut off goes to the others. This is
    a water level: in order of most * size / weight a source is full as long as the level that the
    sources before it leave is above its own, and the first one that is not full sets the level.
    """
    alphabetic = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(alphabetic) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("bound", (F.col("source_size") * F.lit(most)).cast("double"))
    rows = rows.withColumn("own", F.col("bound") / F.col("weight"))
    everything = Window.partitionBy()
    fuller = Window.orderBy("own", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(fuller), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fuller), F.lit(0.0))
    rows = rows.withColumn("level", left / open_weight)
    rows = rows.withColumn("water", F.min(F.when(F.col("level") <= F.col("own"), F.struct("own", "level"))).over(everything)["level"])
    full = F.col("water").isNull() | (F.col("own") < F.col("water"))
    return rows.select("source", "source_size", "source_rows", "weight",
                       F.when(full, F.col("bound")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def inclusion_levels(units: DataFrame) -> DataFrame:
    """`s, level`: per source the level of the inclusion probabilities, from units (source, words, missing).

    With all documents above some length certain, level = (missing - their words) / sum of words * sqrt(words) of the
    others. It holds for the greatest length whose own probability does not exceed 1; where there is none, all
    documents together do not exceed what is missing, and the source is left out. One row per source and length.
    """
    sizes = units.groupBy("source", "words").agg(F.count(F.lit(1)).alias("n"), F.max("missing").alias("missing"))
    longer = Window.partitionBy("source").orderBy(F.desc("words")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("certain", F.coalesce(F.sum(F.col("words") * F.col("n")).over(longer), F.lit(0)))
    sizes = sizes.withColumn("spread", F.sum(F.col("words") * F.sqrt("words") * F.col("n")).over(upto))
    sizes = sizes.withColumn("level", (F.col("missing") - F.col("certain")) / F.col("spread"))
    holds = sizes.where(F.col("level") * F.sqrt("words") <= 1)
    return holds.groupBy(F.col("source").alias("s")).agg(F.max(F.struct("words", "level"))["level"].alias("level"))


def _quotient() -> Column:
    """Random odds over inclusion odds, from `words`, `u`, `missing` and `level`; 0 for certain documents, null for
    those without words or longer than what is missing."""
    p = F.col("level") * F.sqrt("words")
    odds = F.when(p < 1, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))).otherwise(F.lit(0.0))
    return F.when((F.col("words") > 0) & (F.col("words") <= F.col("missing")), odds)


def _limits(rest: DataFrame, gaps: DataFrame) -> DataFrame:
    """`s, stop_q, stop_digest, taken`: per source the first document in the order of the quotients with which the words
    exceed the gap (null if there is none), and the words before it."""
    rows, ahead = rest.join(gaps.withColumnRenamed("s", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), None
    whole = rest.groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("words"))
    for level in range(1, LEVELS + 1):
        parts = RUNS ** level
        run = bucket_of(F.col("q") / (F.lit(1.0) + F.col("q")), parts)
        if ahead is not None:
            rows = rows.join(ahead, same(rows, ahead, [("source", "e"), ("run", "r")])).drop("e", "r", "run", "before").withColumn("before", F.col("ahead")).drop("ahead")
        else:
            rows = rows.withColumn("before", F.lit(0).cast("bigint"))
        rows = rows.withColumn("run", run)
        runs = rows.groupBy("source", "run").agg(F.sum("words").alias("words"), F.max("gap").alias("gap"), F.max("before").alias("before"))
        upto = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        runs = runs.withColumn("ahead", F.sum("words").over(upto) - F.col("words") + F.col("before"))
        edge = runs.where((F.col("ahead") <= F.col("gap")) & (F.col("ahead") + F.col("words") > F.col("gap")))
        ahead = edge.select(F.col("source").alias("e"), F.col("run").alias("r"), "ahead")
    last = rows.join(ahead, same(rows, ahead, [("source", "e"), ("run", "r")]))
    upto = Window.partitionBy("source").orderBy("q", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("sum", F.col("ahead") + F.sum("words").over(upto)).where(F.col("sum") > F.col("gap"))
    stop = last.groupBy(F.col("source").alias("e")).agg(F.min(F.struct("sum", "q", "digest", "words")).alias("stop"))
    found = whole.join(stop, F.col("s").eqNullSafe(F.col("e")), "left")
    taken = F.when(F.col("stop").isNull(), F.col("words")).otherwise(F.col("stop.sum") - F.col("stop.words"))
    return found.select("s", F.col("stop.q").alias("stop_q"), F.col("stop.digest").alias("stop_digest"), taken.alias("taken"))


def _before(q: str, digest: str, limit: Column) -> Column:
    """In the order of the quotients before the limit; without a limit, everything is."""
    stop, name = limit["stop_q"], limit["stop_digest"]
    return stop.isNull() | (F.col(q) < stop) | ((F.col(q) == stop) & (F.col(digest) < name))


def pareto_mix(df: DataFrame, seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id",
               text: str = "text", source: str = "source", rounds: int = ROUNDS) -> DataFrame:
    """Every row of `df` with `size`, `source_size`, `target` and `copies` (how often the mix takes it).

    After the sample one more document per source may close the remaining gap: the one whose size comes
    nearest to it, if that helps. Rows that agree in key, source and text are drawn together. A null source
    is a source of its own, the last one; texts without words are never drawn, only copied whole; an empty
    table gives an empty result; input columns with the names of the added ones are replaced.

    Texts never move: sizes are gathered per source, the limits of each source are searched for on a narrow table that
    shrinks with every pass, and rows are then compared with the limits of their source.
    """
    added = ["size", "source_size", "target", "copies"]
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    rows = df.select(row, F.col(source).alias("source"), words_of(text).alias("size"), draw(seed, key, text).alias("digest"))
    units = rows.groupBy("source", "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    units = units.select("source", "digest", unit(F.col("digest")).alias("u"), "n", (F.col("size") * F.col("n")).alias("words"))
    units = cut_lineage(units, "mix-units")

    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("source_rows"))
    sizes = targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sizes = sizes.withColumn("whole", F.floor(ratio).cast("bigint"))
    sizes = sizes.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    sizes = cut_lineage(sizes.withColumnRenamed("source", "s"), "mix-sizes")

    open_units = units.where(F.col("words") > 0).join(sizes.select("s", "missing"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    levels = cut_lineage(inclusion_levels(open_units.where(F.col("words") <= F.col("missing"))), "mix-levels")
    drawn = open_units.join(levels, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("q", _quotient())
    drawn = cut_lineage(drawn.select("source", "digest", "words", "q"), "mix-drawn")

    # `limits` of a source: per pass its gap and its stop
    gaps = sizes.select("s", F.col("missing").alias("gap"), F.lit(None).cast("array<struct<gap:double,stop_q:double,stop_digest:string>>").alias("limits"))
    gaps = gaps.withColumn("limits", F.coalesce("limits", F.array().cast(gaps.schema["limits"].dataType)))
    rest = drawn.where(F.col("q").isNotNull())
    for i in range(rounds):
        stops = _limits(rest, gaps.select("s", "gap"))
        limit = F.struct("gap", "stop_q", "stop_digest")
        after = gaps.join(stops.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
        after = after.select("s", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"), F.concat("limits", F.array(limit)).alias("limits"))
        gaps = cut_lineage(after, "mix-gaps")
        rest = rest.join(gaps, F.col("source").eqNullSafe(F.col("s")))
        rest = rest.where(~_before("q", "digest", F.element_at("limits", -1)) & (F.col("words") <= F.col("gap")))
        rest = cut_lineage(rest.select("source", "digest", "words", "q"), "mix-rest")
        if rest.isEmpty():
            break

    def sampled(words: str) -> Column:
        """Some pass took the document."""
        return F.coalesce(F.col("q").isNotNull() & F.exists("limits", lambda x: (F.col(words) <= x["gap"]) & _before("q", "digest", x)), F.lit(False))

    left = drawn.join(gaps, F.col("source").eqNullSafe(F.col("s"))).withColumn("off", F.abs(F.col("gap") - F.col("words")))
    left = left.where((F.col("off") < F.col("gap")) & ~sampled("words"))
    close = left.groupBy(F.col("source").alias("c")).agg(F.min(F.struct("off", "digest"))["digest"].alias("close_digest"))
    limits = sizes.join(gaps.select(F.col("s").alias("t"), "limits"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    limits = limits.join(close, F.col("s").eqNullSafe(F.col("c")), "left").drop("c")
    limits = limits.join(levels.withColumnRenamed("s", "v"), F.col("s").eqNullSafe(F.col("v")), "left").drop("v")
    limits = cut_lineage(limits, "mix-limits")

    repeated = units.where(F.col("n") > 1).select(F.col("source").alias("rs"), F.col("digest").alias("rd"), F.col("words").alias("together"))
    repeated = cut_lineage(repeated, "mix-repeated")
    found = rows.withColumn("u", unit(F.col("digest"))).join(limits, F.col("source").eqNullSafe(F.col("s")))
    found = found.join(repeated, F.col("source").eqNullSafe(F.col("rs")) & (F.col("digest") == F.col("rd")), "left")
    found = found.withColumn("words", F.coalesce("together", "size")).withColumn("q", _quotient())
    closing = F.coalesce(F.col("digest") == F.col("close_digest"), F.lit(False))
    copies = F.col("whole") + sampled("words").cast("bigint") + closing.cast("bigint")
    keep = replacing(df.columns, added)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "size", "source_size", "target", copies.alias("copies"))


def _passes_sql(rounds: int) -> str:
    """The passes over the ranking, one after another."""
    parts = []
    for i in range(rounds):
        parts.append(f"""
summed{i} AS (
  SELECT r.*, g.gap, sum(r.words) OVER (PARTITION BY r.source ORDER BY q, digest ROWS UNBOUNDED PRECEDING) AS total
  FROM rest{i} r JOIN gaps{i} g ON r.source IS NOT DISTINCT FROM g.source),
gaps{i + 1} AS (
  SELECT g.source, g.gap - coalesce(t.taken, 0) AS gap FROM gaps{i} g
  LEFT JOIN (SELECT source, max(total) AS taken FROM summed{i} WHERE total <= gap GROUP BY source) t ON g.source IS NOT DISTINCT FROM t.source),
rest{i + 1} AS (
  SELECT s.source, s.digest, s.words, s.q FROM summed{i} s JOIN gaps{i + 1} g ON s.source IS NOT DISTINCT FROM g.source
  WHERE s.total > s.gap AND s.words <= g.gap),""")
    return "".join(parts)


MIX_SQL = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))) AS digest
  FROM documents),
units AS (
  SELECT source, digest, (size * count(*))::BIGINT AS words, count(*) AS n, (('0x' || substr(digest, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM base GROUP BY source, digest, size),
sizes AS (SELECT source, sum(words)::BIGINT AS source_size FROM units GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sizes),
own AS (SELECT *, (source_size * 3)::DOUBLE AS bound, (source_size * 3)::DOUBLE / weight AS own FROM weighted),
waters AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM own WINDOW w AS (ORDER BY own, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT *, CASE WHEN own < (SELECT arg_min(level, own) FROM waters WHERE level <= own) THEN bound
            ELSE weight * (SELECT arg_min(level, own) FROM waters WHERE level <= own) END AS target FROM waters),
shares AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM target),
gaps0 AS (SELECT *, target - whole * source_size AS gap FROM shares),
fitting AS (
  SELECT u.*, g.gap AS missing FROM units u JOIN gaps0 g ON u.source IS NOT DISTINCT FROM g.source WHERE u.words > 0 AND u.words <= g.gap),
lengths AS (SELECT source, words, count(*) AS n, max(missing) AS missing FROM fitting GROUP BY source, words),
spreads AS (
  SELECT *, (missing - coalesce(sum(words * n) OVER (PARTITION BY source ORDER BY words DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(words * sqrt(words) * n) OVER (PARTITION BY source ORDER BY words ROWS UNBOUNDED PRECEDING) AS level FROM lengths),
levels AS (SELECT source, arg_max(level, words) AS level FROM spreads WHERE level * sqrt(words) <= 1 GROUP BY source),
rest0 AS (
  SELECT f.source, f.digest, f.words,
         CASE WHEN l.level * sqrt(f.words) < 1
              THEN (f.u / (1 - f.u)) / (l.level * sqrt(f.words) / (1 - l.level * sqrt(f.words))) ELSE 0.0 END AS q
  FROM fitting f LEFT JOIN levels l ON f.source IS NOT DISTINCT FROM l.source),{_passes_sql(ROUNDS)}
taken AS ({" UNION ALL ".join(f"SELECT source, digest FROM summed{i} WHERE total <= gap" for i in range(ROUNDS))}),
close AS (
  SELECT u.source, arg_min(u.digest, (abs(g.gap - u.words), u.digest)) AS digest
  FROM units u JOIN gaps{ROUNDS} g ON u.source IS NOT DISTINCT FROM g.source
  WHERE u.words > 0 AND abs(g.gap - u.words) < g.gap
    AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.source IS NOT DISTINCT FROM u.source AND t.digest = u.digest) GROUP BY u.source)
SELECT b.doc_id, b.size, o.source_size, o.target, (b.size * (o.whole + (t.digest IS NOT NULL)::BIGINT + (c.digest IS NOT NULL)::BIGINT))::BIGINT AS taken
FROM base b JOIN gaps0 o ON b.source IS NOT DISTINCT FROM o.source
LEFT JOIN taken t ON b.source IS NOT DISTINCT FROM t.source AND b.digest = t.digest
LEFT JOIN close c ON b.source IS NOT DISTINCT FROM c.source AND b.digest = c.digest
"""


@query("op9_pareto_mix", MIX_SQL)
def op9_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = pareto_mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
