"""Tokenizer training, token accounting, masking and packing."""

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import TOKEN_SQL, TOKENS_SQL, hash_sql, joined, token_ids
from corpuslake.functions import wordlists as w
from corpuslake.functions.text import normalize_text, pretokenize
from corpuslake.session import spread
from corpuslake.operators.bpe import bpe_tokens, encode_bpe, train_bpe
from corpuslake.operators.shaping import apply_mask, assign_batches, mask_report, pack_next_fit, pack_sequences, packed_layout, span_masks
from corpuslake.operators.tokens import (
    add_special_tokens, add_special_tokens_pair, build_special_vocab, compression_stats, domain_term_coverage, domain_term_hits,
    pad_batch, token_totals, word_counts)

CLS, SEP, MASK = 2, 3, 4
FOLDED_WORDS_SQL = f"regexp_extract_all(lower(strip_accents(text)), '{TOKEN_SQL}')"

# A merge list for checking the encoder against SQL; every symbol is a letter or an earlier result.
MERGES = [("t", "h"), ("i", "o"), ("io", "n"), ("e", "r"), ("th", "e"), ("a", "n"), ("an", "d"), ("o", "u"), ("t", "ion"), ("er", "e")]

# Terms found as words of the test texts, next to the domain terms.
TERMS = [*w.DOMAIN_TERMS, "the", "and", "USB-C", "on the", "que"]


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")


def tokens(spark, sf):
    return token_ids(docs(spark, sf))


@query("word_counts", f"""
  SELECT word, count(*) AS freq FROM (SELECT unnest({FOLDED_WORDS_SQL}) AS word FROM documents) GROUP BY word""")
def _(spark, sf):
    return word_counts(docs(spark, sf))


VOCAB_SIZE = 100
FULL_SIZE = 64_000


def train_sql(size: int) -> str:
    """One materialised step per merge: the best pair of all words, then the words with that pair merged.

    There are as many steps as could ever be needed; the merges beyond the vocabulary size are left out at the end.
    """
    steps = []
    for i in range(1, size - len(w.SPECIAL_TOKENS) + 1):
        steps.append(f"""b{i} AS MATERIALIZED (SELECT l, r, {i} AS step FROM (
      SELECT freq, unnest(p[:len(p) - 1]) AS l, unnest(p[2:]) AS r FROM (SELECT freq, string_split(trim(s), '  ') AS p FROM w{i - 1}) WHERE len(p) > 1)
      GROUP BY l, r HAVING sum(freq) >= 2 ORDER BY sum(freq) DESC, l, r LIMIT 1),
    w{i} AS MATERIALIZED (SELECT freq, coalesce(replace(s, (SELECT ' ' || l || '  ' || r || ' ' FROM b{i}), (SELECT ' ' || l || r || ' ' FROM b{i})), s) AS s FROM w{i - 1})""")
    found = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, size - len(w.SPECIAL_TOKENS) + 1))
    specials = ", ".join("'" + t + "'" for t in w.SPECIAL_TOKENS)
    return f"""
  WITH w0 AS MATERIALIZED (SELECT count(*) AS freq, regexp_replace(word, '(?s)(.)', ' \\1 ', 'g') AS s
    FROM (SELECT unnest({FOLDED_WORDS_SQL}) AS word FROM documents) GROUP BY word),
    {", ".join(steps)},
  letters AS (SELECT DISTINCT unnest(string_split(trim(s), '  ')) AS token FROM w0),
  base AS (SELECT unnest([{specials}]) AS token, unnest(range({len(w.SPECIAL_TOKENS)})) AS place
    UNION ALL SELECT token, {len(w.SPECIAL_TOKENS)} + row_number() OVER (ORDER BY token) - 1 FROM letters WHERE token NOT IN ({specials})),
  merged AS (SELECT l, r, l || r AS token, step, l || r NOT IN (SELECT token FROM base) AND row_number() OVER (PARTITION BY l || r ORDER BY step) = 1 AS fresh
    FROM ({found})),
  counted AS (SELECT *, (SELECT count(*) FROM base) + coalesce(sum(fresh::INT) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM merged),
  kept AS (SELECT * FROM counted WHERE ahead < {size}),
  vocab AS (SELECT token, place::BIGINT AS id FROM base UNION ALL SELECT token, ahead::BIGINT FROM kept WHERE fresh)
  SELECT v.token, v.id, (k.step - 1)::BIGINT AS rank, k.l AS "left", k.r AS "right" FROM vocab v LEFT JOIN kept k USING (token)"""


@query("train_bpe", train_sql(VOCAB_SIZE))
def _(spark, sf):
    vocab, merges = train_bpe(word_counts(docs(spark, sf)), vocab_size=VOCAB_SIZE)
    return vocab.join(merges.select(F.concat("left", "right").alias("token"), "rank", "left", "right"), "token", "left")


@query("train_bpe_full")
def _(spark, sf):
    vocab, merges = train_bpe(word_counts(docs(spark, sf)), vocab_size=FULL_SIZE)
    return vocab.join(merges.select(F.concat("left", "right").alias("token"), "rank", "left", "right").dropDuplicates(["token"]), "token", "left")


@query("encode_trained_bpe")
def _(spark, sf):
    vocab, merges = train_bpe(word_counts(docs(spark, sf)), vocab_size=8_000)
    words = pretokenize(normalize_text("text"))
    rows = encode_bpe(docs(spark, sf), words, vocab, merges)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("input_ids")).cast("bigint").alias("n_tokens"))


def _merge_sql(word: str) -> str:
    """`word` with a blank before every symbol and the merges applied in order."""
    sql = f"' ' || array_to_string(regexp_extract_all({word}, '(?s).'), '  ') || ' '"
    for left, right in MERGES:
        sql = f"replace({sql}, ' {left}  {right} ', ' {left}{right} ')"
    return sql


@query("encode_bpe", f"""
  WITH x AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM (SELECT doc_id, {FOLDED_WORDS_SQL} AS words FROM documents)),
  e AS (SELECT doc_id, place, trim(replace({_merge_sql('word')}, '  ', ' ')) AS parts FROM x)
  SELECT doc_id, coalesce(string_agg(parts, ' ' ORDER BY place), '') AS tokens FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    words = pretokenize(normalize_text("text"))
    rows = docs(spark, sf).select("doc_id", bpe_tokens(spark, words, MERGES).alias("tokens"))
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# A vocabulary of these merges and most letters; the letters left out become [UNK].
VOCAB = ["[UNK]", *"abcdefghijklmnopqrstuv.,", *[left + right for left, right in MERGES]]


@query("encode_bpe_ids", f"""
  WITH v AS (SELECT unnest([{', '.join("'" + t + "'" for t in VOCAB)}]) AS token, unnest(range({len(VOCAB)})) AS id),
  x AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM (SELECT doc_id, {FOLDED_WORDS_SQL} AS words FROM documents)),
  e AS (SELECT doc_id, place, string_split(trim(replace({_merge_sql('word')}, '  ', ' ')), ' ') AS parts FROM x),
  u AS (SELECT doc_id, place, unnest(parts) AS token, unnest(range(len(parts))) AS part FROM e),
  i AS (SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ',' ORDER BY place, part) AS input_ids FROM u LEFT JOIN v USING (token) GROUP BY doc_id)
  SELECT doc_id, coalesce(input_ids, '') AS input_ids FROM documents LEFT JOIN i USING (doc_id)""")
def _(spark, sf):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, id bigint")
    merges = spark.createDataFrame([(i, left, right) for i, (left, right) in enumerate(MERGES)], "rank bigint, left string, right string")
    rows = encode_bpe(docs(spark, sf), pretokenize(normalize_text("text")), vocab, merges)
    return rows.select("doc_id", F.concat_ws(",", F.col("input_ids").cast("array<string>")).alias("input_ids"))


@query("add_special_tokens", f"""
  SELECT doc_id, array_to_string([{CLS}] || input_ids[1:126] || [{SEP}], ',') AS single,
    array_to_string([{CLS}] || input_ids || [{SEP}] || list_reverse(input_ids) || [{SEP}], ',') AS pair FROM ({TOKENS_SQL})""")
def _(spark, sf):
    rows = tokens(spark, sf)
    return rows.select("doc_id", joined(add_special_tokens("input_ids", CLS, SEP, 128)).alias("single"),
                       joined(add_special_tokens_pair("input_ids", F.reverse("input_ids"), CLS, SEP)).alias("pair"))


@query("pad_batch", f"""
  WITH t AS (SELECT doc_id, input_ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM ({TOKENS_SQL})),
  m AS (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 64.0) * 64 AS BIGINT) AS width FROM t)
  SELECT doc_id, batch_id, array_to_string(list_resize(input_ids, width, 0), ',') AS input_ids, width, len(input_ids) AS n_real FROM m""")
def _(spark, sf):
    rows = assign_batches(tokens(spark, sf), 16, ["doc_id"]).select("doc_id", "batch_id", "input_ids")
    padded = pad_batch(rows)
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return padded.select("doc_id", "batch_id", joined("input_ids").alias("input_ids"),
                         F.size("attention_mask").cast("bigint").alias("width"), real.alias("n_real"))


@query("token_totals", f"""
  SELECT source, count(*) AS samples, sum(len(input_ids))::BIGINT AS tokens FROM ({TOKENS_SQL}) GROUP BY ROLLUP (source)""")
def _(spark, sf):
    return token_totals(tokens(spark, sf))


@query("domain_term_coverage", f"""
  WITH v AS (SELECT word AS token, row_number() OVER (ORDER BY word) - 1 AS id FROM (
    SELECT DISTINCT unnest({FOLDED_WORDS_SQL}) AS word FROM documents)),
  t AS (SELECT unnest([{', '.join("'" + t + "'" for t in TERMS)}]) AS term)
  SELECT term, id IS NOT NULL AS single, id FROM t LEFT JOIN v ON v.token = lower(term)""")
def _(spark, sf):
    from corpuslake.operators.ordering import with_index
    vocab = with_index(word_counts(docs(spark, sf)).select(F.col("word").alias("token")), ["token"], "id")
    return domain_term_coverage(vocab, spark.createDataFrame([(t,) for t in TERMS], "term string"))


SINGLE_TERMS = [t.lower() for t in TERMS if t.isalnum()]
PART_TERMS = [t.lower() for t in TERMS if not t.isalnum()]


@query("domain_term_hits", f"""
  WITH s AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS term FROM documents),
  p AS (SELECT source, term, (length(text) - length(replace(lower(text), term, ''))) // length(term) AS hits
        FROM documents, (SELECT unnest([{', '.join("'" + t + "'" for t in PART_TERMS)}]) AS term))
  SELECT source, term, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM s
  WHERE term IN ({', '.join("'" + t + "'" for t in SINGLE_TERMS)}) GROUP BY source, term
  UNION ALL SELECT source, term, sum(hits)::BIGINT, count(*) FROM p WHERE hits > 0 GROUP BY source, term""")
def _(spark, sf):
    return domain_term_hits(docs(spark, sf), TERMS)


@query("build_special_vocab", f"""
  WITH d AS (SELECT '[' || p_brand || ']' AS token, 1 AS part, min(p_partkey) AS pos FROM part GROUP BY p_brand
    UNION ALL SELECT '[' || p_type || ']', 1, min(p_partkey) + 0.5 FROM part GROUP BY p_type),
  l AS (SELECT unnest([{', '.join("'" + t + "'" for t in w.SPECIAL_TOKENS)}]) AS token, 0 AS part, unnest(range({len(w.SPECIAL_TOKENS)})) AS pos
    UNION ALL SELECT token, part, pos FROM d UNION ALL SELECT unnest(['[MASK]', '[TURN]']), 2, unnest(range(2))),
  f AS (SELECT token, part, pos, row_number() OVER (PARTITION BY token ORDER BY part, pos) AS rn FROM l)
  SELECT token, row_number() OVER (ORDER BY part, pos, token) - 1 AS id FROM f WHERE rn = 1""")
def _(spark, sf):
    part = table(spark, sf, "part")
    terms = part.select(F.col("p_brand").alias("term"), (F.col("p_partkey") * 2).alias("pos")).unionByName(
        part.select(F.col("p_type").alias("term"), (F.col("p_partkey") * 2 + 1).alias("pos")))
    return build_special_vocab(terms, extra=["[MASK]", "[TURN]"])


@query("compression_stats", f"""
  SELECT count(*) AS samples, sum(len(input_ids))::BIGINT AS tokens, round(avg(len(input_ids)), 6) AS avg_tokens, min(len(input_ids)) AS min_tokens,
    max(len(input_ids)) AS max_tokens, median(len(input_ids)) AS median_tokens, round(sum(length(text)) / sum(len(input_ids)), 6) AS chars_per_token
  FROM ({TOKENS_SQL})""")
def _(spark, sf):
    stats = compression_stats(tokens(spark, sf))
    return stats.withColumn("avg_tokens", F.round("avg_tokens", 6)).withColumn("chars_per_token", F.round("chars_per_token", 6))


# --- masking and packing -------------------------------------------------------------------------

def draws_sql(tag: str, n: str) -> str:
    return (f"list_sort(list_transform(range(1, {n} + 1), lambda i: ('0x' || substr(md5(base::VARCHAR || '|{tag}|' || i::VARCHAR), 1, 10))"
            f"::BIGINT::DOUBLE / 1099511627776.0))")


@query("span_masks", f"""
  WITH t AS (SELECT doc_id, len(input_ids)::INT AS n, {hash_sql('5', '0', 'doc_id')} AS base FROM ({TOKENS_SQL})),
  s AS (SELECT *, least(floor(n * (0.05::DOUBLE + {draws_sql('share', '1')}[1] * {0.30 - 0.05!r}::DOUBLE))::INT, greatest(n - 2, 0)) AS covered FROM t),
  p AS (SELECT *, greatest(round(covered / 3.0::DOUBLE)::INT, 1) AS pieces FROM s),
  d AS (SELECT *, [0] || list_transform({draws_sql('cut', 'pieces')}, lambda x: floor(x * covered)::INT)[1:pieces - 1] || [covered] AS cuts,
    list_transform({draws_sql('gap', 'pieces')}, lambda x: floor(x * (greatest(n - 2, 0) - covered + 1))::INT) AS gaps FROM p),
  e AS (SELECT doc_id, n, unnest(range(1, pieces + 1)) AS i, cuts, gaps FROM d),
  f AS (SELECT doc_id, n, 1 + gaps[i] + cuts[i] AS start, 1 + gaps[i] + cuts[i + 1] AS stop FROM e)
  SELECT doc_id, n AS n_tokens, coalesce(sum(stop - start), 0)::INT AS n_masked,
    coalesce(string_agg(start || '-' || stop, ',' ORDER BY start) FILTER (start < stop), '') AS spans,
    count(*) FILTER (start < stop AND (start < 1 OR stop > n - 1)) AS outside FROM f GROUP BY doc_id, n""")
def _(spark, sf):
    rows = span_masks(tokens(spark, sf), seed=5)
    masked = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    outside = F.size(F.filter("spans", lambda s: (s["start"] < 1) | (s["end"] > F.size("input_ids") - 1))).cast("bigint")
    return rows.select("doc_id", F.size("input_ids").alias("n_tokens"), masked.alias("n_masked"), shown.alias("spans"), outside.alias("outside"))


SPANNED_SQL = f"""SELECT doc_id, source, input_ids AS ids, CASE WHEN len(input_ids) > 12 THEN [1, 4, 9, 12] WHEN len(input_ids) > 3 THEN [1, 2] ELSE [] END AS edges
  FROM ({TOKENS_SQL})"""
COVERED = "len([p FOR p IN range(len(edges) // 2) IF i > edges[2 * p + 1] AND i <= edges[2 * p + 2]]) > 0"


def spanned(spark, sf):
    size = F.size("input_ids")
    long_spans = F.expr("array(named_struct('start', 1, 'end', 4), named_struct('start', 9, 'end', 12))")
    short_spans = F.expr("array(named_struct('start', 1, 'end', 2))")
    spans = F.when(size > 12, long_spans).when(size > 3, short_spans).otherwise(F.expr("filter(array(named_struct('start', 1, 'end', 2)), x -> false)"))
    return tokens(spark, sf).withColumn("spans", spans)


@query("apply_mask", f"""
  SELECT doc_id, array_to_string([CASE WHEN {COVERED} THEN {MASK} ELSE ids[i] END FOR i IN range(1, len(ids) + 1)], ',') AS input_ids,
    array_to_string([CASE WHEN {COVERED} THEN ids[i] ELSE -100 END FOR i IN range(1, len(ids) + 1)], ',') AS labels FROM ({SPANNED_SQL})""")
def _(spark, sf):
    rows = apply_mask(spanned(spark, sf), MASK)
    return rows.select("doc_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("assign_batches", """
  SELECT doc_id, source, (row_number() OVER w - 1) // 8 AS batch_id, (row_number() OVER w - 1) % 8 AS pos
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def _(spark, sf):
    return assign_batches(docs(spark, sf).select("doc_id", "source"), 8, ["doc_id"], ["source"])


PACK_SQL = f"""
  WITH b AS (SELECT doc_id, source, input_ids AS ids, (row_number() OVER w - 1) // 8 AS batch_id, (row_number() OVER w - 1) % 8 AS pos
    FROM ({TOKENS_SQL}) WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
  r AS (SELECT *, sum(len(ids)) OVER (PARTITION BY source, batch_id ORDER BY pos)::BIGINT AS until,
      row_number() OVER (PARTITION BY source, batch_id ORDER BY pos) AS rn FROM b WHERE len(ids) > 0),
  packed AS (SELECT doc_id, source, batch_id, pos, ids[1:1024] AS ids, CASE WHEN until > 1024 THEN 0 ELSE until - len(ids) END AS start
    FROM r WHERE until <= 1024 OR rn = 1)"""


def packs(spark, sf):
    rows = assign_batches(tokens(spark, sf), 8, ["doc_id"], ["source"])
    return pack_sequences(rows, 1_024, ["source", "batch_id"])


@query("pack_sequences", f"""{PACK_SQL}
  SELECT doc_id, source, batch_id, pos, start, len(ids) AS n_tokens FROM packed""")
def _(spark, sf):
    return packs(spark, sf).select("doc_id", "source", "batch_id", "pos", "start", F.size("input_ids").cast("bigint").alias("n_tokens"))


@query("pack_next_fit", f"""
  WITH RECURSIVE b AS (SELECT doc_id, source, len(input_ids) AS n, (row_number() OVER w - 1) // 64 AS batch_id
    FROM ({TOKENS_SQL}) WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, batch_id ORDER BY doc_id) AS rn FROM b WHERE n > 0),
  p AS (SELECT *, 0::BIGINT AS pack, 0::BIGINT AS start FROM r WHERE rn = 1
    UNION ALL SELECT r.*, CASE WHEN p.start + p.n + r.n > 1024 THEN p.pack + 1 ELSE p.pack END,
      CASE WHEN p.start + p.n + r.n > 1024 THEN 0 ELSE p.start + p.n END
    FROM p JOIN r ON r.source = p.source AND r.batch_id = p.batch_id AND r.rn = p.rn + 1)
  SELECT doc_id, source, batch_id, pack, start, n AS n_tokens FROM p""")
def _(spark, sf):
    rows = assign_batches(tokens(spark, sf).select("doc_id", "source", "input_ids"), 64, ["doc_id"], ["source"])
    packed = pack_next_fit(rows, 1_024, ["source", "batch_id"])
    return packed.select("doc_id", "source", "batch_id", "pack", "start", F.size("input_ids").cast("bigint").alias("n_tokens"))


@query("packed_layout", f"""{PACK_SQL}
  SELECT source, batch_id, array_to_string(flatten(list(ids ORDER BY pos)), ',') AS input_ids,
    array_to_string([0] || list(start + len(ids) ORDER BY pos), ',') AS cu_seqlens,
    array_to_string(flatten(list(range(len(ids)) ORDER BY pos)), ',') AS position_ids, max(len(ids)) AS max_seqlen
  FROM packed GROUP BY source, batch_id""")
def _(spark, sf):
    rows = packed_layout(packs(spark, sf), ["source", "batch_id"])
    return rows.select("source", "batch_id", *[joined(c).alias(c) for c in ("input_ids", "cu_seqlens", "position_ids")],
                       F.col("max_seqlen").cast("bigint").alias("max_seqlen"))


@query("mask_report", f"""
  SELECT source, sum(len(ids))::BIGINT AS tokens, sum(CASE WHEN len(ids) > 12 THEN 6 WHEN len(ids) > 3 THEN 1 ELSE 0 END)::BIGINT AS masked,
    round(sum(CASE WHEN len(ids) > 12 THEN 6 WHEN len(ids) > 3 THEN 1 ELSE 0 END) / sum(len(ids)), 9) AS share
  FROM ({SPANNED_SQL}) GROUP BY source""")
def _(spark, sf):
    return mask_report(spanned(spark, sf)).withColumn("share", F.round("share", 9))
