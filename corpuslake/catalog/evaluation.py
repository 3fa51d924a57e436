"""Vectors, contrastive metrics, ranking metrics and search."""

from pyspark.sql import functions as F

from corpuslake.catalog.registry import query, table
from corpuslake.catalog.shapes import JUDGED_SQL, PAIRS_SQL, SCORED_SQL, UNIT_SQL, WORD_SQL, as_items, as_queries, judgments, scored, vector_pairs
from corpuslake.functions.vectors import cosine, dot, l2_normalize
from corpuslake.operators.contrastive import HashedBagOfWords, encode_table, expert_load, info_nce, load_balance_loss, router_z
from corpuslake.operators.cells import build_cells, search_cells
from corpuslake.operators.late import build_late, search_late
from corpuslake.operators.pairs import judged_rows
from corpuslake.operators.postings import build_postings, search_postings
from corpuslake.operators.ranking import cap_queries, grade_labels, macro_average, mrr, ndcg, ndcg_by_query, recall_at_k
from corpuslake.operators.retrieval import (
    adaptive_k, bm25, dense_topk, distinct_words, hybrid_search, matryoshka_search, maxsim, rerank, rrf, tag_prefilter, threshold_scores,
    word_overlap)
from corpuslake.plans.evaluation import evaluate_judgments
from corpuslake.session import cut_lineage, spread

DIM = 64
PROBES = 28  # cells that an approximate search visits; recall 0.94 on 2 000 vectors without clusters in 44 cells


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def rounded(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


# --- vectors -------------------------------------------------------------------------------------

@query("l2_normalize", f"""
  SELECT vec_id, place, round(x, 9) AS x FROM (SELECT vec_id, unnest(range(len(u))) AS place, unnest(u) AS x FROM ({UNIT_SQL}))""")
def _(spark, sf):
    rows = vectors(spark, sf).select("vec_id", F.posexplode(l2_normalize("embedding")).alias("place", "x"))
    return rounded(rows.withColumn("place", F.col("place").cast("bigint")), "x", digits=9)


@query("dot_and_cosine", f"""
  SELECT pair_id, round(list_dot_product(qv, pv), 9) AS dot,
    round(list_dot_product(qv, pv) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(pv, pv)), 9) AS cosine FROM ({PAIRS_SQL})""")
def _(spark, sf):
    rows = vector_pairs(vectors(spark, sf))
    return rounded(rows.select("pair_id", dot("qv", "pv").alias("dot"), cosine("qv", "pv").alias("cosine")), "dot", "cosine", digits=9)


def bow_sql(source: str, key: str, text: str) -> str:
    """`key, bucket, x`: the hashed bag of words of a text, unit length, sparse."""
    return f"""
      SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (
        SELECT {key}, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) % {DIM} AS bucket, count(*)::DOUBLE AS n
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{WORD_SQL}')) AS word FROM {source}) GROUP BY ALL)"""


@query("encode_table", f"""
  SELECT doc_id, bucket, round(x, 9) AS x FROM ({bow_sql('documents', 'doc_id', 'text')})""")
def _(spark, sf):
    rows = encode_table(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), HashedBagOfWords)
    sparse = rows.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where(F.col("x") != 0)
    return rounded(sparse.withColumn("bucket", F.col("bucket").cast("bigint")), "x", digits=9)


@query("info_nce", f"""
  WITH p AS (SELECT batch_id, pair_id, [x / sqrt(list_dot_product(qv, qv)) FOR x IN qv] AS q,
               [x / sqrt(list_dot_product(pv, pv)) FOR x IN pv] AS p FROM ({PAIRS_SQL})),
  l AS (SELECT a.batch_id, a.pair_id, b.pair_id AS other, list_dot_product(a.q, b.p) / 0.05 AS logit FROM p a JOIN p b USING (batch_id)),
  s AS (SELECT batch_id, pair_id, ln(sum(exp(logit))) - sum(CASE WHEN other = pair_id THEN logit ELSE 0 END) AS loss,
          arg_max(other, (round(logit, 9), -other)) = pair_id AS hit, sum(CASE WHEN other = pair_id THEN logit * 0.05 ELSE 0 END) AS sim FROM l GROUP BY batch_id, pair_id)
  SELECT batch_id, count(*) AS pairs, round(avg(loss), 6) AS loss, round(avg(hit::INT), 6) AS accuracy, round(avg(sim), 6) AS mean_positive_sim FROM s GROUP BY batch_id""")
def _(spark, sf):
    return rounded(info_nce(vector_pairs(vectors(spark, sf))), "loss", "accuracy", "mean_positive_sim")


EXPERT_SQL = """
  WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings),
  e AS (SELECT vec_id, unnest(range(len(z))) AS expert, unnest(z) AS x FROM v),
  p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, expert) <= 6 AS hit FROM e),
  g AS (SELECT expert, avg(hit::INT) AS load, avg(prob) AS mean_prob FROM p GROUP BY expert)"""


def router(spark, sf):
    return vectors(spark, sf).select("vec_id", F.col("embedding").alias("logits"))


@query("expert_load", f"{EXPERT_SQL} SELECT expert, round(load, 9) AS load, round(mean_prob, 9) AS mean_prob FROM g")
def _(spark, sf):
    return rounded(expert_load(router(spark, sf), 6), "load", "mean_prob", digits=9)


@query("load_balance_loss", f"{EXPERT_SQL} SELECT round(0.01 * count(*) * sum(load * mean_prob), 9) AS aux_loss FROM g")
def _(spark, sf):
    return rounded(load_balance_loss(router(spark, sf), 6), "aux_loss", digits=9)


@query("router_z", """
  SELECT round(avg(z * z) * 1e-3, 9) AS z_loss FROM (SELECT ln(sum(exp(x))) AS z FROM (
    SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY vec_id)""")
def _(spark, sf):
    return rounded(router_z(router(spark, sf)), "z_loss", digits=9)


# --- ranking metrics -----------------------------------------------------------------------------

@query("grade_labels", f"""
  SELECT pos, esci_label, CASE lower(esci_label) WHEN 'exact' THEN 3 WHEN 'substitute' THEN 2 WHEN 'complement' THEN 1 ELSE 0 END AS gain,
    CASE WHEN lower(esci_label) IN ('exact', 'e') THEN 3 WHEN lower(esci_label) IN ('substitute', 's') THEN 2
         WHEN lower(esci_label) IN ('complement', 'c') THEN 1 ELSE 0 END AS gain_with_codes FROM ({JUDGED_SQL})""")
def _(spark, sf):
    rows = judgments(table(spark, sf, "part"))
    both = grade_labels(grade_labels(rows, "esci_label", True).withColumnRenamed("gain", "gain_with_codes"), "esci_label")
    return both.select("pos", "esci_label", "gain", "gain_with_codes")


def ndcg_sql(source: str, k: int | None = None) -> str:
    def discount(rank):
        share = f"1 / log2({rank} + 1)"
        return share if k is None else f"CASE WHEN {rank} <= {k} THEN {share} ELSE 0 END"
    return f"""
      SELECT query_id, sum(items)::BIGINT AS items, sum(gain / items * d) / sum(ideal) AS ndcg FROM (
        SELECT query_id, score, count(*) AS items, sum(gain) AS gain, sum({discount('rnk')}) AS d, sum(gain * {discount('best')}) AS ideal FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rnk,
            row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item_id) AS best FROM ({source}))
        GROUP BY query_id, score) GROUP BY query_id HAVING sum(items) >= 2 AND sum(gain) > 0"""


def mrr_sql(source: str) -> str:
    return f"""
      SELECT query_id, coalesce(1.0::DOUBLE / min(CASE WHEN gain = 3 THEN rnk END), 0.0) AS rr FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rnk FROM ({source}))
      GROUP BY query_id HAVING count(*) >= 2"""


def judged_scores(spark, sf):
    return scored(table(spark, sf, "part"))


@query("ndcg_by_query", f"SELECT query_id, items, round(ndcg, 9) AS ndcg FROM ({ndcg_sql(SCORED_SQL)})")
def _(spark, sf):
    return rounded(ndcg_by_query(judged_scores(spark, sf)), "ndcg", digits=9)


@query("ndcg_at_10", f"SELECT round(avg(ndcg), 9) AS ndcg, count(*) AS queries FROM ({ndcg_sql(SCORED_SQL, 10)})")
def _(spark, sf):
    return rounded(ndcg(judged_scores(spark, sf), 10), "ndcg", digits=9)


@query("mrr", f"SELECT round(avg(rr), 9) AS mrr, count(*) AS queries FROM ({mrr_sql(SCORED_SQL)})")
def _(spark, sf):
    return rounded(mrr(judged_scores(spark, sf)), "mrr", digits=9)


@query("recall_at_k", f"""
  SELECT query_id, count(*) FILTER (gain >= 1) AS relevant, count(*) FILTER (gain >= 1 AND rnk <= 5) AS found,
    round(count(*) FILTER (gain >= 1 AND rnk <= 5) / count(*) FILTER (gain >= 1), 9) AS recall FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rnk FROM ({SCORED_SQL}))
  GROUP BY query_id HAVING count(*) FILTER (gain >= 1) > 0""")
def _(spark, sf):
    return rounded(recall_at_k(judged_scores(spark, sf), 5), "recall", digits=9)


@query("cap_queries", f"""
  WITH s AS ({SCORED_SQL}), q AS (SELECT query_id, min(pos) AS first FROM s GROUP BY query_id ORDER BY first LIMIT 100)
  SELECT query_id, item_id, false AS cut FROM s WHERE query_id IN (SELECT query_id FROM q)
  UNION ALL SELECT query_id, item_id, true FROM s WHERE pos <= (SELECT max(first) FROM q)""")
def _(spark, sf):
    rows = judged_scores(spark, sf).select("query_id", "item_id", "pos")
    whole = cap_queries(rows, 100).withColumn("cut", F.lit(False))
    return whole.unionByName(cap_queries(rows, 100, reference_cut=True).withColumn("cut", F.lit(True))).drop("pos")


@query("macro_average", f"""
  SELECT round(avg(coalesce(s, 0)), 9) AS macro_average FROM (
    SELECT p_brand, (SELECT avg(ndcg) FROM ({ndcg_sql(SCORED_SQL)}) n WHERE starts_with(n.query_id, p_brand || ' ')) AS s FROM (SELECT DISTINCT p_brand FROM part))""")
def _(spark, sf):
    part = table(spark, sf, "part")
    task = F.substring_index("query_id", " ", 1)
    scores = ndcg_by_query(scored(part)).groupBy(task.alias("p_brand")).agg(F.avg("ndcg").alias("score"))
    return rounded(macro_average(part.select("p_brand").distinct().join(scores, "p_brand", "left")), "macro_average", digits=9)


@query("evaluate_judgments", f"""
  WITH j AS ({JUDGED_SQL}),
  qs AS (SELECT DISTINCT query FROM j),
  qv AS ({bow_sql('qs', 'query', 'query')}),
  pv AS ({bow_sql('j', 'pos', 'product_title')}),
  s AS (SELECT j.query AS query_id, j.pos AS item_id, round(coalesce(sum(qv.x * pv.x), 0), 9) AS score,
          max(CASE lower(esci_label) WHEN 'exact' THEN 3 WHEN 'substitute' THEN 2 WHEN 'complement' THEN 1 ELSE 0 END) AS gain
        FROM j LEFT JOIN pv ON pv.pos = j.pos LEFT JOIN qv ON qv.query = j.query AND qv.bucket = pv.bucket GROUP BY j.query, j.pos)
  SELECT (SELECT round(avg(ndcg), 6) FROM ({ndcg_sql('SELECT * FROM s')})) AS ndcg, round(avg(rr), 6) AS mrr, count(*) AS queries FROM ({mrr_sql('SELECT * FROM s')})""")
def _(spark, sf):
    return rounded(evaluate_judgments(judgments(spread(table(spark, sf, "part"), "p_partkey"))), "ndcg", "mrr")


# --- search --------------------------------------------------------------------------------------

def dense_sql(queries: str, k: int) -> str:
    return f"""
  u AS ({UNIT_SQL}),
  dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_dot_product(q.u, d.u), 9) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, d.u), 9) DESC, d.vec_id) AS rank FROM {queries} q, u d) WHERE rank <= {k})"""


@query("dense_topk", f"WITH {dense_sql('u', 10)} SELECT query_id, item_id, score, rank FROM dense")
def _(spark, sf):
    return dense_topk(as_queries(vectors(spark, sf)), as_items(vectors(spark, sf)), 10)


@query("dense_topk_cells", f"WITH {dense_sql('u', 10)} SELECT query_id, item_id, score, rank FROM dense")
def _(spark, sf):
    return search_cells(as_queries(vectors(spark, sf)), build_cells(as_items(vectors(spark, sf))), 10)


@query("dense_topk_probes")
def _(spark, sf):
    return search_cells(as_queries(vectors(spark, sf)), build_cells(as_items(vectors(spark, sf))), 10, probes=PROBES)


def bm25_sql(docs: str, k: int) -> str:
    return f"""
  dw AS (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS words FROM {docs}),
  dl AS (SELECT item_id, len(words) AS dl FROM dw),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  tf AS (SELECT item_id, word, count(*) AS tf FROM (SELECT item_id, unnest(words) AS word FROM dw) GROUP BY item_id, word),
  df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
  qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM benchmark),
  sc AS (SELECT query_id, tf.item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
         FROM qw JOIN tf USING (word) JOIN df USING (word) JOIN dl ON dl.item_id = tf.item_id, st GROUP BY query_id, tf.item_id),
  keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= {k})"""


def items(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("item_id"), "text", F.array("lang", "source").alias("tags"))


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25", f"WITH {bm25_sql('documents', 10)} SELECT query_id, item_id, round(score, 6) AS score, rank FROM keyword")
def _(spark, sf):
    return rounded(bm25(questions(spark, sf), items(spark, sf), 10), "score")


@query("bm25_postings", f"WITH {bm25_sql('documents', 10)} SELECT query_id, item_id, round(score, 6) AS score, rank FROM keyword")
def _(spark, sf):
    return rounded(search_postings(questions(spark, sf), build_postings(items(spark, sf), alike=F.col("tags")[0]), 10), "score")


def asked(spark, sf):
    """Benchmark texts with the vector of the same number."""
    return questions(spark, sf).join(as_queries(vectors(spark, sf)), "query_id")


ASKED = "(SELECT u.* FROM u JOIN benchmark ON vec_id = item_id)"


@query("rrf", f"""
  WITH {dense_sql(ASKED, 30)}, {bm25_sql('documents', 30)}
  SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
    SELECT query_id, item_id, rank FROM dense UNION ALL SELECT query_id, item_id, rank FROM keyword) GROUP BY query_id, item_id""")
def _(spark, sf):
    dense = dense_topk(asked(spark, sf), as_items(vectors(spark, sf)), 30)
    return rounded(rrf(dense, bm25(questions(spark, sf), items(spark, sf), 30)), "score", digits=9)


@query("adaptive_k", f"""
  WITH {bm25_sql('documents', 20)},
  g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM keyword),
  c AS (SELECT query_id, coalesce(arg_max(rank, (gap, -rank)) FILTER (gap IS NOT NULL), 1) AS cut FROM g GROUP BY query_id)
  SELECT query_id, item_id, round(score, 6) AS score, rank FROM g JOIN c USING (query_id) WHERE rank <= cut""")
def _(spark, sf):
    hits = cut_lineage(bm25(questions(spark, sf), items(spark, sf), 20).drop("rank"), "hits")
    return rounded(adaptive_k(hits, 20).select("query_id", "item_id", "score", "rank"), "score")


@query("threshold_scores", f"""
  WITH s AS (SELECT query_id, item_id, (score - 0.8) * 8 AS score FROM ({SCORED_SQL})),
  p AS (SELECT *, 1 / (1 + exp(-score)) AS probability FROM s)
  SELECT query_id, item_id, round(score, 9) AS score, round(probability, 9) AS probability, 'kept' AS status FROM p WHERE probability > 0.8
  UNION ALL SELECT query_id, NULL, NULL, NULL, 'none' FROM p GROUP BY query_id HAVING max(probability) <= 0.8""")
def _(spark, sf):
    rows = judged_scores(spark, sf).withColumn("score", (F.col("score") - 0.8) * 8)
    return rounded(threshold_scores(rows, 0.8), "score", "probability", digits=9)


@query("threshold_scores_fallback", f"""
  WITH s AS (SELECT query_id, item_id, (score - 0.8) * 8 AS score FROM ({SCORED_SQL})),
  p AS (SELECT *, 1 / (1 + exp(-score)) AS probability FROM s),
  e AS (SELECT query_id FROM p GROUP BY query_id HAVING max(probability) <= 0.8)
  SELECT query_id, item_id, round(score, 9) AS score, round(probability, 9) AS probability, 'kept' AS status FROM p WHERE probability > 0.8
  UNION ALL SELECT query_id, item_id, round(score, 9), round(probability, 9), 'fallback' FROM p JOIN e USING (query_id)""")
def _(spark, sf):
    rows = judged_scores(spark, sf).withColumn("score", (F.col("score") - 0.8) * 8)
    return rounded(threshold_scores(rows, 0.8, fallback=rows), "score", "probability", digits=9)


TAGGED = "(SELECT * FROM documents WHERE list_has_any([lang, source], ['en', 'src3']))"


@query("tag_prefilter", f"WITH {bm25_sql(TAGGED, 10)} SELECT query_id, item_id, round(score, 6) AS score, rank FROM keyword")
def _(spark, sf):
    return rounded(bm25(questions(spark, sf), tag_prefilter(items(spark, sf), ["en", "src3"]), 10), "score")


@query("matryoshka_search", f"""
  WITH u AS ({UNIT_SQL}),
  h AS (SELECT vec_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS s FROM (SELECT vec_id, (embedding::DOUBLE[])[1:16] AS v FROM embeddings)),
  c AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.s, d.s), 9) DESC, d.vec_id) AS rn FROM h q, h d),
  f AS (SELECT query_id, item_id, round(list_dot_product(q.u, d.u), 9) AS score FROM c JOIN u q ON q.vec_id = query_id JOIN u d ON d.vec_id = item_id WHERE rn <= 50)
  SELECT * FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 10""")
def _(spark, sf):
    return matryoshka_search(as_queries(vectors(spark, sf)), as_items(vectors(spark, sf)), d=16, top=50, k=10)


@query("maxsim", f"""
  WITH u AS ({UNIT_SQL})
  SELECT query_id, doc_id, round(sum(best), 6) AS score FROM (
    SELECT q.vec_id // 4 AS query_id, q.vec_id AS token_id, d.label::BIGINT AS doc_id, max(list_dot_product(q.u, d.u)) AS best
    FROM u q, u d GROUP BY ALL) GROUP BY query_id, doc_id""")
def _(spark, sf):
    heads = vectors(spark, sf).selectExpr("vec_id DIV 4 AS query_id", "vec_id AS token_id", "embedding AS vector")
    found = maxsim(heads, vectors(spark, sf).selectExpr("CAST(label AS BIGINT) AS doc_id", "vec_id AS token_id", "embedding AS vector"))
    return rounded(found, "score")


def late_sql(doc: str, k: int) -> str:
    return f"""
  WITH u AS ({UNIT_SQL}),
  s AS (SELECT query_id, doc_id, round(sum(best), 9) AS score FROM (
    SELECT q.vec_id // 4 AS query_id, q.vec_id AS token_id, {doc} AS doc_id, max(list_dot_product(q.u, d.u)) AS best
    FROM u q, u d GROUP BY ALL) GROUP BY query_id, doc_id)
  SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""


@query("maxsim_topk", late_sql("d.label::BIGINT", 3))
def _(spark, sf):
    heads = vectors(spark, sf).selectExpr("vec_id DIV 4 AS query_id", "vec_id AS token_id", "embedding AS vector")
    found = maxsim(heads, vectors(spark, sf).selectExpr("CAST(label AS BIGINT) AS doc_id", "vec_id AS token_id", "embedding AS vector"), k=3)
    return rounded(found, "score")


@query("maxsim_index", late_sql("d.vec_id // 8", 10))
def _(spark, sf):
    heads = vectors(spark, sf).selectExpr("vec_id DIV 4 AS query_id", "vec_id AS token_id", "embedding AS vector")
    index = build_late(vectors(spark, sf).selectExpr("vec_id DIV 8 AS doc_id", "vec_id AS token_id", "embedding AS vector"))
    return rounded(search_late(heads, index, 10), "score")


@query("hybrid_search", f"""
  WITH {dense_sql(ASKED, 50)}, {bm25_sql('documents', 50)},
  f AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
    SELECT query_id, item_id, rank FROM dense UNION ALL SELECT query_id, item_id, rank FROM keyword) GROUP BY query_id, item_id)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 10""")
def _(spark, sf):
    return hybrid_search(asked(spark, sf), items(spark, sf), as_items(vectors(spark, sf)), 10, depth=50)


@query("rerank", f"""
  WITH {bm25_sql('documents', 50)},
  w AS (SELECT query_id, count(*) AS asked FROM qw GROUP BY query_id),
  o AS (SELECT k.query_id, k.item_id, k.rank AS first_rank, count(*) / any_value(asked) AS score
        FROM keyword k JOIN w USING (query_id) JOIN qw USING (query_id) JOIN tf ON tf.item_id = k.item_id AND tf.word = qw.word GROUP BY ALL)
  SELECT query_id, item_id, first_rank, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM o""")
def _(spark, sf):
    hits = cut_lineage(bm25(questions(spark, sf), items(spark, sf), 50).drop("rank"), "hits")
    wanted = items(spark, sf).join(hits.select("item_id").distinct(), "item_id", "left_semi")
    words = cut_lineage(wanted.select("item_id", distinct_words("text").alias("words")), "candidate-words")
    asked_words = questions(spark, sf).select("query_id", distinct_words("text").alias("asked"))
    rows = hits.join(words, "item_id").join(asked_words, "query_id")
    ranked = rerank(rows, word_overlap("asked", "words"), depth=50).select("query_id", "item_id", "first_rank", "score", "rank")
    return rounded(ranked, "score", digits=9)
