"""Queries of search and ranking metrics.

Every vector whose id is divisible by 20 is a query, all others are documents; relevant are the
documents with the query's label; languages go by the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as R
from .registry import query, table

K = 100
_LANG = "['de', 'en', 'es', 'fr'][({0} + {0} // 20) % 4 + 1]"
VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
RANKED = f"""{VECTORS}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS corpus_id, CAST(q.label = d.label AS INT) AS hit, round(list_dot_product(q.v, d.v), 6) AS score FROM e q JOIN e d ON q.vec_id % 20 = 0 AND d.vec_id % 20 != 0),
rel AS (SELECT query_id, sum(hit) AS n_relevant FROM s GROUP BY 1 HAVING sum(hit) > 0),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM s) WHERE rank <= {K}),
h AS (SELECT r.*, n_relevant, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec, 1 / log2(rank + 1.0) AS gain, {_LANG.format('query_id')} AS ql, {_LANG.format('corpus_id')} AS dl FROM r JOIN rel USING (query_id))"""


def language(c: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), ((F.col(c) + F.floor(F.col(c) / 20)) % 4 + 1).cast("int"))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0"), e.where("vec_id % 20 != 0")


def ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(ranked rows with hits, relevant pairs)."""
    q, docs = vectors(spark, d)
    top = R.top_k(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), docs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), K)
    rel = q.select(F.col("vec_id").alias("query_id"), "label").join(docs.select(F.col("vec_id").alias("corpus_id"), "label"), "label").select("query_id", "corpus_id")
    r = R.rank(top.withColumnRenamed("doc_id", "corpus_id"), ["query_id"])
    hits = R.judged(r, rel, ["query_id"]).withColumn("query_language", language("query_id")).withColumn("corpus_language", language("corpus_id"))
    return hits, rel


@query(f"WITH {RANKED} SELECT query_id, corpus_id, rank, score FROM r")
def search_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest documents of each query."""
    q, docs = vectors(spark, d)
    top = R.top_k(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), docs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), K)
    return R.rank(top.withColumnRenamed("doc_id", "corpus_id"), ["query_id"]).select("query_id", "corpus_id", "rank", "score")


def _metric_sql(k: int) -> str:
    top = f"CASE WHEN rank <= {k} THEN hit ELSE 0 END"
    return f"""sum({top}) / max(n_relevant) AS recall_{k}, sum({top} * prec) / least(max(n_relevant), {k}) AS map_{k},
    sum({top} * gain) / list_sum(list_transform(range(1, CAST(least(max(n_relevant), {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))) AS ndcg_{k}, coalesce(1 / min(CASE WHEN rank <= {k} AND hit = 1 THEN rank END), 0.0) AS mrr_{k}, CAST(max({top}) AS DOUBLE) AS hit_{k}"""


PER = f"{RANKED}, per AS (SELECT query_id, ql AS query_language, sum(hit * prec) / max(n_relevant) AS map, {', '.join(map(_metric_sql, R.CUTOFFS))} FROM h GROUP BY 1, 2)"
_NAMES = ["map", *[f"{m}_{k}" for k in R.CUTOFFS for m in ("recall", "map", "ndcg", "mrr", "hit")]]


@query(f"WITH {PER} SELECT query_id, {', '.join(f'round({m}, 5) AS {m}' for m in _NAMES)} FROM per")
def retrieval_per_query(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of each query."""
    per = R.per_query(ranked(spark, d)[0], ["query_id"])
    return per.select("query_id", *[F.round(m, 5).alias(m) for m in _NAMES])


@query(f"WITH {PER} SELECT query_language, count(*) AS n_queries, {', '.join(f'round(avg({m}), 5) AS {m}' for m in _NAMES)} FROM per GROUP BY 1")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics by query language."""
    per = R.per_query(ranked(spark, d)[0], ["query_id", "query_language"]).drop("n_relevant")
    return R.means(per, ["query_language"])


@query(
    f"""WITH {RANKED} SELECT query_language, round(avg(share), 5) AS share FROM (SELECT query_id, ql AS query_language, coalesce(sum(CASE WHEN hit = 0 AND ql = dl THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END), 0), 0.0) AS share FROM h GROUP BY 1, 2) GROUP BY 1"""
)
def same_language_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of irrelevant documents in the query's language, by language."""
    return R.same_language_share(ranked(spark, d)[0], ["query_id"], K).groupBy("query_language").agg(F.round(F.avg("share"), 5).alias("share"))


@query(
    f"""WITH {RANKED}, tot AS (SELECT query_id, sum(CASE WHEN {_LANG.format('query_id')} = {_LANG.format('corpus_id')} THEN 1 ELSE 0 END) AS n_same, sum(CASE WHEN {_LANG.format('query_id')} = {_LANG.format('corpus_id')} THEN 0 ELSE 1 END) AS n_cross FROM s WHERE hit = 1 GROUP BY 1)
    SELECT query_id, round(sum(CASE WHEN rank <= 50 AND hit = 1 AND ql = dl THEN 1 ELSE 0 END) / nullif(max(n_same), 0), 6) AS same_recall, round(sum(CASE WHEN rank <= 50 AND hit = 1 AND ql != dl THEN 1 ELSE 0 END) / nullif(max(n_cross), 0), 6) AS cross_recall FROM h JOIN tot USING (query_id) GROUP BY 1"""
)
def split_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall over relevant documents in the query's language and in others."""
    hits, rel = ranked(spark, d)
    q = rel.select("query_id").distinct().withColumn("query_language", language("query_id"))
    c = rel.select("corpus_id").distinct().withColumn("corpus_language", language("corpus_id"))
    out = R.split_recall(hits, rel, q, c, ["query_id"], 50)
    return out.select("query_id", F.round("same_recall", 6).alias("same_recall"), F.round("cross_recall", 6).alias("cross_recall"))


@query(
    f"""WITH {VECTORS} SELECT vec_id, round(list_dot_product(v, v), 6) AS squared, round(sqrt(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))))), 6) AS unit FROM e"""
)
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scaled to unit length."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    u = R.normalized_vector(e.withColumn("raw", F.col("embedding")), "embedding")
    square = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    return u.select("vec_id", F.round(square("raw"), 6).alias("squared"), F.round(F.sqrt(square("embedding")), 6).alias("unit"))


# ---------------------------------------------------------------- curves over a ladder of depths
# The score of a query at depth t is its score with the (t + 1)-th document of its label, the haystack are documents of other labels.

CURVE = f"""{VECTORS}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS corpus_id, q.label = d.label AS same, round(list_dot_product(q.v, d.v), 6) AS score FROM e q JOIN e d ON q.vec_id % 20 = 0 AND d.vec_id % 20 != 0),
lad AS (SELECT * FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY corpus_id) - 1 AS depth FROM s WHERE same) WHERE depth <= 5),
cv AS (SELECT 'base' AS model, l.query_id, CAST(l.depth AS INT) AS depth, CASE WHEN l.depth = 0 THEN 'none' ELSE ['B', 'C', 'D', 'F'][CAST((l.query_id + l.depth) % 4 AS INT) + 1] END AS mode, l.score, 1 + (SELECT count(*) FROM s WHERE s.query_id = l.query_id AND NOT s.same AND s.score > l.score) AS rank,
  lag(l.score) OVER (PARTITION BY l.query_id ORDER BY l.depth) - l.score AS drop FROM lad l)"""


def curve(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.analysis import with_drops

    q, docs = vectors(spark, d)
    v = lambda c: F.transform(c, lambda x: x.cast("double"))
    pair = lambda x: F.round(F.aggregate(F.zip_with(v("qv"), v("dv"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), 6)
    same = q.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("qv")).join(docs.select(F.col("vec_id").alias("corpus_id"), "label", F.col("embedding").alias("dv")), "label")
    w = Window.partitionBy("query_id").orderBy("corpus_id")
    lad = same.withColumn("depth", F.row_number().over(w) - 1).where("depth <= 5").select("query_id", "depth", pair(None).alias("score"))
    own = lad.groupBy("query_id").agg(F.collect_list(F.struct(F.col("depth").alias("key"), "score")).alias("own"))
    mine = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("group")).join(own, "query_id")
    ranks = R.ranks_in_haystack(mine, docs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))).withColumnRenamed("key", "depth")
    mode = F.when(F.col("depth") == 0, "none").otherwise(F.element_at(F.array(*map(F.lit, "BCDF")), ((F.col("query_id") + F.col("depth")) % 4 + 1).cast("int")))
    return with_drops(ranks.withColumn("model", F.lit("base")).withColumn("mode", mode))


@query(f"WITH {CURVE} SELECT query_id, depth, score, rank, round(drop, 6) AS drop FROM cv")
def decay_curve(spark: SparkSession, d: str) -> DataFrame:
    """Score, rank in the haystack and drop at each depth."""
    return curve(spark, d).select("query_id", "depth", "score", "rank", F.round("drop", 6).alias("drop"))


@query(
    f"""WITH {CURVE} SELECT model, depth, count(DISTINCT query_id) AS n, round(avg(score), 6) AS mean_score, round(avg(drop), 6) AS mean_drop, median(rank) AS median_rank, {', '.join(f'round(avg(CAST(rank <= {k} AS INT)), 6) AS recall_{k}' for k in (1, 10, 100))} FROM cv GROUP BY 1, 2"""
)
def curve_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means, exact median rank and recall by depth."""
    from ..operators.analysis import curve_summary as summary

    return summary(curve(spark, d), ["model", "depth"])


@query(
    f"""WITH {CURVE} SELECT model, ['en', 'de', 'fr'][CAST(query_id % 3 AS INT) + 1] AS query_language, depth, count(DISTINCT query_id) AS n, round(avg(score), 12) AS mean_score, round(avg(drop), 12) AS mean_drop, median(rank) AS median_rank, {', '.join(f'round(avg(CAST(rank <= {k} AS INT)), 6) AS recall_{k}' for k in (1, 10, 100))} FROM cv GROUP BY 1, 2, 3"""
)
def curve_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The curve by language of the query (dealt by its number here) and depth."""
    from ..operators.analysis import curve_summary as summary

    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("query_id") % 3 + 1).cast("int"))
    return summary(curve(spark, d).withColumn("query_language", lang), ["model", "query_language", "depth"], digits=12)  # few queries: means of six digits are ties at six


@query(f"WITH {CURVE} SELECT model, mode, count(*) AS n, round(avg(drop), 6) AS mean_drop FROM cv WHERE depth >= 1 GROUP BY 1, 2")
def curve_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Mean drop by the mode that a step added."""
    from ..operators.analysis import mode_breakdown

    return mode_breakdown(curve(spark, d))


@query(
    f"""WITH {CURVE} SELECT model, round(avg(CASE WHEN depth = lo THEN score END), 6) AS first_score, round(avg(CASE WHEN depth = hi THEN score END), 6) AS last_score, round(round(avg(CASE WHEN depth = lo THEN score END), 6) - round(avg(CASE WHEN depth = hi THEN score END), 6), 6) AS loss FROM cv, (SELECT min(depth) AS lo, max(depth) AS hi FROM cv) GROUP BY 1"""
)
def curve_ends(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores at the first and the last depth."""
    from ..operators.analysis import end_to_end

    return end_to_end(curve(spark, d))
