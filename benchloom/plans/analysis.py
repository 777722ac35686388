"""Queries of error analyses over the judgements.

Three models score every judged pair by a hash of model, query and document, so that rankings are the
same everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as A
from ..operators import metrics as R
from .registry import query, table

MODELS = ("alpha", "beta", "gamma")
PRED = """pred AS (SELECT m AS model, q AS query_id, c AS corpus_id, CAST(CAST('0x' || substr(md5(m || q || c), 1, 7) AS BIGINT) AS DOUBLE) / 268435456 AS score FROM (SELECT DISTINCT "query-id" AS q, "corpus-id" AS c FROM qrels WHERE "query-id" IS NOT NULL AND "corpus-id" IS NOT NULL), (VALUES ('alpha'), ('beta'), ('gamma')) t(m)),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, corpus_id) AS rank FROM pred)"""
QL = "ql AS (SELECT query_id, max(lower(query_language)) AS query_language, max(mode) AS mode, max(strategy_name) AS strategy, bool_or(is_synthetic_translation) AS synthetic FROM qac GROUP BY 1)"


def hash_score(*columns: str) -> F.Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.conv(F.substring(F.md5(F.concat(*columns).cast("binary")), 1, 7), 16, 10).cast("double") / 268435456


def predictions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qrels").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id")).where("query_id is not null and corpus_id is not null").distinct()
    p = q.withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    return p.select("model", "query_id", "corpus_id", hash_score("model", "query_id", "corpus_id").alias("score"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.rank(predictions(spark, d), ["model", "query_id"])


def query_facts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qac", "query_id", "query_language", "mode", "strategy_name", "is_synthetic_translation")
    return q.groupBy("query_id").agg(F.max(F.lower("query_language")).alias("query_language"), F.max("mode").alias("mode"), F.max("strategy_name").alias("strategy"), F.max("is_synthetic_translation").alias("synthetic"))


def qrels(spark: SparkSession, d: str, score: float) -> DataFrame:
    return table(spark, d, "qrels").where(F.col("score") == score).select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id")).distinct()


def confusion(spark: SparkSession, d: str) -> DataFrame:
    neg = table(spark, d, "hard_negatives").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), "neighbor_name")
    return A.confusion(ranked(spark, d), qrels(spark, d, 1.0), neg).join(query_facts(spark, d).select("query_id", "query_language"), "query_id", "left")


CONF = f"""{PRED}, {QL}, g AS (SELECT DISTINCT "query-id" AS query_id, "corpus-id" AS corpus_id FROM qrels WHERE score = 1), n AS (SELECT "query-id" AS query_id, "corpus-id" AS corpus_id, min(neighbor_name) AS neighbor_name FROM hard_negatives GROUP BY 1, 2),
x AS (SELECT r.model, r.query_id, r.rank, g.query_id IS NOT NULL AS ig, n.query_id IS NOT NULL AND g.query_id IS NULL AS ing, n.neighbor_name FROM rk r LEFT JOIN g USING (query_id, corpus_id) LEFT JOIN n USING (query_id, corpus_id) WHERE r.query_id IN (SELECT query_id FROM n)),
cf0 AS (SELECT model, query_id, min(CASE WHEN ig THEN rank END) AS gold_rank, min(CASE WHEN ing THEN rank END) AS negative_rank, first(neighbor_name ORDER BY rank) FILTER (WHERE ing) AS nn FROM x GROUP BY 1, 2),
cf AS (SELECT c.model, c.query_id, gold_rank, negative_rank, coalesce(negative_rank, 4611686018427387904) < coalesce(gold_rank, 4611686018427387904) AS win, CASE WHEN coalesce(negative_rank, 4611686018427387904) < coalesce(gold_rank, 4611686018427387904) THEN nn END AS neighbor_name, ql.query_language FROM cf0 c LEFT JOIN ql USING (query_id) WHERE gold_rank IS NOT NULL OR negative_rank IS NOT NULL)"""


@query(f"WITH {CONF} SELECT model, query_id, gold_rank, negative_rank, win, neighbor_name, query_language FROM cf")
def confusion_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Best ranks of gold and look-alikes of each query."""
    return confusion(spark, d)


@query(
    f"""WITH {CONF} SELECT model, CASE WHEN grouping(query_language) = 1 THEN 'ALL' ELSE coalesce(query_language, '?') END AS language, count(*) AS n, round(avg(CAST(win AS INT)), 4) AS confusion_rate, round(avg(gold_rank), 2) AS gold_rank, round(avg(negative_rank), 2) AS negative_rank FROM cf GROUP BY GROUPING SETS ((model, query_language), (model))"""
)
def confusion_report(spark: SparkSession, d: str) -> DataFrame:
    """Confusion by model and language, and over all languages."""
    return A.confusion_report(confusion(spark, d))


@query(f"WITH {CONF} SELECT model, query_language, neighbor_name, count(*) AS n FROM cf WHERE win GROUP BY ALL ORDER BY n DESC, model, query_language NULLS FIRST, neighbor_name NULLS FIRST LIMIT 30")
def frequent_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Look-alikes that win most often."""
    return A.frequent_confusions(confusion(spark, d))


PQ = f"""{PRED}, {QL}, g AS (SELECT DISTINCT "query-id" AS query_id, "corpus-id" AS corpus_id FROM qrels WHERE score = 1), nr AS (SELECT query_id, count(*) AS n_relevant FROM g GROUP BY 1),
pq AS (SELECT r.model, r.query_id, sum(CASE WHEN g.query_id IS NOT NULL AND r.rank <= 3 THEN 1 ELSE 0 END) / max(n_relevant) AS recall, coalesce(1 / min(CASE WHEN g.query_id IS NOT NULL AND r.rank <= 3 THEN r.rank END), 0) AS rr,
  CAST(max(CASE WHEN g.query_id IS NOT NULL AND r.rank <= 3 THEN 1 ELSE 0 END) AS DOUBLE) AS hit FROM rk r JOIN nr USING (query_id) LEFT JOIN g USING (query_id, corpus_id) GROUP BY 1, 2),
pf AS (SELECT pq.*, ql.query_language, ql.mode, ql.strategy, CASE WHEN ql.synthetic THEN 'translated' WHEN NOT ql.synthetic THEN 'native' END AS origin FROM pq LEFT JOIN ql USING (query_id))"""


def per_query(spark: SparkSession, d: str) -> DataFrame:
    hits = R.judged(ranked(spark, d), qrels(spark, d, 1.0), ["model", "query_id"])
    per = R.per_query(hits, ["model", "query_id"], (3,)).select("model", "query_id", F.col("recall_3").alias("recall"), F.col("mrr_3").alias("rr"), F.col("hit_3").alias("hit"))
    return per.join(query_facts(spark, d), "query_id", "left").withColumn("origin", F.when(F.col("synthetic"), "translated").when(~F.col("synthetic"), "native"))


@query(f"WITH {PQ} SELECT model, query_id, round(recall, 6) AS recall, round(rr, 6) AS rr, hit, query_language, mode, strategy, origin FROM pf")
def question_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and hit of each question, with its language, mode, strategy and origin."""
    return per_query(spark, d).select("model", "query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "hit", "query_language", "mode", "strategy", "origin")


_DIMS = ("query_language", "mode", "strategy", "origin")
REPORT = " UNION ALL ".join(f"SELECT model, '{x}' AS dimension, coalesce({x}, 'unknown') AS value, count(*) AS n, round(avg(recall), 4) AS mean FROM pf GROUP BY 1, 3" for x in _DIMS)


@query(f"WITH {PQ} {REPORT}")
def group_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall by each of several dimensions."""
    return A.group_report(per_query(spark, d), list(_DIMS), "recall")


@query(f"WITH {PQ}, rp AS ({REPORT}) SELECT dimension, value, max(CASE WHEN model = 'alpha' THEN mean END) AS alpha, max(CASE WHEN model = 'beta' THEN mean END) AS beta, max(CASE WHEN model = 'gamma' THEN mean END) AS gamma FROM rp GROUP BY 1, 2")
def group_report_by_model(spark: SparkSession, d: str) -> DataFrame:
    """The group report with a column per model."""
    return A.pivot_by_model(A.group_report(per_query(spark, d), list(_DIMS), "recall"), list(MODELS))


@query(
    f"""WITH {PQ}, m AS (SELECT model, round(avg(recall), 9) AS mean FROM pf GROUP BY 1 ORDER BY mean DESC, model LIMIT 1), cl AS (SELECT id, max(nullif(lower(trim(language)), '')) AS corpus_language FROM corpus GROUP BY 1), src AS (SELECT query_id, max(corpus_id) AS id FROM qac GROUP BY 1)
    SELECT query_language, corpus_language, count(*) AS n, round(avg(hit), 4) AS mean FROM pf JOIN m USING (model) LEFT JOIN src USING (query_id) LEFT JOIN cl USING (id) GROUP BY 1, 2"""
)
def language_pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate of the best model by query and document language."""
    src = table(spark, d, "qac", "query_id", "corpus_id").groupBy("query_id").agg(F.max("corpus_id").alias("id"))
    lang = table(spark, d, "corpus", "id", "language").groupBy("id").agg(F.max(F.nullif(F.lower(F.trim("language")), F.lit(""))).alias("corpus_language"))
    return A.language_pairs(per_query(spark, d).join(src, "query_id", "left").join(lang, "id", "left"), "hit")


MET = "met AS (SELECT model, 'recall' AS metric, round(avg(recall), 6) AS value FROM pf GROUP BY 1 UNION ALL SELECT model, 'mrr', round(avg(rr), 6) FROM pf GROUP BY 1 UNION ALL SELECT model, 'miss_share', round(1 - avg(hit), 6) FROM pf GROUP BY 1)"


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = per_query(spark, d).groupBy("model").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(1 - F.avg("hit"), 6).alias("miss_share"))
    return m.unpivot("model", ["recall", "mrr", "miss_share"], "metric", "value")


@query(f"WITH {PQ}, {MET} SELECT metric, model, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'miss_share' THEN -value ELSE value END DESC, model) AS r FROM met) WHERE r = 1")
def metric_winners(spark: SparkSession, d: str) -> DataFrame:
    """Best model of each metric; for the share of misses the lowest is best."""
    return A.winners(model_metrics(spark, d), ("miss_share",))


@query(f"WITH {PQ}, {MET} SELECT row_number() OVER (ORDER BY value DESC, model) AS rank, model, value, printf('%.4f', value) AS shown FROM met WHERE metric = 'recall'")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Models by mean recall, with the value as it is shown."""
    return A.leaderboard(model_metrics(spark, d), "recall").withColumn("shown", F.format_string("%.4f", F.col("value")))


@query("SELECT 'corpus' AS name, count(*) AS n FROM corpus UNION ALL SELECT 'qac', count(*) FROM qac UNION ALL SELECT 'qrels', count(*) FROM qrels UNION ALL SELECT 'hard_negatives', count(*) FROM hard_negatives")
def dataset_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the tables of a benchmark."""
    return A.sizes({k: spark.read.parquet(f"{d}/{k}.parquet") for k in ("corpus", "qac", "qrels", "hard_negatives")})


@query(f"WITH {PRED} SELECT model, count(DISTINCT query_id) AS n_queries, count(*) AS n_rows, round(max(score), 6) AS best FROM rk WHERE rank <= 1000 GROUP BY 1")
def prediction_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Queries and ranked rows of each model."""
    return ranked(spark, d).where("rank <= 1000").groupBy("model").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_rows"), F.round(F.max("score"), 6).alias("best"))


@query(
    "SELECT DISTINCT CASE lower(query_language) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' WHEN 'zh' THEN 'zho' END AS language FROM qac WHERE query_language IS NOT NULL"
)
def query_languages(spark: SparkSession, d: str) -> DataFrame:
    """Long codes of the query languages."""
    codes = F.create_map(*[F.lit(x) for kv in {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "zh": "zho"}.items() for x in kv])
    return table(spark, d, "qac", "query_language").where("query_language is not null").select(F.try_element_at(codes, F.lower("query_language")).alias("language")).distinct()



@query(
    """SELECT DISTINCT query_id, CASE regexp_replace(trim(strategy), '\\.0$', '') WHEN '0' THEN 'forced_zh' WHEN '1' THEN 'random' WHEN '2' THEN 'random_missing' WHEN '3' THEN 'random_existing' WHEN '4' THEN 'all' WHEN 'random_any' THEN 'random' ELSE trim(strategy) END AS strategy,
    CASE WHEN query_id LIKE '%1' THEN 'paraphrase-multilingual-' ELSE 'multilingual-' END || mode AS model, mode AS short, regexp_replace(query_id || '__q_en', '__q_[a-z]{2}$', '') AS base FROM qac WHERE query_id IS NOT NULL"""
)
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of strategies and models as they are shown, and query identifiers without their language part."""
    q = table(spark, d, "qac", "query_id", "strategy", "mode").where("query_id is not null").distinct()
    model = F.concat(F.when(F.col("query_id").endswith("1"), "paraphrase-multilingual-").otherwise("multilingual-"), F.col("mode"))
    q = q.withColumn("model", model)
    return q.select("query_id", A.strategy_label(F.col("strategy")).alias("strategy"), "model", A.short_label(F.concat(F.lit("owner/"), "model")).alias("short"), T.strip_query_suffix(F.concat("query_id", F.lit("__q_en"))).alias("base"))


@query(f"WITH {PQ}, {MET} SELECT model, metric, value, printf('%.4f', value) AS shown, value = CASE WHEN metric = 'same_language_share@100' THEN min(value) OVER (PARTITION BY metric) ELSE max(value) OVER (PARTITION BY metric) END AS best FROM met")
def metric_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the comparison table: each value as shown, and whether it is the best of its metric."""
    from ..operators.reports import marked_best

    return marked_best(model_metrics(spark, d))
