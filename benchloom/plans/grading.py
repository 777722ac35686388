"""Queries of sampling, planning and grading.

Grades stand for recorded responses of a model: they follow from hashes of the query id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading as G
from ..operators.corpus import known
from .corpus import KNOWN
from .registry import query, table

LANGS = ("en", "de", "fr", "es", "zh")


def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus", "id", "language").where("language in ('en', 'de', 'fr', 'es', 'zh')").distinct()


@query(
    """WITH b AS (SELECT DISTINCT id, language FROM corpus WHERE language IN ('en', 'de', 'fr', 'es', 'zh')), w AS (SELECT language, greatest(1, CAST(round_even(count(*) * 60 / (SELECT count(*) FROM b), 0) AS INT)) AS want FROM b GROUP BY 1)
    SELECT id, language FROM (SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY md5('7|' || id), id) AS r, want FROM b JOIN w USING (language)) WHERE r <= want ORDER BY md5('7|' || id), id LIMIT 60"""
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sixty rows in proportion to the languages (a sampling operator)."""
    return G.stratified_sample(sampled_rows(spark, d), 60, "language", "id", 7)


QUOTAS = """sp AS (SELECT d, (54 - 4 * d) // 3 AS q1, (53 - 4 * d) // 3 AS q2, (52 - 4 * d) // 3 AS q3, 4 * d AS q4 FROM range(1, 14) t(d)),
bq AS (SELECT * FROM sp WHERE least(q1, q2, q3, q4) > 0 ORDER BY greatest(q1, q2, q3, q4) - least(q1, q2, q3, q4), abs(4 * q4 - 52) LIMIT 1),
qt AS (SELECT 1 AS strategy, q1 AS questions FROM bq UNION ALL SELECT 2, q2 FROM bq UNION ALL SELECT 3, q3 FROM bq UNION ALL SELECT 4, q4 FROM bq)"""


@query(f"WITH {QUOTAS} SELECT CAST(strategy AS INT) AS strategy, CAST(questions AS INT) AS questions FROM qt")
def question_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Questions per strategy out of 52."""
    return spark.createDataFrame(sorted(G.question_quotas(52).items()), "strategy int, questions int")


@query(
    f"""WITH {QUOTAS}, dq AS (SELECT strategy, CASE strategy WHEN 4 THEN questions // 4 ELSE questions END AS n FROM qt), q AS (SELECT strategy, sum(n) OVER (ORDER BY strategy) - n AS lo, sum(n) OVER (ORDER BY strategy) AS hi FROM dq), p AS (SELECT publication_number, row_number() OVER (ORDER BY md5('3|' || publication_number), publication_number) - 1 AS r FROM (SELECT DISTINCT publication_number FROM corpus WHERE {KNOWN}) ORDER BY r LIMIT 100)
    SELECT publication_number, CASE WHEN r < 50 THEN 'technical' ELSE 'semantic_retrieval' END AS mode, CAST(strategy AS INT) AS strategy FROM p JOIN q ON r % 50 >= lo AND r % 50 < hi"""
)
def generation_plan(spark: SparkSession, d: str) -> DataFrame:
    """A pool of a hundred publications dealt to modes and strategies (a sampling operator)."""
    return G.generation_plan(table(spark, d, "corpus", "publication_number").where(known("publication_number")), 100, 52, 3, strict=False)


def _have(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus", "publication_number", "language").where("trim(publication_number) != '' and publication_number != 'EP-0000000-A0' and language in ('en', 'de', 'fr', 'es', 'zh')").distinct()


_PICK = "pick AS (SELECT *, CAST(CAST('0x' || substr(md5('5|' || publication_number), 1, 7) AS BIGINT) AS BIGINT) AS k FROM (SELECT publication_number, list(DISTINCT language) AS have FROM corpus WHERE trim(publication_number) != '' AND publication_number != 'EP-0000000-A0' AND language IN ('en', 'de', 'fr', 'es', 'zh') GROUP BY 1)), ch AS (SELECT *, ['en', 'de', 'fr', 'es', 'zh'] AS every, list_filter(['en', 'de', 'fr', 'es', 'zh'], lambda x: list_contains(have, x)) AS here, list_filter(['en', 'de', 'fr', 'es', 'zh'], lambda x: NOT list_contains(have, x)) AS gone FROM pick)"


@query(
    f"""WITH {_PICK} SELECT 1 AS strategy, publication_number, every[k % 5 + 1] AS target FROM ch UNION ALL SELECT 2, publication_number, CASE WHEN len(gone) > 0 THEN gone[k % len(gone) + 1] ELSE every[k % 5 + 1] END FROM ch
    UNION ALL SELECT 3, publication_number, here[k % len(here) + 1] FROM ch UNION ALL SELECT 4, publication_number, unnest(every) FROM ch"""
)
def language_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Target languages of each publication under the four strategies."""
    have = _have(spark, d)
    parts = [G.target_languages(have, k, LANGS, 5).select(F.lit(k).alias("strategy"), "publication_number", "target") for k in (1, 2, 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _balanced_sql() -> str:
    """One step per language, in the order of scarcity; each leaves out what earlier steps took."""
    steps = []
    for k in range(1, len(LANGS) + 1):
        taken = " UNION ALL ".join(f"SELECT publication_number FROM p{j}" for j in range(1, k)) or "SELECT NULL WHERE false"
        steps.append(f"p{k} AS (SELECT publication_number, language FROM hv WHERE language = (SELECT language FROM lo WHERE k = {k}) AND publication_number NOT IN ({taken}) ORDER BY md5('11|' || publication_number), publication_number LIMIT 20)")
    return ", ".join(steps)


@query(
    f"""WITH hv AS (SELECT DISTINCT publication_number, language FROM corpus WHERE {KNOWN} AND language IN ('en', 'de', 'fr', 'es', 'zh')),
    lo AS (SELECT language, row_number() OVER (ORDER BY n, place) AS k FROM (SELECT l.language, l.place, (SELECT count(*) FROM hv WHERE hv.language = l.language) AS n FROM (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3), ('zh', 4)) l(language, place))), {_balanced_sql()}
    {' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 6))}"""
)
def balanced_documents(spark: SparkSession, d: str) -> DataFrame:
    """Twenty publications per language, the scarcest first (a sampling operator)."""
    return G.balanced_documents(_have(spark, d), LANGS, 20, 11)


# ---------------------------------------------------------------- grades


def grade(seed: str, *columns: str) -> F.Column:
    """A grade from 1 to 5 out of a hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), *columns).cast("binary")), 1, 7), 16, 10).cast("long") % 5 + 1).cast("int")


def grade_sql(seed: str, key: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('{seed}' || {key}), 1, 7) AS BIGINT) % 5 + 1 AS INT)"


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, response): graded lists of two candidates in a code fence; every seventh can't be read."""
    q = table(spark, d, "qac", "query_id").where("query_id is not null").distinct()
    one = lambda i: F.struct(*[grade(f"{c}{i}", "query_id").alias(c) for c in G.FAITHFULNESS])
    body = F.to_json(F.struct(F.array(one(0), one(1)).alias("scores")))
    broken = F.conv(F.substring(F.md5(F.col("query_id").cast("binary")), 1, 7), 16, 10).cast("long") % 7 == 0
    return q.select("query_id", F.when(broken, F.lit("no json {")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("response"))


_BROKEN = "CAST('0x' || substr(md5(query_id), 1, 7) AS BIGINT) % 7 = 0"
GRADES = (
    "gr AS (SELECT query_id, CAST(idx AS INT) AS idx, "
    + ", ".join(f"CASE WHEN {_BROKEN} OR idx = 2 THEN 1 WHEN idx = 0 THEN {grade_sql(c + '0', 'query_id')} ELSE {grade_sql(c + '1', 'query_id')} END AS {c}" for c in G.FAITHFULNESS)
    + " FROM (SELECT DISTINCT query_id FROM qac WHERE query_id IS NOT NULL), range(3) t(idx))"
)


@query(f"WITH {GRADES} SELECT query_id, idx, {', '.join(G.FAITHFULNESS)} FROM gr")
def normalized_grades(spark: SparkSession, d: str) -> DataFrame:
    """Three graded candidates per query; missing and unreadable grades are 1."""
    return G.normalized_grades(responses(spark, d), ["query_id"], G.FAITHFULNESS)


_TOTAL = " + ".join(G.FAITHFULNESS)


@query(f"WITH {GRADES} SELECT query_id, idx, CAST(total AS INT) AS total FROM (SELECT query_id, idx, {_TOTAL} AS total, row_number() OVER (PARTITION BY query_id ORDER BY {_TOTAL} DESC, idx) AS r FROM gr) WHERE r = 1")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each query by total, the first on ties."""
    g = G.normalized_grades(responses(spark, d), ["query_id"], G.FAITHFULNESS).withColumn("total", G.faithfulness_total())
    return G.best_per_key(g, ["query_id"], "total").select("query_id", "idx", "total")


_QT = {m: " + ".join(grade_sql(c, "query_id") for c in cs) for m, cs in G.QUALITY.items()}


@query(f"SELECT DISTINCT query_id, mode, CASE WHEN mode = 'technical' THEN {_QT['technical']} ELSE {_QT['semantic_retrieval']} END AS total FROM qac WHERE mode IN ('technical', 'semantic_retrieval')")
def quality_totals(spark: SparkSession, d: str) -> DataFrame:
    """Total quality by the five criteria of a query's mode."""
    q = table(spark, d, "qac", "query_id", "mode").where("mode in ('technical', 'semantic_retrieval')").distinct()
    out = None
    for mode, criteria in G.QUALITY.items():
        part = q.where(F.col("mode") == mode).withColumns({c: grade(c, "query_id") for c in criteria}).select("query_id", "mode", G.quality_total(mode).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


_FLAG = {c: f"{grade_sql(c, 'query_id')} > 1" for c in (*G.HARD_FLAGS, *G.SOFT_FLAGS)}


@query(
    f"""WITH c AS (SELECT query_id, {' AND '.join(_FLAG[c] for c in G.HARD_FLAGS)} AS hard, {' AND '.join(_FLAG[c] for c in G.SOFT_FLAGS)} AS soft, {grade_sql('severity', 'query_id')} AS s FROM (SELECT DISTINCT query_id FROM qac WHERE query_id IS NOT NULL)) SELECT query_id, hard AND (soft OR s <= 2) AS approved, NOT (hard AND (soft OR s <= 2)) AS retry FROM c"""
)
def translation_approval(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on translations from their flags and severity."""
    q = table(spark, d, "qac", "query_id").where("query_id is not null").distinct()
    checks = q.withColumns({c: grade(c, "query_id") > 1 for c in (*G.HARD_FLAGS, *G.SOFT_FLAGS)}).withColumn("severity", F.when(grade("severity", "query_id") > 2, "medium").otherwise("low"))
    return G.translation_approval(checks).select("query_id", "approved", "retry")


@query(
    f"""WITH a AS (SELECT query_id, CAST(t AS INT) AS attempt, CASE t WHEN 1 THEN {grade_sql('try1', 'query_id')} WHEN 2 THEN {grade_sql('try2', 'query_id')} ELSE {grade_sql('try3', 'query_id')} END > 3 AS approved FROM (SELECT DISTINCT query_id FROM qac WHERE query_id IS NOT NULL), range(1, 4) r(t))
    SELECT query_id, attempt, approved FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY approved DESC, CASE WHEN approved THEN attempt ELSE -attempt END) AS r FROM a) WHERE r = 1"""
)
def retry_loop(spark: SparkSession, d: str) -> DataFrame:
    """The attempt that a bounded loop of asking and checking ends with."""
    q = table(spark, d, "qac", "query_id").where("query_id is not null").distinct()
    a = q.withColumn("attempt", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    ok = F.when(F.col("attempt") == 1, grade("try1", "query_id")).when(F.col("attempt") == 2, grade("try2", "query_id")).otherwise(grade("try3", "query_id")) > 3
    return G.retry_loop(q, a.withColumn("approved", ok).withColumn("response", F.lit("r")), ["query_id"]).select("query_id", "attempt", "approved")
