"""Queries of benchmark packaging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packaging as P
from .analysis import PRED, predictions
from .registry import query, table

LOST = ("EP-0000000-A0",)


@query(
    "SELECT DISTINCT id AS _id, coalesce(title, '') AS title, coalesce(CASE WHEN trim(context) != '' THEN context END, CASE WHEN trim(abstract) != '' THEN abstract END, '') AS text, language AS corpus_language, publication_number FROM corpus WHERE trim(id) != ''"
)
def corpus_config(spark: SparkSession, d: str) -> DataFrame:
    """The published corpus."""
    return P.corpus_table(table(spark, d, "corpus", "id", "title", "abstract", "context", "language", "publication_number")).distinct()


@query(
    """SELECT CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS _id, query_id, text, query_language, corpus_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY query_id) AS n FROM (
    SELECT DISTINCT query_id, corpus_id || '__q_' || coalesce(lower(query_language), 'xx') AS base, question AS text, coalesce(nullif(lower(trim(query_language)), ''), nullif(lower(trim(corpus_language)), '')) AS query_language, corpus_id FROM qac WHERE corpus_id IS NOT NULL))"""
)
def queries_config(spark: SparkSession, d: str) -> DataFrame:
    """The published queries, with a running number where ids would collide."""
    q = table(spark, d, "qac", "query_id", "corpus_id", "query_language", "corpus_language", "question").where("corpus_id is not null").distinct()
    base = F.concat("corpus_id", F.lit("__q_"), F.coalesce(F.lower("query_language"), F.lit("xx")))
    out = P.numbered_ids(q, base, ["query_id"])
    return out.select("_id", "query_id", F.col("question").alias("text"), P.query_language(F.col("query_language"), F.col("corpus_language")).alias("query_language"), "corpus_id")


ML = """ml AS (SELECT DISTINCT q.query_id AS "query-id", coalesce(c.id, q.corpus_id) AS "corpus-id", CAST(1 AS DOUBLE) AS score FROM (SELECT DISTINCT query_id, corpus_id, publication_number FROM qac) q LEFT JOIN (SELECT DISTINCT publication_number, id FROM corpus WHERE trim(publication_number) != '' AND publication_number != 'EP-0000000-A0') c USING (publication_number) WHERE coalesce(c.id, q.corpus_id) IS NOT NULL)"""


def multilingual(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qac", "query_id", "corpus_id", "publication_number")
    return P.multilingual_qrels(q, table(spark, d, "corpus", "id", "publication_number"), LOST)


@query(f'WITH {ML} SELECT "query-id", "corpus-id", score FROM ml')
def qrels_multilingual(spark: SparkSession, d: str) -> DataFrame:
    """All documents of a query's publication are relevant."""
    return multilingual(spark, d)


QLANG = """qlg AS (SELECT query_id AS "query-id", max(lower(query_language)) AS query_language FROM qac GROUP BY 1), clg AS (SELECT id AS "corpus-id", max(lower(trim(language))) AS corpus_language FROM corpus GROUP BY 1)"""


def languages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "qac", "query_id", "query_language").groupBy(F.col("query_id").alias("query-id")).agg(F.max(F.lower("query_language")).alias("query_language"))
    c = table(spark, d, "corpus", "id", "language").groupBy(F.col("id").alias("corpus-id")).agg(F.max(F.lower(F.trim("language"))).alias("corpus_language"))
    return q, c


@query(
    f"""WITH {ML}, {QLANG}, x AS (SELECT ml.*, coalesce(query_language != corpus_language, false) AS f FROM ml LEFT JOIN qlg USING ("query-id") LEFT JOIN clg USING ("corpus-id")) SELECT "query-id", "corpus-id", score FROM (SELECT *, bool_or(f) OVER (PARTITION BY "query-id") AS has FROM x) WHERE f OR NOT has"""
)
def qrels_cross_language(spark: SparkSession, d: str) -> DataFrame:
    """Relevant documents in another language, or all where there is none."""
    return P.cross_language_qrels(multilingual(spark, d), *languages(spark, d))


@query("""SELECT "query-id", "corpus-id", max(score) AS score FROM qrels GROUP BY 1, 2""")
def qrels_graded(spark: SparkSession, d: str) -> DataFrame:
    """Gold and look-alike judgements, gold winning."""
    q = table(spark, d, "qrels")
    return P.graded_qrels(q.where("score = 1"), q.where("score = 0"))


@query("""SELECT DISTINCT query_id AS "query-id", corpus_id AS "corpus-id", CAST(1 AS DOUBLE) AS score FROM qac WHERE query_id IS NOT NULL AND corpus_id IS NOT NULL""")
def qrels_source(spark: SparkSession, d: str) -> DataFrame:
    """Each query with the document it was written for."""
    q = table(spark, d, "qac", "query_id", "corpus_id").where("query_id is not null and corpus_id is not null").distinct()
    return q.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), F.lit(1.0).alias("score"))


@query(
    """WITH n AS (SELECT chebi_id, min(title) AS name FROM concept_names WHERE lang = 'en' AND trim(title) != '' GROUP BY 1)
    SELECT h."query-id", h."corpus-id", h.publication_number, h.neighbor_chebi_id, coalesce(CASE WHEN trim(h.neighbor_name) != '' THEN h.neighbor_name END, n.name) AS neighbor_name, h.relation FROM (SELECT DISTINCT * FROM hard_negatives) h LEFT JOIN n ON n.chebi_id = h.neighbor_chebi_id"""
)
def hard_negative_labels(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives with the neighbor's name filled in."""
    names = table(spark, d, "concept_names").where("lang = 'en' and trim(title) != ''").groupBy(F.col("chebi_id").alias("concept")).agg(F.min("title").alias("name"))
    return P.hard_negative_labels(table(spark, d, "hard_negatives"), names)


@query(
    f"""WITH {PRED}, {QLANG}, qr AS (SELECT "query-id" AS query_id, "corpus-id" AS corpus_id, max(score) AS relevance FROM qrels GROUP BY 1, 2)
    SELECT model, rk.query_id, rk.corpus_id, rank, round(rk.score, 6) AS score, query_language, corpus_language, coalesce(relevance, CAST(0 AS DOUBLE)) AS relevance FROM rk LEFT JOIN qr USING (query_id, corpus_id) LEFT JOIN qlg ON qlg."query-id" = rk.query_id LEFT JOIN clg ON clg."corpus-id" = rk.corpus_id WHERE rank <= 3 AND query_language IS NOT NULL AND corpus_language IS NOT NULL"""
)
def scored_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents per model and query, with languages and relevance."""
    q = table(spark, d, "qrels").groupBy("query-id", "corpus-id").agg(F.max("score").alias("score"))
    ql, cl = languages(spark, d)
    out = P.scored_rankings(predictions(spark, d), q, ql.where("query_language is not null"), cl.where("corpus_language is not null"), 3)
    known = out.join(ql.where("query_language is not null").select(F.col("query-id").alias("query_id")), "query_id", "left_semi").join(cl.where("corpus_language is not null").select(F.col("corpus-id").alias("corpus_id")), "corpus_id", "left_semi")
    return known.withColumn("score", F.round("score", 6))


@query(
    """WITH own AS (SELECT DISTINCT id, title FROM corpus WHERE country_code = 'JP'), sh AS (SELECT DISTINCT id, title FROM corpus WHERE country_code = 'EP')
    SELECT id, title FROM sh UNION ALL SELECT id, title FROM own WHERE id IN (SELECT "corpus-id" FROM qrels) AND id NOT IN (SELECT id FROM sh)"""
)
def shared_corpus(spark: SparkSession, d: str) -> DataFrame:
    """One corpus (EP) with the judged documents of another (JP)."""
    c = table(spark, d, "corpus", "id", "title", "country_code")
    pick = lambda x: c.where(F.col("country_code") == x).select("id", "title").distinct()
    return P.shared_corpus(pick("JP"), pick("EP"), table(spark, d, "qrels", "corpus-id"))


_DOCS = """dd AS (SELECT id, any_value(publication_number) AS publication_number, any_value(nullif(lower(trim(language)), '')) AS language, any_value(abstract) AS text FROM corpus WHERE id IS NOT NULL AND trim(publication_number) != '' AND publication_number != 'EP-0000000-A0' GROUP BY 1)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus", "id", "publication_number", "language", "abstract").where("id is not null and trim(publication_number) != '' and publication_number != 'EP-0000000-A0'")
    return c.select("id", "publication_number", F.nullif(F.lower(F.trim("language")), F.lit("")).alias("language"), F.col("abstract").alias("text")).dropDuplicates(["id"])


@query(f"WITH {_DOCS} SELECT publication_number, string_agg('[' || upper(language) || '] Passage:' || chr(10) || text, chr(10) || chr(10) ORDER BY language, id) AS text FROM dd WHERE language IS NOT NULL AND trim(text) != '' GROUP BY 1")
def passages(spark: SparkSession, d: str) -> DataFrame:
    """Labelled passages of each publication."""
    return P.passages(docs(spark, d).where("language is not null and trim(text) != ''"))


@query(f"WITH {_DOCS} SELECT publication_number, id, language FROM (SELECT *, row_number() OVER (PARTITION BY publication_number ORDER BY CASE WHEN language = 'fr' THEN 0 WHEN language = 'en' THEN 1 ELSE 2 END, id) AS r FROM dd) WHERE r = 1")
def picked_context(spark: SparkSession, d: str) -> DataFrame:
    """The French document of a publication, else the English, else the first."""
    return P.pick_context(docs(spark, d), "fr").select("publication_number", "id", "language")


@query(
    f"""WITH {_DOCS}, l AS (SELECT publication_number, list(DISTINCT language) AS s FROM dd WHERE language IS NOT NULL GROUP BY 1) SELECT publication_number, array_to_string(list_concat(list_filter(['en', 'de', 'fr', 'es', 'zh'], lambda x: list_contains(s, x)), list_sort(list_filter(s, lambda x: NOT list_contains(['en', 'de', 'fr', 'es', 'zh'], x)))), ',') AS languages FROM l"""
)
def context_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of each publication in a fixed order."""
    g = docs(spark, d).where("language is not null").groupBy("publication_number").agg(F.collect_set("language").alias("s"))
    return g.select("publication_number", P.context_languages(F.col("s"), ("en", "de", "fr", "es", "zh")).alias("languages"))


@query(
    f"""WITH {_DOCS}, neg AS (SELECT DISTINCT neighbor_chebi_id AS concept, publication_number AS pub, relation FROM hard_negatives WHERE publication_number IS NOT NULL), gold AS (SELECT DISTINCT h.neighbor_chebi_id AS concept, q.publication_number AS pub FROM hard_negatives h JOIN qac q ON q.query_id = h."query-id")
    SELECT concept, role, relation, id FROM (SELECT concept, pub, 'gold' AS role, NULL::VARCHAR AS relation FROM gold UNION ALL SELECT concept, pub, 'hard_negative', relation FROM neg) JOIN dd ON dd.publication_number = pub"""
)
def concept_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents of a concept's publications, by role."""
    h = table(spark, d, "hard_negatives", "query-id", "publication_number", "neighbor_chebi_id", "relation")
    neg = h.where("publication_number is not null").select(F.col("neighbor_chebi_id").alias("concept"), F.col("publication_number").alias("pub"), "relation").distinct()
    q = table(spark, d, "qac", "query_id", "publication_number")
    gold = h.join(q, F.col("query-id") == q["query_id"]).select(F.col("neighbor_chebi_id").alias("concept"), q["publication_number"].alias("pub")).distinct()
    return P.concept_documents(gold, neg, docs(spark, d).select("id", F.col("publication_number").alias("pub")))


@query(
    """SELECT query_id, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 'B' ELSE 'F' END AS mode FROM (SELECT DISTINCT query_id, length(question) AS n FROM qac WHERE question IS NOT NULL)"""
)
def last_step_mode(spark: SparkSession, d: str) -> DataFrame:
    """Mode of the last ladder step out of its JSON (built here from the length of the question)."""
    q = table(spark, d, "qac", "query_id", "question").where("question is not null").select("query_id", F.length("question").alias("n")).distinct()
    steps = F.when(F.col("n") % 3 == 0, "[]").when(F.col("n") % 3 == 1, '[{"step":1,"mode":"C"},{"step":2,"mode":"B"}]').otherwise('[{"step":1,"mode":"F"}]')
    return q.select("query_id", P.last_step_mode(steps).alias("mode"))
