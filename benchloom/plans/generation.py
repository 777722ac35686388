"""Queries of the generation pipelines over recorded responses.

What a model would answer follows from hashes of the keys, so each pipeline runs whole and SQL can follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import generation as N
from ..operators import grading as G
from ..operators.corpus import known
from .concepts import DOCS, HITS, INDEX, PUBS, concept_names, pubs
from .corpus import KNOWN
from .grading import grade, grade_sql
from .registry import query, table
from .variants import LADDER, SWITCHED, code_switched, swap_ladder


def _pairs(key: Column, n: int = 2) -> Column:
    """A recorded response with ``n`` pairs of question and answer."""
    pair = lambda i: F.struct(F.concat(F.lit(f"Q{i} of "), key).alias("question"), F.concat(F.lit(f"A{i} of "), key).alias("answer"))
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(*map(pair, range(n))).alias("pairs"))), F.lit("\n```"))


def _scores(criteria: tuple[str, ...], key: str, n: int = 2) -> Column:
    one = lambda i: F.struct(*[grade(f"{c}{i}", key).alias(c) for c in criteria])
    return F.to_json(F.struct(F.array(*map(one, range(n))).alias("scores")))


MODE = "technical"
_FAITH = {i: " + ".join(grade_sql(f"{c}{i}", "id") for c in G.FAITHFULNESS) for i in range(2)}
_QUAL = {i: " + ".join(grade_sql(f"{c}{i}", "id") for c in G.QUALITY[MODE]) for i in range(2)}


@query(
    f"""WITH s AS (SELECT DISTINCT id, trim(publication_number) AS pub, lower(trim(language)) AS language FROM corpus WHERE id IS NOT NULL AND {KNOWN} AND trim(context) != ''),
    c AS (SELECT id, pub, language, i, CASE i WHEN 0 THEN {_FAITH[0]} ELSE {_FAITH[1]} END AS f, CASE i WHEN 0 THEN {_QUAL[0]} ELSE {_QUAL[1]} END AS q FROM s, range(2) t(i))
    SELECT id AS corpus_id, pub AS publication_number, coalesce(language, '') AS question_language, 'Q' || i || ' of ' || id AS question, 'A' || i || ' of ' || id AS answer, CAST(f AS VARCHAR) AS faith_overall, CAST(q AS VARCHAR) AS qual_overall, CAST(f + q AS VARCHAR) AS total_score
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f + q DESC, i) AS r FROM c) WHERE r = 1"""
)
def qa_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Two candidates for each document, graded twice, the best one kept and given the published columns."""
    c = table(spark, d, "corpus", "id", "publication_number", "language", "context").where(F.col("id").isNotNull() & known("publication_number") & (F.trim("context") != ""))
    docs = c.select(F.col("id").alias("corpus_id"), F.trim("publication_number").alias("publication_number"), F.lower(F.trim("language")).alias("question_language"), F.col("context").alias("text")).dropDuplicates(["corpus_id"])
    keys = docs.select("corpus_id")
    said = lambda body: N.recorded(keys.select("corpus_id", body.alias("response")))
    graded = N.graded_pairs(docs, ["corpus_id"], MODE, said(_pairs(F.col("corpus_id"))), said(_scores(G.FAITHFULNESS, "corpus_id")), said(_scores(G.QUALITY[MODE], "corpus_id")))
    best = N.best_pairs(graded, ["corpus_id"]).join(docs.drop("text"), "corpus_id")
    out = N.with_schema(best, schemas.graded_qa(MODE))
    return out.select("corpus_id", "publication_number", "question_language", "question", "answer", "faith_overall", "qual_overall", "total_score")


@query(
    f"""WITH {INDEX}, {DOCS}, {HITS}, {PUBS}, al AS (SELECT concept, min(surface) AS one, list(DISTINCT lower(surface)) AS names FROM nm GROUP BY 1),
    q AS (SELECT p.concept, p.pub, CASE WHEN {grade_sql('leak', "p.concept || p.pub")} = 1 THEN 'Why is ' || one || ' used in ' || p.pub || '?' ELSE 'Which substance is used in ' || p.pub || '?' END AS question, names FROM pubs p JOIN al USING (concept))
    SELECT concept, pub, question FROM q WHERE len(list_filter(names, lambda n: trim(n) != '' AND contains(lower(question), n))) = 0"""
)
def concept_qa(spark: SparkSession, d: str) -> DataFrame:
    """Questions about concepts of publications; those that give a name of the concept away are dropped."""
    names = concept_names(spark, d).groupBy("concept").agg(F.min("surface").alias("one"), F.collect_set("surface").alias("aliases"))
    leak = grade("leak", "concept", "pub") == 1
    said = F.when(leak, F.concat(F.lit("Why is "), "one", F.lit(" used in "), "pub", F.lit("?"))).otherwise(F.concat(F.lit("Which substance is used in "), "pub", F.lit("?")))
    return N.concept_questions(pubs(spark, d).join(names, "concept").withColumn("question", said)).select("concept", "pub", "question")


@query(
    f"""WITH {SWITCHED}, q AS (SELECT DISTINCT source_id, concept, original_term AS term, 'What does ' || CASE WHEN {grade_sql('term', 'source_id || concept')} = 1 THEN 'it' ELSE original_term END || ' do?' AS question FROM cs WHERE variant NOT IN ('A', 'E'))
    SELECT c.source_id, c.concept, q.term, q.question, c.variant, c.source_id || '__' || c.variant || '__' || c.concept AS id FROM cs c JOIN q ON q.source_id = c.source_id AND q.concept = c.concept AND q.term = c.original_term WHERE c.variant NOT IN ('A', 'E') AND contains(q.question, q.term)"""
)
def variant_qa(spark: SparkSession, d: str) -> DataFrame:
    """One question per source, concept and term, which must hold the term, given to every variant of the group."""
    v = code_switched(spark, d).select("source_id", "concept", F.col("original_term").alias("term"), "variant", "id")
    groups = G.group_variants(v)
    said = F.concat(F.lit("What does "), F.when(grade("term", "source_id", "concept") == 1, "it").otherwise(F.col("term")), F.lit(" do?"))
    queries = N.term_questions(groups.select("source_id", "concept", "term").withColumn("question", said))
    return N.spread_over_variants(queries, groups)


@query(
    f"WITH {LADDER} SELECT base_id, l AS language, 'What is it in ' || base_id || '?' AS question, depth, base_id || '__r' || depth AS id FROM ld, (VALUES ('en'), ('de')) t(l)"
)
def progressive_qa(spark: SparkSession, d: str) -> DataFrame:
    """One question per base and target language, given to every rung of its ladder."""
    rungs = swap_ladder(spark, d).select("base_id", "depth", "id")
    bases = rungs.where("depth = 0").select("base_id", F.explode(F.array(F.lit("en"), F.lit("de"))).alias("language"))
    queries = bases.withColumn("question", F.concat(F.lit("What is it in "), "base_id", F.lit("?")))
    return N.spread_over_depths(queries, rungs)
