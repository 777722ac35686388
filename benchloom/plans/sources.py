"""Queries that take the corpus through each source format and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as S
from .registry import query, table
from .scalar import COLLAPSE, _truncated, first_claim_sql

_PLAIN = lambda c: f"nullif({COLLAPSE.format(c)}, '')"


@query(
    rf"""SELECT DISTINCT id, {_PLAIN('title')} IS NOT NULL AND id != '' AS valid, language, {_PLAIN('title')} AS title, {_PLAIN('abstract')} AS abstract, nullif(trim(regexp_replace({COLLAPSE.format("'1. ' || coalesce(first_claim, '')")}, '^\s*1\s*[.):\-]*\s*', '')), '') AS claim,
    'Inv One|Inv Two' AS inventors, 'Co ' || id AS applicants, 'DE|FR' AS states, 'P' || id AS priority_numbers, '20190101' AS priority_dates FROM corpus WHERE id IS NOT NULL"""
)
def markup_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every row written as patent mark-up, escaped, whatever its label and blank fields, and parsed again; without a title it isn't valid."""
    c = table(spark, d, "corpus", "id", "language", "title", "abstract", "first_claim").where("id is not null").distinct()
    e = {k: T.escape_markup(F.col(k)) for k in c.columns}
    party = lambda name: f"<B721><snm>{name}</snm></B721>"
    xml = F.concat(
        F.lit('<ep-patent-document id="'), e["id"], F.lit('" doc-number="1" country="EP" kind="A1" date-publ="20200101" lang="en"><SDOBI><B300><B310>P'), e["id"], F.lit("</B310><B320><date>20190101</date></B320></B300><B500><B540><B541>"), e["language"], F.lit("</B541><B542>"), e["title"],
        F.lit(f"</B542></B540></B500><B700><B710><B711><snm>Co "), e["id"], F.lit(f"</snm></B711></B710><B720>{party('Inv One')}{party(' Inv  Two')}{party('Inv One')}</B720></B700><B800><B840><ctry>de</ctry><ctry>FR</ctry><ctry>DE</ctry></B840></B800></SDOBI><abstract lang=\""), e["language"], F.lit('"><p>'), e["abstract"],
        F.lit('</p></abstract><claims lang="'), e["language"], F.lit('"><claim><claim-text>1. '), e["first_claim"], F.lit("</claim-text></claim></claims></ep-patent-document>"),
    )
    p = S.parse_patents(c.select("id", "language", xml.alias("xml")))
    first = lambda block: F.try_element_at(block, F.lit(1))["text"]
    lists = {k: F.array_join(k, "|").alias(k) for k in ("inventors", "applicants", "states", "priority_numbers", "priority_dates")}
    return p.select("id", "valid", "language", first(F.col("title_localized")).alias("title"), first(F.col("abstract_localized")).alias("abstract"), first(F.col("claims_localized")).alias("claim"), *lists.values())


@query(
    f"""WITH x AS (SELECT DISTINCT id, coalesce(trim(title), '') AS title, coalesce(trim(abstract), '') AS abstract, CASE WHEN trim(first_claim) != '' THEN {first_claim_sql('trim(first_claim)')} ELSE '' END AS c FROM corpus WHERE id IS NOT NULL)
    SELECT id || '_en' AS id, title, abstract, {_truncated('c', T.MAX_CLAIM_CHARS)} AS first_claim FROM x WHERE title != '' OR abstract != ''"""
)
def record_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every row as a raw record with localized blocks named EN, projected to the language again; rows with neither title nor abstract give none."""
    c = table(spark, d, "corpus", "id", "title", "abstract", "first_claim").where("id is not null").distinct()
    block = lambda x: F.array(F.struct(F.lit("xx").alias("language"), F.lit("no").alias("text")), F.struct(F.lit("EN").alias("language"), F.col(x).alias("text")))
    text = F.to_json(F.struct(F.col("id").alias("publication_number"), block("title").alias("title_localized"), block("abstract").alias("abstract_localized"), block("first_claim").alias("claims_localized")))
    r = c.select(F.from_json(text, S.RECORD_SCHEMA).alias("r")).select("r.*")
    return S.records_to_rows(r, ["en"]).select("id", "title", "abstract", "first_claim")


@query(
    "SELECT DISTINCT chebi_id AS child, 'CHEBI:' || (970000 + (CAST(substr(chebi_id, 7) AS INT) - 970000) // 6) AS parent FROM concept_names WHERE CAST(substr(chebi_id, 7) AS INT) > 970000 AND lang = 'en'"
)
def ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    """Concepts written as ontology stanzas and parsed again."""
    n = F.substring("chebi_id", 7, 20).cast("int") - 970000
    c = table(spark, d, "concept_names").where((F.col("lang") == "en") & (n > 0)).select("chebi_id", n.alias("n")).distinct()
    stanza = F.concat(F.lit("[Term]\nid: "), "chebi_id", F.lit('\nname: x\nsynonym: "a \\"b\\"" EXACT []\nis_a: CHEBI:'), (970000 + F.floor(F.col("n") / 6)).cast("int").cast("string"), F.lit(" ! parent\n"))
    return S.parse_ontology(c.select(stanza.alias("stanza")))[1]


@query(
    """SELECT m AS model, q AS query_id, c AS corpus_id, CAST(length(c) AS DOUBLE) AS score FROM (SELECT DISTINCT "query-id" AS q, "corpus-id" AS c FROM qrels WHERE "query-id" IS NOT NULL AND "corpus-id" IS NOT NULL), (VALUES ('alpha')) t(m)"""
)
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as nested JSON, one document per query here, and flattened."""
    q = table(spark, d, "qrels").select(F.col("query-id").alias("q"), F.col("corpus-id").alias("c")).where("q is not null and c is not null").distinct()
    docs = q.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("c", F.length("c").cast("double")))).alias("m"))
    nested = F.create_map(F.lit("default"), F.create_map(F.lit("test"), F.create_map(F.col("q"), F.col("m"))))
    return S.read_predictions(docs.select(F.lit("alpha").alias("model"), F.to_json(nested).alias("json")))


@query("SELECT DISTINCT chebi_id FROM concept_names WHERE chebi_id NOT IN (SELECT chebi_id FROM concept_names WHERE lang = 'es')")
def lookups_missing(spark: SparkSession, d: str) -> DataFrame:
    """Concepts without a Spanish name, to be looked up."""
    c = table(spark, d, "concept_names", "chebi_id", "lang")
    return S.lookup_missing(c, c.where("lang = 'es'"), "chebi_id")
