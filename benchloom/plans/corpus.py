"""Queries of corpus extraction and normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from .registry import query, table
from .scalar import CHEMISTRY_SQL, COLLAPSE, WORDS

LANGS = ["en", "de", "fr", "es", "zh"]
IN_LANGS = "(" + ", ".join(f"'{x}'" for x in LANGS) + ")"
LOST = ", ".join(f"'{p}'" for p in C.LOST_PUBLICATIONS)
KNOWN = f"trim(publication_number) NOT IN ('', {LOST})"
LANG = "nullif(lower(trim(language)), '')"
ORDER = ["publication_date", "id", "ipc_codes", "abstract"]  # ascending, nulls first
SQL_ORDER = "publication_date NULLS FIRST, id, ipc_codes NULLS FIRST, abstract NULLS FIRST"


@query(
    f"""SELECT DISTINCT id, publication_number, {LANG} AS language FROM corpus WHERE publication_number IN (
    SELECT trim(publication_number) FROM corpus WHERE {KNOWN} AND {LANG} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {LANG}) >= 2)"""
)
def multilingual_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of publications in two or more languages."""
    rows = C.multilingual(table(spark, d, "corpus", "id", "publication_number", "language"), 2)
    return rows.select("id", "publication_number", C.language_code(F.col("language")).alias("language")).distinct()


@query(
    f"""SELECT n_languages, count(*) AS n_publications FROM (SELECT trim(publication_number) AS p, count(DISTINCT {LANG}) AS n_languages FROM corpus WHERE {KNOWN} AND {LANG} IS NOT NULL GROUP BY 1) GROUP BY 1"""
)
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Publications by their number of languages."""
    return C.languages_of_publications(table(spark, d, "corpus", "publication_number", "language")).groupBy("n_languages").agg(F.count("*").alias("n_publications"))


@query(f"SELECT {LANG} AS language, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM corpus GROUP BY 1")
def rows_per_language(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct ids of each label."""
    c = table(spark, d, "corpus", "id", "language").withColumn("language", C.language_code(F.col("language")))
    return c.groupBy("language", "id").agg(F.count("*").alias("n")).groupBy("language").agg(F.sum("n").alias("n_rows"), F.count("id").alias("n_ids"))


@query(
    f"""SELECT language, publication_number, id FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {SQL_ORDER}) AS r2 FROM (
      SELECT id, {LANG} AS language, publication_number, publication_date, ipc_codes, abstract, row_number() OVER (PARTITION BY {LANG}, publication_number ORDER BY {SQL_ORDER}) AS r1
      FROM corpus WHERE {LANG} IN {IN_LANGS} AND {KNOWN} AND (trim(title) != '' OR trim(abstract) != ''))
    WHERE r1 = 1 AND {WORDS.format('abstract')} >= 50) WHERE r2 <= 300"""
)
def preprocessed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """First row per language and publication, then the word gate, then the cap per language."""
    c = table(spark, d, "corpus", "id", "language", "title", "abstract", "publication_number", "publication_date", "ipc_codes")
    return C.preprocess(c, LANGS, 300, 50, ORDER).select("language", "publication_number", "id")


@query(
    f"SELECT DISTINCT id, {COLLAPSE.format("coalesce(title, '')")} AS title, {COLLAPSE.format("coalesce(context, '')")} AS context FROM corpus WHERE "
    + WORDS.format("abstract")
    + " >= 30"
)
def merged_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the merged corpus with white space collapsed."""
    c = table(spark, d, "corpus", "id", "title", "abstract", "first_claim", "context")
    return C.merge(c, 30).select("id", "title", "context").distinct()


@query(
    f"""SELECT language, rank, publication_number FROM (SELECT language, publication_number, row_number() OVER (PARTITION BY language ORDER BY day DESC, publication_number DESC) AS rank FROM (
      SELECT {LANG} AS language, publication_number, max(coalesce(replace(publication_date, '-', ''), '')) AS day FROM corpus
      WHERE {LANG} IN {IN_LANGS} AND trim(abstract) != '' AND {KNOWN} GROUP BY 1, 2)) WHERE rank <= 22"""
)
def top_n_per_language(spark: SparkSession, d: str) -> DataFrame:
    """The newest publications of each language, overfetched for later gates."""
    c = table(spark, d, "corpus", "language", "abstract", "publication_number", "publication_date")
    return C.top_n_per_language(c, LANGS, C.overfetch(12)).select("language", "rank", "publication_number")


@query(
    """SELECT DISTINCT c.id, c.publication_number, h.publication_number IS NOT NULL AS in_list FROM corpus c LEFT JOIN (SELECT DISTINCT publication_number FROM hard_negatives) h USING (publication_number)
    WHERE h.publication_number IS NOT NULL OR len(list_filter(string_split(coalesce(ipc_codes, ''), '|'), lambda x: starts_with(upper(replace(x, ' ', '')), 'A61K') OR starts_with(upper(replace(x, ' ', '')), 'C07'))) > 0"""
)
def classification_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows by code prefix or by a list of publications (here those of the look-alikes)."""
    c = table(spark, d, "corpus", "id", "publication_number", "ipc_codes")
    rows = C.with_classification(c, ["A61K", "C07"], table(spark, d, "hard_negatives", "publication_number"))
    return rows.select("id", "publication_number", "in_list").distinct()


@query(
    f"""SELECT publication_number, CASE max(CASE label WHEN 'core' THEN 2 WHEN 'related' THEN 1 ELSE 0 END) WHEN 2 THEN 'core' WHEN 1 THEN 'related' ELSE 'not_chemistry' END AS label FROM ({CHEMISTRY_SQL}) WHERE {KNOWN} GROUP BY 1"""
)
def strongest_label(spark: SparkSession, d: str) -> DataFrame:
    """Strongest chemistry label of each publication."""
    return C.strongest_label(C.chemistry_label(table(spark, d, "corpus", "publication_number", "title", "ipc_codes")))


RICH = "length(coalesce(abstract, '')) + length(coalesce(first_claim, '')) + length(coalesce(description, '')) // 4"


@query(
    f"""SELECT publication_number, language, id, CAST(richness AS INT) AS richness FROM (SELECT publication_number, {LANG} AS language, id, {RICH} AS richness,
    row_number() OVER (PARTITION BY publication_number, {LANG} ORDER BY {RICH} DESC, {SQL_ORDER}) AS r FROM corpus WHERE {LANG} IS NOT NULL AND {KNOWN}) WHERE r = 1"""
)
def richest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The richest row of each publication and language."""
    c = table(spark, d, "corpus", "id", "language", "abstract", "first_claim", "description", "publication_number", "publication_date", "ipc_codes").withColumn("language", C.language_code(F.col("language")))
    return C.richest(c.where("language is not null"), ORDER).select("publication_number", "language", "id", "richness")


@query(
    f"""SELECT publication_number, language, text FROM (SELECT publication_number, {LANG} AS language, abstract AS text, row_number() OVER (PARTITION BY publication_number, {LANG} ORDER BY length(abstract) DESC, {SQL_ORDER}) AS r
    FROM corpus WHERE {LANG} IS NOT NULL AND {KNOWN} AND trim(abstract) != '') WHERE r = 1"""
)
def merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The longest abstract of each publication and language."""
    c = table(spark, d, "corpus", "id", "language", "abstract", "publication_number", "publication_date", "ipc_codes").withColumn("language", C.language_code(F.col("language")))
    return C.merged_blocks(c.where("language is not null"), "abstract", ORDER)


@query(
    f"""SELECT publication_number, string_agg(code, '|' ORDER BY code) AS codes, count(*) AS n_codes FROM (SELECT DISTINCT publication_number, trim(unnest(string_split(ipc_codes, '|'))) AS code FROM corpus WHERE {KNOWN}) WHERE code != '' GROUP BY 1"""
)
def merged_codes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct codes of each publication."""
    return C.merged_codes(table(spark, d, "corpus", "publication_number", "ipc_codes"))


_SUBSTANTIVE = f"({WORDS.format('abstract')} >= 50 OR {WORDS.format('first_claim')} >= 10)"


@query(
    f"""WITH u AS (SELECT *, {LANG} AS lang FROM corpus WHERE {LANG} IN {IN_LANGS} AND {KNOWN}),
    l AS (SELECT publication_number, max(CASE label WHEN 'core' THEN 2 WHEN 'related' THEN 1 ELSE 0 END) AS r FROM (SELECT x.publication_number, x.label FROM ({CHEMISTRY_SQL}) x JOIN (SELECT DISTINCT id, publication_number FROM u) y ON x.id = y.id) GROUP BY 1),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY publication_number, lang ORDER BY {RICH} DESC, {SQL_ORDER}) AS k FROM u) WHERE k = 1 AND {_SUBSTANTIVE}),
    c AS (SELECT publication_number FROM r GROUP BY 1 HAVING count(*) >= 2)
    SELECT r.publication_number, r.lang AS language, r.id, CASE l.r WHEN 2 THEN 'core' ELSE 'related' END AS label FROM r JOIN c USING (publication_number) JOIN l USING (publication_number) WHERE l.r > 0"""
)
def accumulated_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the accumulator emits: labelled publications with two covered languages."""
    c = table(spark, d, "corpus", "id", "language", "title", "abstract", "first_claim", "description", "publication_number", "publication_date", "ipc_codes")
    return C.materialize(c, LANGS, 2, False, ORDER).select("publication_number", "language", "id", "label")


@query(
    f"""SELECT DISTINCT id, publication_number FROM corpus WHERE publication_date >= '2016' AND publication_number NOT IN (SELECT publication_number FROM corpus WHERE publication_date < '2016' AND {KNOWN}) AND publication_number IS NOT NULL"""
)
def append_new_publications(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch (later years) whose publications no earlier batch has written."""
    c = table(spark, d, "corpus", "id", "publication_number", "publication_date").where("publication_number is not null")
    return C.anti_committed(c.where("publication_date >= '2016'"), c.where("publication_date < '2016'")).select("id", "publication_number").distinct()


@query(
    """SELECT item_id, item_name, kind FROM (SELECT DISTINCT item_id, item_name, item_published_at, CASE WHEN lower(item_name) LIKE '%.zip' THEN 'zip' WHEN lower(item_name) LIKE '%.tar.gz' OR lower(item_name) LIKE '%.tgz' THEN 'tar_gz' WHEN lower(item_name) LIKE '%.tar' THEN 'tar' ELSE 'unknown' END AS kind
    FROM ingest_items WHERE item_id NOT IN (SELECT item_id FROM ingest_items WHERE processed_at <= item_published_at + INTERVAL 7 DAY)) ORDER BY item_published_at DESC, item_id DESC LIMIT 10"""
)
def next_items(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest items that weren't processed within a week, with the kind of archive."""
    from ..sources.archives import archive_kind

    items = table(spark, d, "ingest_items", "item_id", "item_name", "item_published_at").distinct()
    done = table(spark, d, "ingest_items", "item_id", "item_published_at", "processed_at").where("processed_at <= item_published_at + interval 7 days")
    return C.next_items(items, done, 10).select("item_id", "item_name", archive_kind(F.col("item_name")).alias("kind"))


@query(
    """SELECT delivery_id, count(*) AS n_items, count(processed_at) AS n_processed, CAST(sum(xml_files_seen) AS BIGINT) AS files, CAST(sum(xml_parse_errors) AS BIGINT) AS errors, CAST(sum(rows_appended) AS BIGINT) AS appended
    FROM (SELECT DISTINCT * FROM ingest_items) GROUP BY 1"""
)
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Manifest counts by delivery; repeated rows count once."""
    m = table(spark, d, "ingest_items").distinct()
    return m.groupBy("delivery_id").agg(F.count("*").alias("n_items"), F.count("processed_at").alias("n_processed"), F.sum("xml_files_seen").alias("files"), F.sum("xml_parse_errors").alias("errors"), F.sum("rows_appended").alias("appended"))


_DAY = r"CASE WHEN regexp_matches(replace(publication_date, '-', ''), '^\d{8}$') AND replace(publication_date, '-', '') != '00000000' THEN replace(publication_date, '-', '') END"


@query(
    f"""WITH g AS (SELECT trim(publication_number) AS publication_number, max({_DAY}) AS day, list(DISTINCT CASE WHEN trim(abstract) != '' AND {LANG} IN {IN_LANGS} THEN {LANG} END) AS ls,
      bool_or(len(list_filter(string_split(coalesce(ipc_codes, ''), '|'), lambda x: starts_with(upper(replace(x, ' ', '')), 'A61K') OR starts_with(upper(replace(x, ' ', '')), 'C0'))) > 0) AS code,
      bool_or(coalesce({LANG} = 'en' AND trim(abstract) != '' AND length(abstract) >= 200, false)) AS main, bool_or(coalesce({LANG} = 'en' AND trim(first_claim) != '', false)) AS claim
      FROM corpus WHERE {KNOWN} AND upper(trim(country_code)) IN ('EP', 'US', 'WO') GROUP BY 1)
    SELECT publication_number, day, array_to_string(list_sort(list_filter(ls, lambda x: x IS NOT NULL)), ',') AS languages FROM g LEFT JOIN (SELECT DISTINCT publication_number AS p FROM hard_negatives) h ON h.p = g.publication_number
    WHERE (code OR h.p IS NOT NULL) AND day BETWEEN '20120101' AND '20211231' AND main AND claim AND len(list_filter(ls, lambda x: x IS NOT NULL)) >= 2"""
)
def extracted_publications(spark: SparkSession, d: str) -> DataFrame:
    """Publications by codes or a list, days, countries, an English abstract and claim, and two languages."""
    c = table(spark, d, "corpus", "publication_number", "publication_date", "country_code", "language", "abstract", "first_claim", "description", "ipc_codes")
    return C.extracted(c, ["A61K", "C0"], table(spark, d, "hard_negatives", "publication_number"), "20120101", "20211231", ["EP", "US", "WO"], "en", 200, True, False, LANGS, 2)
