"""Queries of scalar functions over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

COLLAPSE = r"trim(regexp_replace({0}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"
WORDS = r"coalesce(len(list_filter(regexp_split_to_array({0}, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda w: w != '')), 0)"


@query(f"SELECT id, CAST({WORDS.format('abstract')} AS INT) AS abstract_words, CAST({WORDS.format('first_claim')} AS INT) AS claim_words, coalesce({WORDS.format('abstract')} >= 50 OR {WORDS.format('first_claim')} >= 10, false) AS substantive FROM corpus")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Word counts and the gate on substantive text; null counts as no words."""
    c = table(spark, d, "corpus", "id", "abstract", "first_claim")
    return c.select("id", T.word_count(F.col("abstract")).alias("abstract_words"), T.word_count(F.col("first_claim")).alias("claim_words"), T.substantive(F.col("abstract"), F.col("first_claim")).alias("substantive"))


def _truncated(col: str, n: int) -> str:
    head = f"substr({col}, 1, {n})"
    return f"CASE WHEN length({col}) <= {n} THEN {col} ELSE rtrim(CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END) END"


@query(f"SELECT id, {_truncated('description', 200)} AS snippet, {_truncated('abstract', 300)} AS abstract FROM corpus")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to a length at the last blank."""
    c = table(spark, d, "corpus", "id", "description", "abstract")
    return c.select("id", T.truncate_words(F.col("description"), 200).alias("snippet"), T.truncate_words(F.col("abstract"), 300).alias("abstract"))


@query(
    r"""SELECT id, trim(regexp_replace(regexp_split_to_array(trim(regexp_replace('1. ' || first_claim || ' 2. ' || first_claim, '\s+', ' ', 'g')), ' 2\s*[.)] ')[1], '^\s*1\s*[.):\-]*\s*', '')) AS claim FROM corpus WHERE first_claim IS NOT NULL"""
)
def first_claims(spark: SparkSession, d: str) -> DataFrame:
    """First claim out of a numbered list of claims (built here from the stored claim)."""
    c = table(spark, d, "corpus", "id", "first_claim").where("first_claim is not null")
    return c.select("id", T.first_claim_of_text(F.concat(F.lit("1. "), "first_claim", F.lit(" 2. "), "first_claim")).alias("claim"))


def first_claim_sql(c: str) -> str:
    """SQL of the first claim of a claim list in plain text."""
    return rf"trim(regexp_replace(regexp_split_to_array({COLLAPSE.format(c)}, ' 2\s*[.)] ')[1], '^\s*1\s*[.):\-]*\s*', ''))"


@query(rf"SELECT id, trim(regexp_replace({COLLAPSE.format("'1. ' || coalesce(first_claim, '')")}, '^\s*1\s*[.):\-]*\s*', '')) AS claim FROM corpus")
def html_claims(spark: SparkSession, d: str) -> DataFrame:
    """First claim out of mark-up, built here from the stored claim of every row, escaped; '' for null."""
    c = table(spark, d, "corpus", "id", "first_claim")
    h = F.concat(F.lit('<claims><claim num="1"><p>1. '), T.escape_markup(F.col("first_claim")), F.lit("</p><chemistry>C2</chemistry></claim><claim>2. more</claim></claims>"))
    return c.select("id", T.clean_text(T.first_claim_of_html(h)).alias("claim"))


@query(
    r"SELECT id, trim(regexp_replace(regexp_extract(upper(ipc_codes), '([A-HY]\d{2}[A-Z]?\s*\d+(?:/\d+)?)', 1), '\s+', ' ', 'g')) AS code, upper(replace(ipc_codes, ' ', '')) AS prefix_form FROM corpus"
)
def classification_codes(spark: SparkSession, d: str) -> DataFrame:
    """First code of each row in its normal form, and all codes in the form for prefix tests."""
    c = table(spark, d, "corpus", "id", "ipc_codes")
    return c.select("id", T.normalize_code(F.col("ipc_codes")).alias("code"), T.code_prefix(F.col("ipc_codes")).alias("prefix_form"))


_PREFIXES = "[" + ", ".join(f"'{p}'" for p in T.CHEMISTRY_PREFIXES) + "]"
_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in T.CHEMISTRY_KEYWORDS) + "]"
CHEMISTRY_SQL = f"""
SELECT id, publication_number, CAST(2 * CAST(n_codes > 0 AS INT) + CAST(n_words > 0 AS INT) AS INT) AS score,
       CASE WHEN n_codes > 0 THEN 'core' WHEN n_words > 0 THEN 'related' ELSE 'not_chemistry' END AS label
FROM (SELECT id, publication_number,
             len(list_filter(string_split(coalesce(ipc_codes, ''), '|'), lambda c: len(list_filter({_PREFIXES}, lambda p: starts_with(upper(replace(c, ' ', '')), p))) > 0)) AS n_codes,
             len(list_filter({_KEYWORDS}, lambda k: contains(lower(coalesce(title, '')), k))) AS n_words
      FROM corpus)"""


@query(CHEMISTRY_SQL)
def chemistry_labels(spark: SparkSession, d: str) -> DataFrame:
    """Score and three-level label of chemistry from codes and title words."""
    from ..operators.corpus import chemistry_label

    return chemistry_label(table(spark, d, "corpus", "id", "publication_number", "title", "ipc_codes")).select("id", "publication_number", "score", "label")


@query(
    """SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN trim(title) != '' THEN 'Title: ' || title END, CASE WHEN trim(abstract) != '' THEN 'Abstract: ' || abstract END, CASE WHEN trim(first_claim) != '' THEN 'First claim: ' || first_claim END) AS context FROM corpus"""
)
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Context put together from the parts that are there."""
    c = table(spark, d, "corpus", "id", "title", "abstract", "first_claim")
    return c.select("id", T.context(F.col("title"), F.col("abstract"), F.col("first_claim")).alias("context"))


@query(
    r"""SELECT id, CASE WHEN regexp_matches(list_filter(string_split(replace(lower(id), '-', '_'), '_'), lambda p: p != '')[-1], '^[a-z]{2,5}$') THEN list_filter(string_split(replace(lower(id), '-', '_'), '_'), lambda p: p != '')[-1] END AS language,
    regexp_replace(id, '_(de|en|es|fr|zh)$', '') AS patent,
    coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'default') AS slug,
    trim(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS doc_text FROM corpus"""
)
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Language and publication from identifiers, slugs, and the text that is encoded."""
    c = table(spark, d, "corpus", "id", "title", "abstract")
    return c.select("id", T.infer_language(F.col("id")).alias("language"), T.patent_of(F.col("id")).alias("patent"), T.slug(F.col("title")).alias("slug"), T.title_and_text(F.col("title"), F.col("abstract")).alias("doc_text"))


_CODE_LIKE = " OR ".join(f"regexp_matches(trim(title), '{p}')" for p in T.CODE_LIKE)


@query(
    rf"""SELECT DISTINCT chebi_id, lang, title, coalesce({_CODE_LIKE}, false) AS code_like,
    coalesce(nullif(trim(regexp_replace(title, '\s*\([^()]*\)\s*$', '')), ''), title) AS clean, length(title) >= 8 OR regexp_matches(title, '[\d\- ]') AS distinctive,
    substr(chebi_id, strpos(chebi_id, ':') + 1) AS numeric_id FROM concept_names"""
)
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms and tests of names: codes, bracketed parts, distinctive names, numeric identifiers."""
    c = table(spark, d, "concept_names").select("chebi_id", "lang", "title").distinct()
    t = F.col("title")
    return c.select("chebi_id", "lang", "title", F.coalesce(T.is_code_like(t), F.lit(False)).alias("code_like"), T.clean_name(t).alias("clean"), T.distinctive(t).alias("distinctive"), F.expr("substring(chebi_id, instr(chebi_id, ':') + 1)").alias("numeric_id"))


@query(rf"WITH x AS (SELECT id, {COLLAPSE.format(r"regexp_replace('[0001] ' || description, '\[\d{3,5}\]', ' ', 'g')")} AS t FROM corpus) SELECT id, {_truncated('t', T.MAX_DESCRIPTION_CHARS)} AS snippet FROM x")
def description_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions without paragraph marks (one is put before each here), cut at the limit."""
    c = table(spark, d, "corpus", "id", "description")
    return c.select("id", T.description_snippet(F.concat(F.lit("[0001] "), "description")).alias("snippet"))


@query()
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts after both cleanings (entities, compatibility forms, marks); tested on a fixture."""
    c = table(spark, d, "corpus", "id", "title", "abstract")
    return c.select("id", T.clean_text(F.col("abstract")).alias("plain"), T.clean_markup_text(F.col("title")).alias("markup"), T.name_slug(F.col("title")).alias("slug"))
