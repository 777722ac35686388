"""Corpus extraction and normalization: gates, first-wins and richest-wins merges, multilingual filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CORPUS_COLUMNS = ("id", "language", "title", "abstract", "description", "first_claim", "context", "publication_number", "country_code", "publication_date", "source", "ipc_codes")


#: Publication numbers that stand for a lost number: rows with one of them share nothing else.
LOST_PUBLICATIONS = ("EP-0000000-A0",)


def known(publication: str) -> Column:
    """Whether a row has a publication number that names a publication."""
    p = F.trim(publication)
    return F.coalesce((p != "") & ~p.isin(*LOST_PUBLICATIONS), F.lit(False))


def language_code(c: Column) -> Column:
    """Language label in lower case, trimmed; null when blank."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def chemistry_label(rows: DataFrame, title: str = "title", codes: str = "ipc_codes") -> DataFrame:
    """``rows`` with score (codes 2, title words 1) and label core, related or not_chemistry."""
    hit = F.size(T.chemistry_codes(T.code_list(F.col(codes)))) > 0
    word = F.size(T.keyword_hits(F.col(title))) > 0
    score = F.when(hit, 2).otherwise(0) + F.when(word, 1).otherwise(0)
    return rows.withColumn("score", score.cast("int")).withColumn("label", F.when(hit, "core").when(word, "related").otherwise("not_chemistry"))


def chemistry_rank(label: Column) -> Column:
    """Strength of a label: not_chemistry 0, related 1, core 2."""
    return F.when(label == "core", 2).when(label == "related", 1).otherwise(0)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def cap_per_key(rows: DataFrame, key: str, n: int, order: list[Column | str]) -> DataFrame:
    """At most ``n`` rows of each key, a top-n report."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def preprocess(rows: DataFrame, languages: list[str], per_language: int, min_words: int, order: list[Column | str]) -> DataFrame:
    """Per language: first row of a publication, then the word gate (a short first row hides later ones), then the cap."""
    use = rows.withColumn("language", language_code(F.col("language"))).where(F.col("language").isin(languages) & known("publication_number") & ((F.trim("title") != "") | (F.trim("abstract") != "")))
    first = first_per_key(use, ["language", "publication_number"], order)
    return cap_per_key(first.where(T.word_count(F.col("abstract")) >= min_words), "language", per_language, order)


def merge(rows: DataFrame, min_words: int) -> DataFrame:
    """Per-language outputs joined into one corpus: white space collapsed in every text, the gate applied again."""
    texts = ("title", "abstract", "first_claim", "context")
    out = rows.withColumns({c: T.collapse(F.coalesce(F.col(c), F.lit(""))) for c in texts if c in rows.columns})
    return out.where(T.word_count(F.col("abstract")) >= min_words)


def languages_of_publications(rows: DataFrame) -> DataFrame:
    """(publication_number, n_languages, languages sorted) over labelled rows of known publications."""
    use = rows.select(F.trim("publication_number").alias("publication_number"), language_code(F.col("language")).alias("language")).where(known("publication_number") & F.col("language").isNotNull())
    return use.distinct().groupBy("publication_number").agg(F.count("*").alias("n_languages"), F.array_join(F.sort_array(F.collect_list("language")), ",").alias("languages"))


def multilingual(rows: DataFrame, least: int) -> DataFrame:
    """Rows of publications with at least ``least`` languages.

    The language sets are aggregated before the shuffle, and the semi join moves keys only.
    """
    keys = languages_of_publications(rows).where(F.col("n_languages") >= least).select("publication_number")
    return rows.join(keys, "publication_number", "left_semi")


def strongest_label(rows: DataFrame) -> DataFrame:
    """(publication_number, label): the strongest label of any row of a known publication."""
    best = rows.where(known("publication_number")).groupBy("publication_number").agg(F.max(chemistry_rank(F.col("label"))).alias("r"))
    return best.select("publication_number", F.element_at(F.array(F.lit("not_chemistry"), F.lit("related"), F.lit("core")), F.col("r") + 1).alias("label"))


def richest(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The richest row of each (publication, language), the first on ties."""
    with_size = rows.where(known("publication_number")).withColumn("richness", T.richness(F.col("abstract"), F.col("first_claim"), F.col("description")))
    return first_per_key(with_size, ["publication_number", "language"], [F.desc("richness"), *order])


def merged_blocks(rows: DataFrame, field: str, order: list[Column | str]) -> DataFrame:
    """(publication_number, language, text): the longest text of a field, the first on ties."""
    use = rows.where((F.trim(field) != "") & known("publication_number"))
    return first_per_key(use, ["publication_number", "language"], [F.desc(F.length(field)), *order]).select("publication_number", "language", F.col(field).alias("text"))


def merged_codes(rows: DataFrame) -> DataFrame:
    """(publication_number, codes, n_codes): distinct codes of all rows, sorted and joined by a bar."""
    each = rows.where(known("publication_number")).select("publication_number", F.explode(T.code_list(F.col("ipc_codes"))).alias("code")).distinct()
    return each.groupBy("publication_number").agg(F.array_join(F.sort_array(F.collect_list("code")), "|").alias("codes"), F.count("*").alias("n_codes"))


def materialize(rows: DataFrame, languages: list[str], least: int, strict: bool, order: list[Column | str]) -> DataFrame:
    """Accumulated rows as corpus rows.

    The strongest label of a publication decides (``strict`` keeps core only); a language is covered
    when its richest row has enough text; publications with ``least`` covered languages emit those rows.
    """
    use = rows.withColumn("language", language_code(F.col("language"))).where(F.col("language").isin(languages) & known("publication_number"))
    labels = strongest_label(chemistry_label(use)).where(F.col("label") == "core" if strict else F.col("label") != "not_chemistry")
    rich = richest(use, order).where(T.substantive(F.col("abstract"), F.col("first_claim")))
    covered = rich.groupBy("publication_number").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("publication_number")
    return rich.join(covered, "publication_number", "left_semi").join(labels, "publication_number")


def anti_committed(rows: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows of publications that no earlier batch has written, whatever their language; a lost number is never written."""
    return rows.join(committed.where(known("publication_number")).select("publication_number").distinct(), "publication_number", "left_anti")


def next_items(items: DataFrame, processed: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest items that were not processed yet."""
    left = items.join(processed.select("item_id").distinct(), "item_id", "left_anti")
    return left.orderBy(F.desc("item_published_at"), F.desc("item_id")).limit(n)


def with_classification(rows: DataFrame, prefixes: list[str], listed: DataFrame) -> DataFrame:
    """Rows whose codes start with a prefix or whose publication is listed, with the flag ``in_list``."""
    keys = listed.select("publication_number").distinct().withColumn("in_list", F.lit(True))
    hit = F.exists(T.code_list(F.col("ipc_codes")), lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(T.code_prefix(c), p)))
    out = rows.join(keys, "publication_number", "left").withColumn("in_list", F.coalesce("in_list", F.lit(False)))
    return out.where(hit | F.col("in_list"))


def top_n_per_language(rows: DataFrame, languages: list[str], n: int) -> DataFrame:
    """(language, rank, publication_number): the newest ``n`` publications with an abstract in each language."""
    use = (
        rows.withColumn("language", language_code(F.col("language")))
        .where(F.col("language").isin(languages) & (F.trim("abstract") != "") & known("publication_number"))
        .groupBy("language", "publication_number")
        .agg(F.max(F.coalesce(F.regexp_replace("publication_date", "-", ""), F.lit(""))).alias("day"))
    )
    w = Window.partitionBy("language").orderBy(F.desc("day"), F.desc("publication_number"))
    return use.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def extracted(rows: DataFrame, prefixes: list[str] | None = None, listed: DataFrame | None = None, since: str | None = None, until: str | None = None, countries: list[str] | None = None, primary: str | None = None, least_chars: int = 0, with_claim: bool = False, with_description: bool = False, languages: list[str] | None = None, least_languages: int = 1, limit: int | None = None) -> DataFrame:
    """Publications of raw corpus rows under the predicates of an extraction, the newest first.

    (publication_number, day, languages). Codes by prefix or membership in a list; days (yyyymmdd) between
    ``since`` and ``until``; countries; a row of the ``primary`` language with an abstract of ``least_chars``
    characters and, if asked, a claim and a description; without a primary language ``with_claim`` asks for a
    claim in any language; at least ``least_languages`` of ``languages`` with an abstract. Rows without a day
    pass no bound on days. All predicates are flags of rows that are aggregated before the shuffle.
    """
    use = rows.where(known("publication_number")).withColumn("publication_number", F.trim("publication_number"))
    if countries:
        use = use.where(F.upper(F.trim("country_code")).isin([c.upper() for c in countries]))
    use = use.withColumn("language", language_code(F.col("language")))
    day = F.regexp_extract(F.regexp_replace("publication_date", "-", ""), r"^(\d{8})$", 1)
    day = F.when((day != "") & (day != "00000000"), day)
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    main = F.coalesce(F.col("language") == (primary or ""), F.lit(False))
    counted = full("abstract") & (F.col("language").isin(languages) if languages else F.col("language").isNotNull())
    flags = {
        "_code": F.exists(T.code_list(F.col("ipc_codes")), lambda c: F.exists(F.array(*map(F.lit, prefixes or [""])), lambda p: F.startswith(T.code_prefix(c), p))),
        "_abstract": main & full("abstract") & (F.length("abstract") >= least_chars),
        "_claim": (main if primary else F.lit(True)) & full("first_claim"),
        "_description": main & full("description"),
    }
    g = use.groupBy("publication_number").agg(F.max(day).alias("day"), F.collect_set(F.when(counted, F.col("language"))).alias("_languages"), *[F.max(v).alias(k) for k, v in flags.items()])
    if prefixes is not None:
        if listed is not None:
            g = g.join(listed.select("publication_number").distinct().withColumn("_listed", F.lit(True)), "publication_number", "left")
            g = g.where(F.col("_code") | F.coalesce("_listed", F.lit(False)))
        else:
            g = g.where("_code")
    if since:
        g = g.where(F.col("day") >= since)
    if until:
        g = g.where(F.col("day") <= until)
    if primary:
        g = g.where("_abstract")
    if with_claim:
        g = g.where("_claim")
    if with_description and primary:
        g = g.where("_description")
    g = g.where(F.size("_languages") >= least_languages)
    out = g.select("publication_number", "day", F.array_join(F.sort_array("_languages"), ",").alias("languages"))
    return out.orderBy(F.desc_nulls_last("day"), "publication_number").limit(limit) if limit else out


def overfetch(n: int) -> int:
    """Rows to fetch so that ``n`` are left after later gates."""
    return max(n + 10, int(1.25 * n))
