"""File scans and sinks: delimited text, JSON lines, mark-up, ontology text, predictions and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CORPUS_SCHEMA = ", ".join(f"{c} string" for c in ("id", "language", "title", "abstract", "description", "first_claim", "context", "publication_number", "country_code", "publication_date", "source", "ipc_codes"))
RECORD_SCHEMA = (
    "publication_number string, family_id string, country_code string, publication_date int, title_localized array<struct<language:string,text:string>>, abstract_localized array<struct<language:string,text:string>>, "
    "claims_localized array<struct<language:string,text:string>>, claims_localized_html array<struct<language:string,text:string>>, ipc array<struct<code:string>>, cpc array<struct<code:string>>"
)


def read_csv(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """Delimited text with a header, quoted line ends and long fields; every column a string, '' for null."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, enforceSchema=False)
    return df.na.fill("")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Delimited text with a header, in the form that ``read_csv`` reads."""
    df.write.csv(path, mode=mode, header=True, quote='"', escape='"', emptyValue="")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records from JSON lines; blank lines are skipped, unknown fields ignored."""
    return spark.read.json(path, schema=RECORD_SCHEMA)


def records_to_rows(records: DataFrame, languages: list[str]) -> DataFrame:
    """Corpus rows of each language in which a record has a title or an abstract, the claim from mark-up before that from text."""
    out = None
    for lang in languages:
        part = records.select(
            F.concat_ws("_", "publication_number", F.lit(lang)).alias("id"),
            F.lit(lang).alias("language"),
            F.coalesce(T.localized(F.col("title_localized"), lang), F.lit("")).alias("title"),
            F.coalesce(T.localized(F.col("abstract_localized"), lang), F.lit("")).alias("abstract"),
            T.first_claim(T.localized(F.col("claims_localized_html"), lang), T.localized(F.col("claims_localized"), lang)).alias("first_claim"),
            "publication_number",
            "country_code",
            F.col("publication_date").cast("string").alias("publication_date"),
            F.array_join(F.array_distinct(F.transform(F.coalesce("ipc", F.array()), lambda x: x["code"])), "|").alias("ipc_codes"),
        ).where("title != '' or abstract != ''")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("context", T.context(F.col("title"), F.col("abstract"), F.col("first_claim")))


# ---------------------------------------------------------------- mark-up

PATENT_SCHEMA = (
    "_id string, `_doc-number` string, _country string, `_date-publ` string, _kind string, _lang string, "
    "SDOBI struct<B300:array<struct<B310:array<string>,B320:array<struct<date:string>>>>,B500:struct<B540:struct<B541:array<string>,B542:array<string>>>,"
    "B700:struct<B710:struct<B711:array<struct<snm:string>>>,B720:struct<B721:array<struct<snm:string>>>,B730:struct<B731:array<struct<snm:string>>>>,B800:struct<B840:struct<ctry:array<string>>>>, "
    "abstract array<struct<_lang:string,p:array<string>>>, description array<struct<_lang:string,p:array<string>>>, "
    "claims array<struct<_lang:string,claim:array<struct<`claim-text`:array<string>>>>>, `classification-ipcr` array<struct<text:string>>, `classification-cpc` array<struct<text:string>>"
)


def parse_patents(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Patent mark-up to records with localized blocks; ``valid`` tells whether identifier and title are there.

    Blocks of one language and text come once; the first claim of a language is kept; codes are normalized
    and distinct, in order. Broken mark-up gives an invalid record, not a failure.
    """
    p = xml.withColumn("p", F.from_xml(F.col(column), PATENT_SCHEMA))

    def blocks(c: str, body: str) -> Column:
        made = F.transform(F.coalesce(F.col(f"p.{c}"), F.array()), lambda b: F.struct(F.lower(b["_lang"]).alias("language"), T.collapse(F.array_join(F.coalesce(b[body], F.array()), " ")).alias("text")))
        return F.array_distinct(F.filter(made, lambda b: b["text"] != ""))

    titles = F.transform(F.arrays_zip(F.coalesce("p.SDOBI.B500.B540.B541", F.array().cast("array<string>")).alias("l"), F.coalesce("p.SDOBI.B500.B540.B542", F.array().cast("array<string>")).alias("t")), lambda z: F.struct(F.lower(z["l"]).alias("language"), T.collapse(z["t"]).alias("text")))
    claims = F.transform(F.coalesce("p.claims", F.array()), lambda c: F.struct(F.lower(c["_lang"]).alias("language"), T.strip_claim_number(T.collapse(F.array_join(F.coalesce(F.try_element_at(c["claim"], F.lit(1))["claim-text"], F.array()), " "))).alias("text")))
    codes = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(f"p.`{c}`"), F.array()), lambda x: T.normalize_code(x["text"])), lambda x: x != ""))
    distinct = lambda values: F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.collapse), lambda x: x != ""))
    names = lambda c: distinct(F.transform(F.col(f"p.SDOBI.B700.{c}"), lambda x: x["snm"]))
    priorities = F.coalesce("p.SDOBI.B300", F.array())
    out = p.select(
        *[c for c in xml.columns if c != column],
        F.col("p._id").alias("xml_id"),
        F.concat_ws("-", "p._country", "p.`_doc-number`", "p._kind").alias("publication_number"),
        F.col("p._country").alias("country_code"),
        F.col("p.`_date-publ`").alias("publication_date"),
        F.filter(titles, lambda b: b["text"] != "").alias("title_localized"),
        blocks("abstract", "p").alias("abstract_localized"),
        blocks("description", "p").alias("description_localized"),
        F.filter(claims, lambda b: b["text"] != "").alias("claims_localized"),
        codes("classification-ipcr").alias("ipc_codes"),
        codes("classification-cpc").alias("cpc_codes"),
        names("B710.B711").alias("applicants"),
        names("B720.B721").alias("inventors"),
        names("B730.B731").alias("proprietors"),
        F.array_distinct(F.transform(distinct(F.col("p.SDOBI.B800.B840.ctry")), F.upper)).alias("states"),
        distinct(F.flatten(F.transform(priorities, lambda x: F.coalesce(x["B310"], F.array().cast("array<string>"))))).alias("priority_numbers"),
        distinct(F.flatten(F.transform(priorities, lambda x: F.transform(F.coalesce(x["B320"], F.array().cast("array<struct<date:string>>")), lambda y: y["date"])))).alias("priority_dates"),
    )
    return out.withColumn("valid", F.coalesce((F.col("xml_id") != "") & (F.size("title_localized") > 0), F.lit(False)))


# ---------------------------------------------------------------- ontology text


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(stanza): the parts of an ontology file, gzip or plain, split at its headings."""
    return spark.read.text(path, lineSep="\n[").select(F.col("value").alias("stanza"))


def parse_ontology(stanzas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, name, synonyms, brands, wiki), edges (child, parent) and alternatives (alt, node) of an ontology.

    Only living terms count; synonyms of exact and related scope are kept, brand names apart; edges to an
    alternative identifier go to the primary one.
    """
    lines = F.transform(F.split("stanza", "\n"), lambda x: F.trim(x))
    term = stanzas.withColumn("l", lines).where(F.element_at("l", 1).rlike(r"^\[?Term\]"))
    values = lambda tag: F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(f"{tag}: "))), lambda x: F.substring(x, len(tag) + 3, 1 << 30))
    one = lambda tag: F.try_element_at(values(tag), F.lit(1))
    quoted = lambda x: T.obo_unescape(F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1))
    synonyms = F.filter(values("synonym"), lambda x: x.rlike(r'" (EXACT|RELATED) '))
    brand = lambda x: x.rlike(r'" (EXACT|RELATED) BRAND_NAME ')
    t = term.select(
        F.trim(F.split(one("id"), " ").getItem(0)).alias("id"),
        one("name").alias("name"),
        F.array_distinct(F.transform(F.filter(synonyms, lambda x: ~brand(x)), quoted)).alias("synonyms"),
        F.array_distinct(F.transform(F.filter(synonyms, brand), quoted)).alias("brands"),
        F.nullif(F.regexp_extract(F.array_join(values("xref"), "\n"), r"(?m)^Wikipedia:(\S+)", 1), F.lit("")).alias("wiki"),
        values("alt_id").alias("alts"),
        F.transform(values("is_a"), lambda x: F.split(x, " ").getItem(0)).alias("parents"),
        F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("dead"),
    ).where("not dead and id is not null")
    from ..operators.graph import resolve_alternatives

    alternatives = t.select(F.explode("alts").alias("alt"), F.col("id").alias("node")).distinct()
    edges = resolve_alternatives(t.select(F.col("id").alias("child"), F.explode("parents").alias("parent")), alternatives)
    return t.select("id", "name", "synonyms", "brands", "wiki"), edges, alternatives


# ---------------------------------------------------------------- predictions, results, lookups


def read_predictions(texts: DataFrame) -> DataFrame:
    """(model, query_id, corpus_id, score) from (model, json) of nested predictions; a query in several subsets counts in the last one."""
    kind = "map<string,map<string,map<string,map<string,double>>>>"
    body = F.map_filter(F.from_json("json", "map<string,string>"), lambda k, v: k != "mteb_model_meta")
    sub = texts.select("model", F.posexplode(F.map_entries(F.from_json(F.to_json(F.transform_values(body, lambda k, v: F.from_json(v, kind[len("map<string,") : -1]))), kind))).alias("at", "e"))
    q = sub.select("model", "at", F.explode(F.map_values("e.value")).alias("queries")).select("model", "at", F.explode("queries").alias("query_id", "docs"))
    w = Window.partitionBy("model", "query_id").orderBy(F.desc("at"))
    last = q.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.select("model", "query_id", F.explode("docs").alias("corpus_id", "score"))


def numeric_metrics(results: DataFrame, column: str = "json") -> DataFrame:
    """``results`` with ``metrics``: the numeric fields of the first row of a result's first split."""
    text = F.get_json_object(column, "$.scores.*[0]")
    first = F.coalesce(F.get_json_object(column, "$.scores.test[0]"), text)
    fields = F.from_json(first, "map<string,string>")
    return results.withColumn("metrics", F.map_filter(F.transform_values(fields, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull()))


def lookup_missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that the cache doesn't hold yet; one that was looked up without a result is in it."""
    return wanted.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink; committed files appear at once or not at all."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_configs(tables: dict[str, DataFrame], root: str, only: set[str] | None = None) -> None:
    """One folder per config."""
    for name, df in tables.items():
        if only is None or name in only:
            write_table(df, f"{root}/{name}")


def read_config(spark: SparkSession, root: str, name: str, variant: str = "") -> DataFrame:
    """One config of a published dataset, with the identifier named ``id``.

    Looked for under its name with the variant before it (``<variant>-<name>``), then under the plain name, as a
    folder or in the folder ``data`` of the root; raises ``FileNotFoundError`` where none of them is.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tried = []
    for n in dict.fromkeys([f"{variant}-{name}" if variant else name, name]):
        for path in (f"{root}/{n}", f"{root}/data/{n}", f"{root}/{n}.parquet"):
            tried.append(path)
            at = jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(conf).exists(at):
                df = spark.read.parquet(path)
                return df.withColumnRenamed("_id", "id") if "_id" in df.columns and "id" not in df.columns else df
    raise FileNotFoundError(", ".join(tried))


def discover_models(spark: SparkSession, root: str, wanted: list[str] | None = None) -> DataFrame:
    """(model, path): folders of predictions, one per model, that hold a predictions file; ``wanted`` keeps the named ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*predictions*.json").load(root).select("path")
    out = files.select(F.element_at(F.split("path", "/"), -2).alias("model"), "path")
    return out.where(F.col("model").isin(wanted)) if wanted else out


def write_alias_graph(manifest: DataFrame, gold: DataFrame, negatives: DataFrame, path: str) -> None:
    """The concept benchmark as JSON lines in three folders, and its manifest also as delimited text with languages joined by bars."""
    for name, df in (("concepts", manifest), ("gold", gold), ("negatives", negatives)):
        df.write.mode("overwrite").json(f"{path}/{name}")
    write_csv(manifest.withColumn("gold_langs", F.array_join("gold_langs", "|")), f"{path}/manifest")


def read_alias_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, gold and negatives of a written benchmark, or of one JSON document with the list ``concepts``."""
    concept = "concept string, name string, n_gold bigint, n_hard_neg bigint, gold_langs array<string>, n_neighbors bigint"
    negative = "concept string, pub string, neighbor string, relation string"
    if not path.endswith(".json"):
        return spark.read.json(f"{path}/concepts", schema=concept), spark.read.json(f"{path}/gold", schema="concept string, pub string"), spark.read.json(f"{path}/negatives", schema=negative)
    entry = "chebi_id string, name string, n_gold bigint, n_hard_neg bigint, gold_langs array<string>, n_neighbors_in_corpus bigint, gold array<string>, hard_negatives array<struct<publication_number:string,neighbor_chebi_id:string,relation:string>>"
    c = spark.read.json(path, schema=f"concepts array<struct<{', '.join(f.replace(' ', ':', 1) for f in entry.split(', '))}>>", multiLine=True).select(F.inline("concepts"))
    manifest = c.select(F.col("chebi_id").alias("concept"), "name", "n_gold", "n_hard_neg", "gold_langs", F.col("n_neighbors_in_corpus").alias("n_neighbors"))
    gold = c.select(F.col("chebi_id").alias("concept"), F.explode("gold").alias("pub"))
    return manifest, gold, c.select(F.col("chebi_id").alias("concept"), F.explode("hard_negatives").alias("n")).select("concept", F.col("n.publication_number").alias("pub"), F.col("n.neighbor_chebi_id").alias("neighbor"), "n.relation")
