"""Benchmark packaging: corpus, queries, relevance judgements, hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def corpus_table(rows: DataFrame) -> DataFrame:
    """(_id, title, text, corpus_language, publication_number): context, else abstract, as text; rows without id dropped."""
    return rows.where(F.trim("id") != "").select(
        F.col("id").alias("_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(T.blank_to_null(F.col("context")), T.blank_to_null(F.col("abstract")), F.lit("")).alias("text"),
        F.col("language").alias("corpus_language"),
        "publication_number",
    )


def query_language(first: Column, second: Column) -> Column:
    """The first column that holds a language."""
    return F.coalesce(T.blank_to_null(F.lower(F.trim(first))), T.blank_to_null(F.lower(F.trim(second))))


def numbered_ids(rows: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``_id``: the base, with a running number from its second use on."""
    w = Window.partitionBy("_base").orderBy(*order)
    return rows.withColumn("_base", base).withColumn("_n", F.row_number().over(w)).withColumn("_id", T.collision_id(F.col("_base"), F.col("_n"))).drop("_base", "_n")


def multilingual_qrels(queries: DataFrame, docs: DataFrame, lost: tuple[str, ...] = ()) -> DataFrame:
    """(query-id, corpus-id, score): all documents of the query's publication, else its source document.

    ``queries`` (query_id, corpus_id, publication_number), ``docs`` (id, publication_number). A lost
    publication number joins nothing, so its rows fall back to their source.
    """
    known = docs.where((F.trim("publication_number") != "") & ~F.col("publication_number").isin(*lost)).select("publication_number", F.col("id").alias("doc")).distinct()
    q = queries.select("query_id", "corpus_id", "publication_number").distinct()
    got = q.join(known, "publication_number", "left").select("query_id", F.coalesce("doc", "corpus_id").alias("doc")).where("doc is not null").distinct()
    return got.select(F.col("query_id").alias("query-id"), F.col("doc").alias("corpus-id"), F.lit(1.0).alias("score"))


def cross_language_qrels(qrels: DataFrame, query_languages: DataFrame, doc_languages: DataFrame) -> DataFrame:
    """Judgements of documents in another language than the query; all of a query that has no such document.

    ``query_languages`` (query-id, query_language), ``doc_languages`` (corpus-id, corpus_language).
    """
    x = qrels.join(query_languages, "query-id", "left").join(doc_languages, "corpus-id", "left")
    x = x.withColumn("foreign", F.coalesce(F.col("query_language") != F.col("corpus_language"), F.lit(False)))
    any_foreign = x.groupBy("query-id").agg(F.max("foreign").alias("has"))
    return x.join(any_foreign, "query-id").where(F.col("foreign") | ~F.col("has")).select("query-id", "corpus-id", "score")


def hard_negative_labels(negatives: DataFrame, names: DataFrame) -> DataFrame:
    """Hard negatives with the name of the neighbor: the stored one, else that of the name table (concept, name)."""
    return (
        negatives.distinct()
        .join(names.select(F.col("concept").alias("neighbor_chebi_id"), "name").distinct(), "neighbor_chebi_id", "left")
        .select("query-id", "corpus-id", "publication_number", "neighbor_chebi_id", F.coalesce(T.blank_to_null(F.col("neighbor_name")), "name").alias("neighbor_name"), "relation")
    )


def graded_qrels(gold: DataFrame, negative: DataFrame) -> DataFrame:
    """Judgements 1 of gold and 0 of look-alikes; a document that is both is gold."""
    both = gold.select("query-id", "corpus-id", F.lit(1.0).alias("score")).unionByName(negative.select("query-id", "corpus-id", F.lit(0.0).alias("score")))
    return both.groupBy("query-id", "corpus-id").agg(F.max("score").alias("score"))


def scored_rankings(predictions: DataFrame, qrels: DataFrame, query_languages: DataFrame, doc_languages: DataFrame, top_k: int = 1000) -> DataFrame:
    """(model, query_id, corpus_id, rank, score, query_language, corpus_language, relevance): the ``top_k`` best per model and query."""
    w = Window.partitionBy("model", "query_id").orderBy(F.desc("score"), "corpus_id")
    top = predictions.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)
    rel = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), F.col("score").alias("relevance"))
    ql = query_languages.select(F.col("query-id").alias("query_id"), "query_language")
    dl = doc_languages.select(F.col("corpus-id").alias("corpus_id"), "corpus_language")
    out = top.join(rel, ["query_id", "corpus_id"], "left").join(ql, "query_id", "left").join(dl, "corpus_id", "left")
    return out.select("model", "query_id", "corpus_id", "rank", "score", F.coalesce("query_language", T.infer_language(F.col("query_id"))).alias("query_language"), F.coalesce("corpus_language", T.infer_language(F.col("corpus_id"))).alias("corpus_language"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"))


def shared_corpus(own: DataFrame, shared: DataFrame, qrels: DataFrame) -> DataFrame:
    """The shared corpus with those judged documents of the own corpus that it lacks; both by ``id``."""
    judged = qrels.select(F.col("corpus-id").alias("id")).distinct()
    return shared.unionByName(own.join(judged, "id", "left_semi").join(shared.select("id"), "id", "left_anti"))


def last_step_mode(steps_json: Column) -> Column:
    """Mode of the last step of a ladder row; null where there is none."""
    return F.try_element_at(F.from_json(steps_json, "array<struct<step:int,mode:string>>"), F.lit(-1))["mode"]


def context_languages(present: Column, order: tuple[str, ...]) -> Column:
    """Languages of a set in a fixed order, then the others sorted, joined by commas."""
    known = F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(present, x))
    return F.array_join(F.concat(known, F.sort_array(F.array_except(present, F.array(*map(F.lit, order))))), ",")


def passages(docs: DataFrame) -> DataFrame:
    """(publication_number, text): labelled passages of a publication in the order of language and id, joined by blank lines."""
    part = F.concat(F.lit("["), F.upper("language"), F.lit("] Passage:\n"), "text")
    return docs.groupBy("publication_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("language", "id", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("text"))


def pick_context(docs: DataFrame, language: str) -> DataFrame:
    """Per publication the document in the language, else the English one, else the first."""
    w = Window.partitionBy("publication_number").orderBy(F.when(F.col("language") == language, 0).when(F.col("language") == "en", 1).otherwise(2), "id")
    return docs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def concept_documents(gold: DataFrame, negatives: DataFrame, docs: DataFrame) -> DataFrame:
    """(concept, role, relation, id): all documents of a concept's gold and hard-negative publications.

    ``gold`` (concept, pub), ``negatives`` (concept, pub, neighbor, relation), ``docs`` (id, pub).
    """
    a = gold.select("concept", "pub", F.lit("gold").alias("role"), F.lit(None).cast("string").alias("relation"))
    b = negatives.select("concept", "pub", F.lit("hard_negative").alias("role"), "relation")
    return a.unionByName(b).join(docs.select("id", "pub").distinct(), "pub").select("concept", "role", "relation", "id")
