"""Concepts with gold publications and hard negatives, and checks of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph
from . import matching as M


def concept_publications(hits: DataFrame, doc_pubs: DataFrame) -> DataFrame:
    """(concept, pub): publications whose documents name a concept; ``doc_pubs`` is (doc, pub)."""
    return hits.select("doc", "concept").distinct().join(doc_pubs, "doc").select("concept", "pub").where("pub is not null and pub != ''").distinct()


def candidates(pubs: DataFrame, edges: DataFrame, min_gold: int, root: str | None = None) -> DataFrame:
    """(concept, n_gold): leaf concepts (below the root) with enough publications."""
    n = pubs.groupBy("concept").agg(F.count("*").alias("n_gold")).where(F.col("n_gold") >= min_gold)
    parents = edges.select(F.col("parent").alias("concept")).distinct()
    n = n.join(parents, "concept", "left_anti")
    return n.join(graph.descendants(edges, root).withColumnRenamed("node", "concept"), "concept", "left_semi") if root else n


def hard_negatives(pubs: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept, pub, neighbor, relation): publications that name a neighbor and not the concept.

    One row per concept and publication: sibling before child before parent, then the smallest neighbor.
    """
    rel = graph.neighbor_relations(edges).withColumnRenamed("node", "concept").join(concepts.select("concept"), "concept", "left_semi")
    near = rel.join(pubs.select(F.col("concept").alias("neighbor"), "pub"), "neighbor").join(pubs.select("concept", "pub"), ["concept", "pub"], "left_anti")
    order = F.when(F.col("relation") == "sibling", 0).when(F.col("relation") == "child", 1).otherwise(2)
    w = Window.partitionBy("concept", "pub").orderBy(order, "neighbor")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("concept", "pub", "neighbor", "relation")


def kept_concepts(pubs: DataFrame, edges: DataFrame, min_gold: int, min_neg: int, most: int | None = None, root: str | None = None) -> DataFrame:
    """(concept, n_gold, n_hard_neg): kept concepts, the most frequent first, at most ``most`` of them (a top-n report)."""
    cand = candidates(pubs, edges, min_gold, root)
    neg = hard_negatives(pubs, cand, edges).groupBy("concept").agg(F.count("*").alias("n_hard_neg")).where(F.col("n_hard_neg") >= min_neg)
    kept = cand.join(neg, "concept")
    return kept.orderBy(F.desc("n_gold"), "concept").limit(most) if most else kept


def name_sets(names: DataFrame) -> DataFrame:
    """(concept, names, codes): per language bucket the distinct names in order, and the code-like ones apart."""
    n = names.where("surface is not null").withColumn("code", T.is_code_like(F.col("surface")))
    first = n.groupBy("concept", "lang", F.lower("surface").alias("k"), "code").agg(F.min(F.struct("ord", "surface")).alias("s"))
    lists = first.groupBy("concept", "lang", "code").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["surface"]).alias("l"))
    return lists.groupBy("concept").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("code"), F.struct("lang", "l"))))).alias("names"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("code"), F.col("l"))))).alias("codes"),
    )


def all_aliases(name_set: Column) -> Column:
    """Distinct names over all buckets."""
    return F.array_distinct(F.flatten(F.map_values(name_set)))


def groundable(concept_pubs: DataFrame, aliases: DataFrame, passages: DataFrame) -> DataFrame:
    """(pub, concept): concepts of a publication with an alias in its passages (pub, text)."""
    named = concept_pubs.join(aliases.select("concept", F.lower("surface").alias("alias")).where("alias != ''"), "concept")
    return named.join(passages.select("pub", F.lower("text").alias("text")), "pub").where(F.contains("text", "alias")).select("pub", "concept").distinct()


def pick_answer(concept_pubs: DataFrame, aliases: DataFrame, passages: DataFrame, language: str) -> DataFrame:
    """(pub, concept, answer, grounded): a name in the language that the passages hold, else any name they hold,
    else one in the language, else any; the smallest of equal rank."""
    named = concept_pubs.join(aliases.select("concept", "lang", "surface").where("surface is not null and surface != ''"), "concept")
    text = passages.groupBy("pub").agg(F.array_join(F.sort_array(F.collect_list(F.lower("text"))), "\n").alias("text"))
    got = named.join(text, "pub").withColumn("held", F.contains("text", F.lower("surface")))
    rank = F.when(F.col("held") & (F.col("lang") == language), 0).when(F.col("held"), 1).when(F.col("lang") == language, 2).otherwise(3)
    w = Window.partitionBy("pub", "concept").orderBy(rank, "surface", "lang")
    return got.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pub", "concept", F.col("surface").alias("answer"), F.col("held").alias("grounded"))


def title_checks(detected: DataFrame, rows: DataFrame, titles: DataFrame, names: DataFrame) -> DataFrame:
    """(concept, pub, lang, title, title_present, any_present, instead): whether a parallel text uses the title.

    ``detected`` (concept, pub) from the anchor language; ``rows`` (pub, lang, text) of the others;
    ``titles`` and ``names`` (concept, lang, surface). ``instead`` is the first other name that is used.
    """
    pairs = detected.join(rows, "pub").join(titles.select("concept", "lang", F.col("surface").alias("title")), ["concept", "lang"])
    low = F.lower("text")
    checked = pairs.withColumn("title_present", F.contains(low, F.lower("title")))
    used = (
        checked.join(names.select("concept", F.col("surface").alias("alias")).where("alias != ''").distinct(), "concept", "left")
        .withColumn("hit", F.contains(F.lower("text"), F.lower("alias")))
        .groupBy("concept", "pub", "lang", "title", "title_present")
        .agg(F.coalesce(F.max("hit"), F.lit(False)).alias("any_present"), F.min(F.when(F.col("hit"), F.col("alias"))).alias("other"))
    )
    return used.select("concept", "pub", "lang", "title", "title_present", "any_present", F.when(~F.col("title_present") & F.col("any_present"), F.col("other")).alias("instead"))


def check_rates(checks: DataFrame) -> DataFrame:
    """(lang, n_pairs, n_title, n_any, title_rate, any_rate) of the title checks."""
    g = checks.groupBy("lang").agg(F.count("*").alias("n_pairs"), F.sum(F.col("title_present").cast("int")).alias("n_title"), F.sum(F.col("any_present").cast("int")).alias("n_any"))
    return g.withColumn("title_rate", F.round(F.expr("try_divide(n_title, n_pairs)"), 6)).withColumn("any_rate", F.round(F.expr("try_divide(n_any, n_pairs)"), 6))


def mismatches(checks: DataFrame, most: int = 40) -> DataFrame:
    """(concept, lang, title, instead, n): names most often used instead of the title, a top-n report."""
    return checks.where("instead is not null").groupBy("concept", "lang", "title", "instead").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept", "lang", "instead").limit(most)


def alias_graph(hits: DataFrame, docs: DataFrame, names: DataFrame, edges: DataFrame, n_docs: int, max_ratio: float, min_gold: int, min_neg: int, most: int | None = None, root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The benchmark of concepts: manifest, gold publications and hard negatives.

    ``hits`` is a scan with the whole index, ``docs`` (doc, pub, language) of known publications, ``names``
    (concept, lang, surface, primary). Names in more than ``max_ratio`` of the documents are pruned; as each
    name is found on its own, pruning the hits equals scanning again with the pruned index. Manifest (concept,
    name, n_gold, n_hard_neg, gold_langs, n_neighbors), gold (concept, pub), negatives (concept, pub, neighbor,
    relation) stay tables, so that no concept's publications need to fit into one row.
    """
    stop = M.stop_names(M.name_document_frequency(hits), n_docs, max_ratio)
    left = hits.join(stop, "norm", "left_anti").select("doc", "concept").distinct().join(docs, "doc")
    gold = left.select("concept", "pub").distinct()
    cand = candidates(gold, edges, min_gold, root)
    negatives = hard_negatives(gold, cand, edges)
    kept = kept_concepts(gold, edges, min_gold, min_neg, most, root)
    langs = left.select("concept", "language").where("language is not null").distinct().groupBy("concept").agg(F.sort_array(F.collect_list("language")).alias("gold_langs"))
    near = graph.neighbor_relations(edges).join(gold.select(F.col("concept").alias("neighbor")).distinct(), "neighbor", "left_semi").groupBy(F.col("node").alias("concept")).agg(F.count("*").alias("n_neighbors"))
    label = names.where("primary").groupBy("concept").agg(F.min("surface").alias("name"))
    manifest = kept.join(label, "concept", "left").join(langs, "concept", "left").join(near, "concept", "left")
    manifest = manifest.select("concept", F.coalesce("name", "concept").alias("name"), "n_gold", "n_hard_neg", F.coalesce("gold_langs", F.array().cast("array<string>")).alias("gold_langs"), F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"))
    return manifest, gold.join(kept.select("concept"), "concept", "left_semi"), negatives.join(kept.select("concept"), "concept", "left_semi")
