"""Queries of the taxonomy, the name index and concepts.

The concept names stand in for the ontology: concept n is a child of concept n div 6, and the English
title is a concept's primary name. The geography tables give a forest of four levels.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concepts as K
from ..operators import graph as G
from ..operators import matching as M
from ..operators.corpus import known
from .corpus import KNOWN, LOST
from .registry import query, table

_kept: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A small table that many queries share (closure, index), written once per session and folder, whose tables don't change meanwhile."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = G.cut_lineage(make())
    return _kept[key]


# ---------------------------------------------------------------- taxonomy


def geography(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): nations in regions, suppliers and customers in nations."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return n.unionByName(s).unionByName(c)


GEO = "geo AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(
    f"""WITH RECURSIVE {GEO}, up AS (SELECT x AS node, x AS ancestor, 0 AS depth FROM (SELECT child AS x FROM geo UNION SELECT parent FROM geo) UNION ALL SELECT u.node, g.parent, u.depth + 1 FROM up u JOIN geo g ON u.ancestor = g.child) SELECT node, ancestor, CAST(depth AS INT) AS depth FROM up"""
)
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its ancestors and their distance."""
    return G.closure(geography(spark, d))


@query(f"WITH {GEO} SELECT DISTINCT child AS node FROM geo WHERE child NOT IN (SELECT parent FROM geo)")
def leaf_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without children."""
    return G.leaves(geography(spark, d))


@query(
    f"""WITH RECURSIVE {GEO}, down AS (SELECT 'r1' AS node UNION SELECT g.child FROM down x JOIN geo g ON g.parent = x.node) SELECT node FROM down"""
)
def subtree(spark: SparkSession, d: str) -> DataFrame:
    """Everything below one root."""
    return G.descendants(geography(spark, d), "r1")


EDGE = "edge AS (SELECT DISTINCT chebi_id AS child, 'CHEBI:' || (970000 + (CAST(substr(chebi_id, 7) AS INT) - 970000) // 6) AS parent FROM concept_names WHERE CAST(substr(chebi_id, 7) AS INT) > 970000)"
RELATIONS = """rel AS (SELECT node, neighbor, CASE min(r) WHEN 0 THEN 'parent' WHEN 1 THEN 'child' ELSE 'sibling' END AS relation FROM (
  SELECT child AS node, parent AS neighbor, 0 AS r FROM edge UNION ALL SELECT parent, child, 1 FROM edge UNION ALL SELECT a.child, b.child, 2 FROM edge a JOIN edge b ON a.parent = b.parent AND a.child != b.child) GROUP BY 1, 2)"""


def concept_edges(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("chebi_id", 7, 20).cast("int") - 970000
    c = table(spark, d, "concept_names", "chebi_id").distinct().where(n > 0)
    return c.select(F.col("chebi_id").alias("child"), F.concat(F.lit("CHEBI:"), (970000 + F.floor(n / 6)).cast("int")).alias("parent"))


@query(f"WITH {EDGE}, {RELATIONS} SELECT node, neighbor, relation FROM rel")
def neighbor_relations(spark: SparkSession, d: str) -> DataFrame:
    """Parents, children and siblings of each concept, one relation per pair."""
    return G.neighbor_relations(concept_edges(spark, d))


@query(
    f"""WITH {EDGE}, alt AS (SELECT DISTINCT chebi_id AS alt, 'CHEBI:' || (CAST(substr(chebi_id, 7) AS INT) - 1) AS node FROM concept_names WHERE CAST(substr(chebi_id, 7) AS INT) % 9 = 0)
    SELECT DISTINCT coalesce(a.node, e.child) AS child, coalesce(b.node, e.parent) AS parent FROM edge e LEFT JOIN alt a ON a.alt = e.child LEFT JOIN alt b ON b.alt = e.parent WHERE coalesce(a.node, e.child) != coalesce(b.node, e.parent)"""
)
def alternative_ids(spark: SparkSession, d: str) -> DataFrame:
    """Edges with alternative identifiers resolved (here every ninth one is an alternative of the one before)."""
    n = F.substring("chebi_id", 7, 20).cast("int")
    alt = table(spark, d, "concept_names", "chebi_id").where(n % 9 == 0).select(F.col("chebi_id").alias("alt"), F.concat(F.lit("CHEBI:"), n - 1).alias("node"))
    return G.resolve_alternatives(concept_edges(spark, d), alt)


# ---------------------------------------------------------------- names


def concept_names(spark: SparkSession, d: str) -> DataFrame:
    """(concept, lang, surface, primary) of the titles."""
    return table(spark, d, "concept_names").where("title is not null and trim(title) != ''").select(F.col("chebi_id").alias("concept"), "lang", F.col("title").alias("surface"), (F.col("lang") == "en").alias("primary")).distinct()


#: Ranges whose compatibility forms the SQL knows: Latin-1 and Extended-A, spaces, sub- and superscripts, letter-like signs,
#: radicals, Chinese marks, squared units, ligatures, full and half width.
_RANGES = ((0xA0, 0x180), (0x2000, 0x20A0), (0x2100, 0x2150), (0x2E80, 0x2FE0), (0x3000, 0x3040), (0x3300, 0x3400), (0xFB00, 0xFB07), (0xFF00, 0xFFF0))
_FORMS = {chr(i): unicodedata.normalize("NFKC", chr(i)) for a, b in _RANGES for i in range(a, b) if unicodedata.normalize("NFKC", chr(i)) != chr(i)}
COMPAT = "compat AS (SELECT MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in _FORMS.items()) + "} AS forms)"


def folded_sql(c: str) -> str:
    """SQL of the folded form; the query must have ``forms`` of COMPAT at hand."""
    form = f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({c}, '(?s).'), lambda x: coalesce(forms[x], x)), ''))"
    return f"replace(replace(lower(CASE WHEN regexp_matches({c}, '[^\\x00-\\x7f]') THEN {form} ELSE {c} END), 'ß', 'ss'), 'ς', 'σ')"


def tokens_sql(c: str) -> str:
    """SQL list of the folded tokens of a text."""
    return rf"list_filter(list_transform(regexp_split_to_array({folded_sql(c)}, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\x{{200C}}\x{{200D}}]+|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\x{{200C}}\x{{200D}}]+$', '', 'g')), lambda w: w != '')"


_BLACK = "(" + ", ".join(f"'{w}'" for w in M.BLACKLIST) + ")"
INDEX = rf"""{COMPAT}, {EDGE}, nm AS (SELECT DISTINCT chebi_id AS concept, lang, title AS surface, lang = 'en' AS prim FROM concept_names WHERE trim(title) != ''),
tk AS (SELECT *, array_to_string(t, ' ') AS norm, len(t) AS n_tokens, regexp_matches(surface, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}]') AS cjk FROM (SELECT *, {tokens_sql('surface')} AS t FROM nm, compat) WHERE len(t) BETWEEN 1 AND 8),
own AS (SELECT DISTINCT norm, concept FROM tk WHERE prim),
kept AS (SELECT * FROM tk k WHERE (k.prim OR NOT EXISTS (SELECT 1 FROM own o WHERE o.norm = k.norm AND o.concept != k.concept) OR EXISTS (SELECT 1 FROM own o WHERE o.norm = k.norm AND o.concept = k.concept))
  AND CASE WHEN cjk THEN length(replace(norm, ' ', '')) >= 2 ELSE length(norm) >= 4 AND norm NOT IN {_BLACK} AND NOT regexp_matches(norm, '^[0-9]+$') END),
ix0 AS (SELECT norm, cjk, n_tokens, concept, list_sort(list(DISTINCT lang)) AS langs FROM kept GROUP BY ALL),
anc AS (SELECT a.child AS node, a.parent AS ancestor FROM edge a UNION SELECT a.child, b.parent FROM edge a JOIN edge b ON a.parent = b.child UNION SELECT a.child, c.parent FROM edge a JOIN edge b ON a.parent = b.child JOIN edge c ON b.parent = c.child),
few AS (SELECT norm, count(*) AS n FROM ix0 GROUP BY 1),
ix1 AS (SELECT i.* FROM ix0 i JOIN few USING (norm) WHERE n NOT BETWEEN 2 AND 8 OR NOT EXISTS (SELECT 1 FROM ix0 j JOIN anc ON anc.node = i.concept AND anc.ancestor = j.concept WHERE j.norm = i.norm)),
ix AS (SELECT * FROM ix1 WHERE norm IN (SELECT norm FROM ix1 GROUP BY 1 HAVING count(*) <= 3))"""


def index(spark: SparkSession, d: str) -> DataFrame:
    """The index of all names."""
    return once(spark, d, "index", lambda: M.name_index(concept_names(spark, d), concept_closure(spark, d)))


def concept_closure(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "closure", lambda: G.closure(concept_edges(spark, d)))


@query(f"WITH {INDEX} SELECT norm, cjk, CAST(n_tokens AS INT) AS n_tokens, concept, array_to_string(langs, ',') AS langs FROM ix")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    """Index of normalized names and their concepts."""
    return index(spark, d).withColumn("langs", F.array_join("langs", ","))


def corpus_docs(spark: SparkSession, d: str) -> DataFrame:
    """Whole contexts; an id that was delivered twice stays twice, as its texts are equal and hits are distinct."""
    return table(spark, d, "corpus", "id", "context", "publication_number", "language").where("id is not null").withColumnRenamed("context", "text")


def doc_pubs(spark: SparkSession, d: str) -> DataFrame:
    """(doc, pub, language) of known publications."""
    c = table(spark, d, "corpus", "id", "publication_number", "language").where("id is not null")
    return c.select(F.col("id").alias("doc"), F.trim("publication_number").alias("pub"), "language").where(known("pub")).distinct()


DOCS = rf"docs AS (SELECT id, any_value(trim(publication_number)) AS pub, any_value(language) AS language, any_value(context) AS text FROM corpus GROUP BY 1), dt AS (SELECT id, pub, language, ' ' || array_to_string(tk, ' ') || ' ' AS spaced, array_to_string(tk, '') AS dense FROM (SELECT *, {tokens_sql('text')} AS tk FROM docs, compat WHERE text IS NOT NULL))"
HITS = "hit AS (SELECT DISTINCT dt.id AS doc, dt.pub, ix.concept, ix.norm, ix.n_tokens, ix.cjk FROM dt JOIN ix ON CASE WHEN ix.cjk THEN contains(dense, replace(ix.norm, ' ', '')) ELSE contains(spaced, ' ' || ix.norm || ' ') END)"


@query(f"WITH {INDEX}, {DOCS}, {HITS} SELECT doc, concept, norm, CAST(n_tokens AS INT) AS n_tokens, cjk FROM hit")
def name_scan(spark: SparkSession, d: str) -> DataFrame:
    """Names that each context holds."""
    return M.scan(corpus_docs(spark, d), index(spark, d))


@query(f"WITH {INDEX}, {DOCS}, {HITS} SELECT doc, concept, norm FROM (SELECT *, row_number() OVER (PARTITION BY doc, concept ORDER BY cjk DESC, n_tokens DESC, norm DESC) AS r FROM hit) WHERE r = 1")
def best_name_match(spark: SparkSession, d: str) -> DataFrame:
    """The name by which a document is matched to a concept."""
    return M.best_match(M.scan(corpus_docs(spark, d), index(spark, d)))


@query(f"WITH {INDEX}, {DOCS}, {HITS} SELECT norm, count(DISTINCT doc) AS n_docs FROM hit GROUP BY 1")
def name_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a name."""
    return M.name_document_frequency(M.scan(corpus_docs(spark, d), index(spark, d)))


@query(f"WITH {INDEX}, {DOCS}, {HITS}, stop AS (SELECT norm FROM hit GROUP BY 1 HAVING count(DISTINCT doc) > 0.02 * (SELECT count(*) FROM docs)) SELECT norm, concept FROM ix WHERE norm NOT IN (SELECT norm FROM stop)")
def pruned_index(spark: SparkSession, d: str) -> DataFrame:
    """Index without names in more than a fiftieth of the documents."""
    docs, ix = corpus_docs(spark, d), index(spark, d)
    stop = M.stop_names(M.name_document_frequency(M.scan(docs, ix)), docs.select("id").distinct().count(), 0.02)
    return M.prune(ix, stop).select("norm", "concept")


@query(
    rf"""WITH {COMPAT}, {DOCS}, look AS (SELECT DISTINCT "corpus-id" AS id, neighbor_name AS name, {tokens_sql('neighbor_name')} AS tk, regexp_matches(neighbor_name, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}]') AS cjk FROM hard_negatives, compat WHERE neighbor_name IS NOT NULL)
    SELECT id, name, len(tk) BETWEEN 1 AND 8 AND CASE WHEN cjk THEN contains(dense, array_to_string(tk, '')) ELSE contains(spaced, ' ' || array_to_string(tk, ' ') || ' ') END AS named FROM look JOIN dt USING (id)"""
)
def contains_name(spark: SparkSession, d: str) -> DataFrame:
    """Whether each look-alike passage names the neighbor for which it was taken."""
    look = table(spark, d, "hard_negatives", "corpus-id", "neighbor_name").where("neighbor_name is not null").select(F.col("corpus-id").alias("id"), F.col("neighbor_name").alias("name")).distinct()
    docs = table(spark, d, "corpus", "id", "context").where("context is not null").join(look.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    both = look.withColumn("n", M.normalized(F.col("name"))).join(docs.withColumn("t", M.normalized(F.col("context"))), "id")
    return both.select("id", "name", T.contains_name(F.col("t"), F.col("n"), T.has_cjk(F.col("name"))).alias("named"))


@query(
    f"""WITH {INDEX}, {DOCS}, {HITS} SELECT doc, concept, norm, CASE WHEN list_contains(langs, language) THEN language WHEN len(list_filter(langs, lambda x: x != 'chebi')) = 0 THEN 'chebi' ELSE list_filter(langs, lambda x: x != 'chebi')[1] END AS name_language FROM (
      SELECT h.*, ix.langs, docs.language, row_number() OVER (PARTITION BY doc, h.concept ORDER BY h.cjk DESC, h.n_tokens DESC, h.norm DESC) AS r FROM hit h JOIN ix ON ix.norm = h.norm AND ix.concept = h.concept AND ix.cjk = h.cjk JOIN docs ON docs.id = h.doc) WHERE r = 1"""
)
def match_languages(spark: SparkSession, d: str) -> DataFrame:
    """The name by which a document is matched to a concept, and the language of that name."""
    ix = index(spark, d)
    best = M.best_match(M.scan(corpus_docs(spark, d), ix))
    lang = table(spark, d, "corpus", "id", "language").where("id is not null").select(F.col("id").alias("doc"), "language").distinct()
    langs = ix.groupBy("norm", "concept").agg(F.min("langs").alias("langs"))
    return best.join(langs, ["norm", "concept"]).join(lang, "doc").select("doc", "concept", "norm", M.pick_language(F.col("langs"), F.col("language")).alias("name_language"))


PUBS = f"pubs AS (SELECT DISTINCT concept, pub FROM hit WHERE pub NOT IN ('', {LOST}))"


def pubs(spark: SparkSession, d: str) -> DataFrame:
    """(concept, pub): known publications that name each concept."""
    return K.concept_publications(M.scan(corpus_docs(spark, d), index(spark, d)), doc_pubs(spark, d).select("doc", "pub"))


@query(f"WITH {INDEX}, {DOCS}, {HITS}, {PUBS} SELECT concept, count(*) AS n_pubs FROM pubs GROUP BY 1")
def concept_publications(spark: SparkSession, d: str) -> DataFrame:
    """Publications that name each concept."""
    return pubs(spark, d).groupBy("concept").agg(F.count("*").alias("n_pubs"))


NEG = f"""cand AS (SELECT concept, count(*) AS n_gold FROM pubs WHERE concept NOT IN (SELECT parent FROM edge) GROUP BY 1 HAVING count(*) >= 2),
neg AS (SELECT concept, pub, neighbor, relation FROM (SELECT c.concept, p.pub, r.neighbor, r.relation, row_number() OVER (PARTITION BY c.concept, p.pub ORDER BY CASE r.relation WHEN 'sibling' THEN 0 WHEN 'child' THEN 1 ELSE 2 END, r.neighbor) AS k
  FROM cand c JOIN rel r ON r.node = c.concept JOIN pubs p ON p.concept = r.neighbor WHERE NOT EXISTS (SELECT 1 FROM pubs q WHERE q.concept = c.concept AND q.pub = p.pub)) WHERE k = 1)"""


@query(f"WITH {INDEX}, {DOCS}, {HITS}, {PUBS}, {RELATIONS}, {NEG} SELECT concept, pub, neighbor, relation FROM neg")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Publications that name a neighbor of a concept and not the concept."""
    edges, p = concept_edges(spark, d), pubs(spark, d)
    return K.hard_negatives(p, K.candidates(p, edges, 2), edges)


@query(
    f"WITH {INDEX}, {DOCS}, {HITS}, {PUBS}, {RELATIONS}, {NEG} SELECT concept, n_gold, n AS n_hard_neg FROM cand JOIN (SELECT concept, count(*) AS n FROM neg GROUP BY 1 HAVING count(*) >= 3) USING (concept) ORDER BY n_gold DESC, concept LIMIT 25"
)
def kept_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent concepts with enough gold publications and hard negatives."""
    return K.kept_concepts(pubs(spark, d), concept_edges(spark, d), 2, 3, 25)


@query(
    """SELECT concept, lang, string_agg(surface, '|' ORDER BY surface) AS names FROM (SELECT chebi_id AS concept, lang, min(title) AS surface FROM concept_names WHERE title IS NOT NULL GROUP BY chebi_id, lang, lower(title)) GROUP BY 1, 2"""
)
def name_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of each concept and language, letter case ignored."""
    n = table(spark, d, "concept_names").where("title is not null").select(F.col("chebi_id").alias("concept"), "lang", F.col("title").alias("surface"), F.lit(0).alias("ord"))
    s = K.name_sets(n).select("concept", F.explode("names").alias("lang", "l"))
    return s.select("concept", "lang", F.array_join("l", "|").alias("names"))


@query("SELECT concept, string_agg(surface, '|' ORDER BY surface) AS aliases FROM (SELECT DISTINCT concept, surface FROM (SELECT chebi_id AS concept, lang, min(title) AS surface FROM concept_names WHERE title IS NOT NULL GROUP BY chebi_id, lang, lower(title))) GROUP BY 1")
def alias_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of each concept over all languages."""
    n = table(spark, d, "concept_names").where("title is not null").select(F.col("chebi_id").alias("concept"), "lang", F.col("title").alias("surface"), F.lit(0).alias("ord"))
    return K.name_sets(n).select("concept", F.array_join(F.sort_array(K.all_aliases(F.col("names"))), "|").alias("aliases"))


def title_checks(spark: SparkSession, d: str) -> DataFrame:
    """Title checks of concepts named in English contexts against the parallel texts."""
    docs = corpus_docs(spark, d).where(known("publication_number"))
    en = docs.where("language = 'en'")
    found = M.scan(en, index(spark, d)).join(en.select(F.col("id").alias("doc"), F.col("publication_number").alias("pub")), "doc").select("concept", "pub").distinct()
    rows = docs.where("language in ('de', 'fr', 'es', 'zh') and trim(text) != ''").select(F.col("publication_number").alias("pub"), F.col("language").alias("lang"), "text", "id")
    last = rows.groupBy("pub", "lang").agg(F.max_by("text", "id").alias("text"))
    names = concept_names(spark, d)
    titles = names.groupBy("concept", "lang").agg(F.min("surface").alias("surface"))
    return K.title_checks(found, last, titles, names)


CHECKS = f"""{INDEX}, d0 AS (SELECT id, any_value(publication_number) AS pub, any_value(language) AS language, any_value(context) AS text FROM corpus WHERE {KNOWN} GROUP BY 1),
dt AS (SELECT id, pub, language, ' ' || array_to_string(tk, ' ') || ' ' AS spaced, array_to_string(tk, '') AS dense FROM (SELECT *, {tokens_sql('text')} AS tk FROM d0, compat WHERE text IS NOT NULL AND language = 'en')), {HITS},
par AS (SELECT pub, language AS lang, arg_max(text, id) AS text FROM d0 WHERE language IN ('de', 'fr', 'es', 'zh') AND trim(text) != '' GROUP BY 1, 2),
tit AS (SELECT concept, lang, min(surface) AS title FROM nm GROUP BY 1, 2),
chk AS (SELECT h.concept, h.pub, p.lang, t.title, contains(lower(p.text), lower(t.title)) AS title_present, p.text FROM (SELECT DISTINCT concept, pub FROM hit) h JOIN par p USING (pub) JOIN tit t ON t.concept = h.concept AND t.lang = p.lang),
res AS (SELECT concept, pub, lang, title, title_present, any_present, CASE WHEN NOT title_present AND any_present THEN other END AS instead FROM (
  SELECT c.concept, c.pub, c.lang, c.title, c.title_present, coalesce(bool_or(contains(lower(c.text), lower(n.surface))), false) AS any_present, min(CASE WHEN contains(lower(c.text), lower(n.surface)) THEN n.surface END) AS other
  FROM chk c LEFT JOIN (SELECT DISTINCT concept, surface FROM nm) n USING (concept) GROUP BY ALL))"""


@query(f"WITH {CHECKS} SELECT concept, pub, lang, title, title_present, any_present, instead FROM res")
def name_quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether parallel texts use a concept's title, another of its names, or neither."""
    return title_checks(spark, d)


@query(f"WITH {CHECKS} SELECT lang, count(*) AS n_pairs, CAST(sum(CAST(title_present AS INT)) AS BIGINT) AS n_title, CAST(sum(CAST(any_present AS INT)) AS BIGINT) AS n_any, round(sum(CAST(title_present AS INT)) / count(*), 6) AS title_rate, round(sum(CAST(any_present AS INT)) / count(*), 6) AS any_rate FROM res GROUP BY 1")
def name_quality_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the title checks by language."""
    return K.check_rates(title_checks(spark, d))


@query(f"WITH {CHECKS} SELECT concept, lang, title, instead, count(*) AS n FROM res WHERE instead IS NOT NULL GROUP BY ALL ORDER BY n DESC, concept, lang, instead LIMIT 40")
def name_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Names most often used instead of the title."""
    return K.mismatches(title_checks(spark, d))


@query(
    f"""WITH {INDEX}, {DOCS}, {HITS}, {PUBS}, ps AS (SELECT pub, lower(text) AS t FROM docs WHERE text IS NOT NULL AND pub NOT IN ('', {LOST})) SELECT DISTINCT p.pub, p.concept FROM pubs p JOIN nm USING (concept) JOIN ps ON ps.pub = p.pub WHERE contains(ps.t, lower(nm.surface))"""
)
def groundable_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of a publication with a name in its passages."""
    passages = corpus_docs(spark, d).select(F.trim("publication_number").alias("pub"), "text").where(known("pub") & F.col("text").isNotNull())
    return K.groundable(pubs(spark, d), concept_names(spark, d), passages)


@query(
    f"""WITH {INDEX}, {DOCS}, {HITS}, {PUBS}, ps AS (SELECT pub, string_agg(lower(text), chr(10) ORDER BY lower(text)) AS t FROM docs WHERE text IS NOT NULL AND pub NOT IN ('', {LOST}) GROUP BY 1)
    SELECT pub, concept, surface AS answer, held AS grounded FROM (SELECT *, row_number() OVER (PARTITION BY pub, concept ORDER BY CASE WHEN held AND lang = 'de' THEN 0 WHEN held THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END, surface, lang) AS r
    FROM (SELECT p.pub, p.concept, nm.lang, nm.surface, contains(ps.t, lower(nm.surface)) AS held FROM pubs p JOIN nm USING (concept) JOIN ps ON ps.pub = p.pub)) WHERE r = 1"""
)
def picked_answers(spark: SparkSession, d: str) -> DataFrame:
    """The name that answers a question in German about a concept of a publication."""
    passages = corpus_docs(spark, d).select(F.trim("publication_number").alias("pub"), "text").where(known("pub") & F.col("text").isNotNull())
    return K.pick_answer(pubs(spark, d), concept_names(spark, d), passages, "de")


ALIAS = f"""stop AS (SELECT norm FROM hit GROUP BY 1 HAVING count(DISTINCT doc) > 0.02 * (SELECT count(*) FROM docs)), left_hit AS (SELECT * FROM hit WHERE norm NOT IN (SELECT norm FROM stop)), pubs AS (SELECT DISTINCT concept, pub FROM left_hit WHERE pub NOT IN ('', {LOST})), {RELATIONS}, {NEG},
kc AS (SELECT concept, n_gold, n AS n_hard_neg FROM cand JOIN (SELECT concept, count(*) AS n FROM neg GROUP BY 1 HAVING count(*) >= 3) USING (concept))"""


def alias_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = corpus_docs(spark, d)
    n = docs.select("id").distinct().count()
    return K.alias_graph(M.scan(docs, index(spark, d)), doc_pubs(spark, d), concept_names(spark, d), concept_edges(spark, d), n, 0.02, 2, 3)


@query(
    f"""WITH {INDEX}, {DOCS}, {HITS}, {ALIAS} SELECT k.concept, coalesce((SELECT min(surface) FROM nm WHERE nm.concept = k.concept AND prim), k.concept) AS name, n_gold, n_hard_neg,
    coalesce((SELECT string_agg(DISTINCT language, '|' ORDER BY language) FROM left_hit h JOIN docs ON docs.id = h.doc WHERE h.concept = k.concept AND h.pub NOT IN ('', {LOST})), '') AS gold_langs,
    (SELECT count(*) FROM rel WHERE rel.node = k.concept AND rel.neighbor IN (SELECT concept FROM pubs)) AS n_neighbors FROM kc k"""
)
def alias_graph(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of the concept benchmark: stop names pruned, concepts kept by gold publications and hard negatives."""
    return alias_tables(spark, d)[0].withColumn("gold_langs", F.array_join("gold_langs", "|"))


@query(f"WITH {INDEX}, {DOCS}, {HITS}, {ALIAS} SELECT 'gold' AS kind, p.concept, p.pub, NULL AS neighbor, NULL AS relation FROM pubs p JOIN kc USING (concept) UNION ALL SELECT 'negative', n.concept, n.pub, n.neighbor, n.relation FROM neg n JOIN kc USING (concept)")
def alias_graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """Gold publications and hard negatives of the concept benchmark."""
    _, gold, negatives = alias_tables(spark, d)
    none = F.lit(None).cast("string")
    return gold.select(F.lit("gold").alias("kind"), "concept", "pub", none.alias("neighbor"), none.alias("relation")).unionByName(negatives.withColumn("kind", F.lit("negative")))
