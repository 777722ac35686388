"""Queries of text variants: anchors, swaps, variant rows and ladders. Picks are hashes of seed and keys, so SQL can follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.perturb import perturbed, perturbed_sql
from ..operators import variants as V
from ..operators.corpus import known
from .concepts import DOCS, HITS, INDEX, PUBS, concept_names, pubs
from .corpus import KNOWN
from .registry import query, table

SEED = 17
FIELDS = V.TEXT_FIELDS


def rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus", "id", "publication_number", "language", *FIELDS)
    c = c.where(F.col("id").isNotNull() & known("publication_number")).dropDuplicates(["id"])
    return c.select("id", F.trim("publication_number").alias("pub"), F.lower(F.trim("language")).alias("language"), *FIELDS)


def names(spark: SparkSession, d: str) -> DataFrame:
    """(concept, lang, surface, primary): titles, and as forms of the ontology the English title and a number."""
    n = concept_names(spark, d).select("concept", "lang", F.trim("surface").alias("surface"), F.lit(False).alias("primary"))
    title = n.where("lang = 'en'").select("concept", F.lit("chebi").alias("lang"), "surface", F.lit(True).alias("primary"))
    number = n.where("lang = 'en'").select("concept", F.lit("chebi").alias("lang"), F.concat(F.lit("C"), F.substring("concept", 7, 9)).alias("surface"), F.lit(False).alias("primary"))
    return n.unionByName(title).unionByName(number).distinct()


# ---------------------------------------------------------------- SQL of terms

# word characters of Latin, Greek, Cyrillic and Chinese texts; the whole classes are slow to compile for each row
_W = r"0-9A-Za-z_ªµºÀ-ÖØ-öø-ˁ\x{300}-\x{374}Ͷ-ͽ\x{386}-\x{481}\x{483}-\x{52F}\x{1E00}-\x{1FBC}\x{200C}\x{200D}\x{203F}\x{2040}\x{3005}-\x{3007}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FB00}-\x{FB06}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF3F}\x{FF41}-\x{FF5A}"
_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"


def _bordered(term: str) -> str:
    return f"'(?i)(^|[^{_W}])' || regexp_escape({term}) || '($|[^{_W}])'"


def holds_sql(text: str, term: str) -> str:
    return f"CASE WHEN regexp_matches({term}, '{_CJK}') THEN contains({text}, {term}) ELSE contains(lower({text}), lower({term})) AND regexp_matches({text}, {_bordered(term)}) END"


def replaced_sql(text: str, term: str, new: str) -> str:
    """Every occurrence replaced; twice, as neighboring occurrences share a border."""
    once = lambda t: f"regexp_replace({t}, {_bordered(term)}, '\\1' || replace({new}, '\\', '\\\\') || '\\2', 'g')"
    return f"CASE WHEN regexp_matches({term}, '{_CJK}') THEN replace({text}, {term}, {new}) WHEN contains(lower({text}), lower({term})) THEN {once(once(text))} ELSE {text} END"


def clean_sql(a: str, b: str) -> str:
    return f"coalesce({b} != '' AND {a} != '' AND lower({a}) != lower({b}) AND NOT (CASE WHEN regexp_matches({a}, '{_CJK}') THEN contains({b}, {a}) ELSE regexp_matches({b}, {_bordered(a)}) END), false)"


_LANGS = "('en', 'de', 'fr', 'es', 'zh')"
_CLEAN = r"coalesce(nullif(trim(regexp_replace(surface, '\s*\([^()]*\)\s*$', '')), ''), surface)"
_ALL = " || chr(10) || ".join(f"coalesce({f}, '')" for f in FIELDS)
NAMED = rf"""{INDEX}, {DOCS}, {HITS}, {PUBS}, rw AS (SELECT id, any_value(trim(publication_number)) AS pub, any_value(lower(trim(language))) AS language, {', '.join(f'any_value({f}) AS {f}' for f in FIELDS)} FROM corpus WHERE {KNOWN} AND id IS NOT NULL GROUP BY 1),
nms AS (SELECT DISTINCT * FROM (SELECT concept, lang, trim(surface) AS surface, false AS prim FROM nm UNION ALL SELECT concept, 'chebi', trim(surface), true FROM nm WHERE lang = 'en' UNION ALL SELECT concept, 'chebi', 'C' || substr(concept, 7, 9), false FROM nm WHERE lang = 'en')),
tm AS (SELECT DISTINCT concept, lang, surface AS term FROM nms WHERE lang IN {_LANGS} OR lang = 'chebi' AND (prim OR length(surface) >= 8 OR regexp_matches(surface, '[\d\- ]'))),
tx AS MATERIALIZED (SELECT id, pub, language, {_ALL} AS doc FROM rw WHERE language IN {_LANGS}),
nr0 AS MATERIALIZED (SELECT t.id, t.pub, t.language AS anchor_language, tm.concept, tm.lang = t.language AS nat, tm.term FROM tx t JOIN pubs p ON p.pub = t.pub JOIN tm ON tm.concept = p.concept AND (tm.lang = t.language OR tm.lang = 'chebi') WHERE {holds_sql('t.doc', 'tm.term')}),
nr AS (SELECT DISTINCT id, pub, anchor_language, concept, nat, term FROM nr0 x WHERE nat OR NOT EXISTS (SELECT 1 FROM nr0 y WHERE y.id = x.id AND y.concept = x.concept AND y.nat)),
hv AS (SELECT pub, list(DISTINCT language) AS have FROM tx GROUP BY 1),
rp AS (SELECT DISTINCT concept, lang AS target, CASE WHEN lang = 'chebi' THEN surface ELSE {_CLEAN} END AS replacement FROM nms)"""
ANCHORS = f"{NAMED}, an AS (SELECT concept, pub, anchor_language, term, id FROM (SELECT *, row_number() OVER (PARTITION BY concept, pub ORDER BY nat DESC, md5('{SEED}|' || id || '|' || term), id, term) AS k FROM nr) WHERE k = 1)"


def _modes_sql(source: str) -> str:
    return f"""SELECT a.concept, a.pub, a.anchor_language, a.term, a.id, CASE WHEN target = 'chebi' THEN 'F' WHEN target NOT IN {_LANGS} THEN NULL WHEN list_contains(have, target) AND target != a.anchor_language THEN 'B' WHEN NOT list_contains(have, target) THEN 'C' END AS mode, r.target, r.replacement
    FROM {source} a JOIN hv USING (pub) JOIN rp r ON r.concept = a.concept WHERE {clean_sql('a.term', 'r.replacement')}"""


SWAPS = rf"""{ANCHORS}, md AS (SELECT * FROM ({_modes_sql('an')}) WHERE mode IS NOT NULL), an2 AS (SELECT *, '{SEED}|' || concept || '|' || pub AS seed FROM an), {perturbed_sql('an2', 'term', 'seed', 'replacement')},
sw AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY concept, pub, mode ORDER BY CASE WHEN mode = 'F' AND regexp_matches(replacement, '\d') THEN 0 ELSE 1 END, md5('{SEED}|' || target || '|' || replacement), target, replacement) AS k FROM md) WHERE k = 1
  UNION ALL SELECT concept, pub, anchor_language, term, id, 'D', anchor_language, replacement FROM an2_spelled WHERE replacement IS NOT NULL)"""
_CARRIED = ", ".join(FIELDS)
_CHANGED = " OR ".join("coalesce(" + holds_sql(f"coalesce({f}, '')", "term") + ", false)" for f in FIELDS)
SWITCHED = f"""{SWAPS}, cs AS (SELECT mode AS variant, concept, term AS original_term, replacement AS replacement_term, anchor_language, target AS target_language, id AS source_id, s.pub AS source_publication_number, {', '.join(f"{replaced_sql(f, 'term', 'replacement')} AS {f}" for f in FIELDS)}
  FROM sw s JOIN (SELECT id, {_CARRIED} FROM rw) r USING (id) WHERE {_CHANGED}
  UNION ALL SELECT 'A', concept, term, '', anchor_language, '', id, an.pub, {_CARRIED} FROM an JOIN (SELECT id, {_CARRIED} FROM rw) r USING (id))"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return V.anchors(pubs(spark, d), names(spark, d), rows(spark, d), SEED)


@query(f"WITH {ANCHORS} SELECT concept, pub, anchor_language, term, id FROM an")
def anchor_terms(spark: SparkSession, d: str) -> DataFrame:
    """Where each concept is anchored in each publication."""
    return anchors(spark, d)


@query(f"WITH {SWITCHED} SELECT *, source_id || '__' || variant || '__' || concept AS id FROM cs")
def code_switched(spark: SparkSession, d: str) -> DataFrame:
    """Variant rows of all modes."""
    a, r = anchors(spark, d), rows(spark, d)
    return V.code_switched(V.replacements(a, names(spark, d), r, ("A", *V.MODES), SEED), r)


@query(f"WITH {SWITCHED} SELECT variant, count(*) AS n FROM cs GROUP BY 1")
def variant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Variant rows by mode."""
    return code_switched(spark, d).groupBy("variant").agg(F.count("*").alias("n"))


def all_swaps(spark: SparkSession, d: str) -> DataFrame:
    r, n = rows(spark, d), names(spark, d)
    a = V.row_anchors(pubs(spark, d), n, r)
    return V.replacements(a, n, r, V.MODES, SEED)


N_STEPS = 3
_STATE = lambda k: f"{{{', '.join(repr(f) + ': ' + replaced_sql(f's{k - 1}.{f}', f'g[{k}].term', f'g[{k}].replacement') for f in FIELDS)}}}"
_FOUND = lambda k: " OR ".join("coalesce(" + holds_sql(f"s{k - 1}.{f}", f"g[{k}].term") + ", false)" for f in FIELDS)
_CLASH = lambda a, b: f"contains(lower({a}.term), lower({b}.term)) OR contains(lower({b}.term), lower({a}.term))"
LADDER = rf"""{NAMED}, ra AS (SELECT concept, pub, anchor_language, id, min(term) AS term FROM nr GROUP BY ALL), md AS (SELECT * FROM ({_modes_sql('ra')}) WHERE mode IS NOT NULL),
ra2 AS (SELECT *, '{SEED}|' || concept || '|' || pub AS seed FROM ra), {perturbed_sql('ra2', 'term', 'seed', 'replacement')},
sw AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY concept, id, mode ORDER BY CASE WHEN mode = 'F' AND regexp_matches(replacement, '\d') THEN 0 ELSE 1 END, md5('{SEED}|' || target || '|' || replacement), target, replacement) AS k FROM md) WHERE k = 1
  UNION ALL SELECT concept, pub, anchor_language, term, id, 'D', anchor_language, replacement FROM ra2_spelled WHERE replacement IS NOT NULL),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, concept ORDER BY md5('{SEED}|' || id || '|' || concept || '|' || mode || '|' || replacement), term, mode, target, replacement) AS k FROM sw) WHERE k = 1),
bs AS (SELECT pub, id, anchor_language, count(*) AS n, list({{'concept': concept, 'term': term, 'mode': mode, 'target': target, 'replacement': replacement}} ORDER BY md5('{SEED}|' || id || '|' || concept), concept) AS q FROM st GROUP BY 1, 2, 3 HAVING count(*) >= {N_STEPS}),
b1 AS (SELECT *, q[1] AS c1, 1 AS i1 FROM bs QUALIFY row_number() OVER (PARTITION BY pub ORDER BY n DESC, list_position(['en', 'de', 'fr', 'es', 'zh'], anchor_language), id) = 1),
b2 AS (SELECT *, list_filter(q, lambda x, i: i > 1 AND NOT ({_CLASH('x', 'c1')})) AS q2 FROM b1), b3 AS (SELECT *, q2[1] AS c2 FROM b2),
b4 AS (SELECT *, list_filter(q2, lambda x, i: i > 1 AND NOT ({_CLASH('x', 'c2')}))[1] AS c3 FROM b3),
g0 AS (SELECT pub, id, anchor_language, [c1, c2, c3] AS g FROM b4 WHERE c2 IS NOT NULL AND c3 IS NOT NULL),
g1 AS (SELECT g0.*, {{{', '.join(f"'{f}': coalesce({f}, '')" for f in FIELDS)}}} AS s0 FROM g0 JOIN rw USING (id)),
g2 AS (SELECT *, {_STATE(1)} AS s1, {_FOUND(1)} AS f1 FROM g1), g3 AS (SELECT *, {_STATE(2)} AS s2, {_FOUND(2)} AS f2 FROM g2), g4 AS (SELECT *, {_STATE(3)} AS s3, {_FOUND(3)} AS f3 FROM g3),
ld AS (SELECT id AS base_id, pub, anchor_language, g, CAST(dp AS INT) AS depth, [s0, s1, s2, s3][dp + 1] AS s FROM g4, range(4) t(dp) WHERE f1 AND f2 AND f3)"""


@query(
    f"""WITH {LADDER} SELECT base_id || '__r' || depth AS id, base_id, pub AS source_publication_number, anchor_language, depth, CASE depth WHEN 0 THEN 'none' ELSE g[depth].mode END AS mode_added, g[1].concept AS question_concept_chebi_id,
    (SELECT min(surface) FROM nm WHERE nm.concept = g[1].concept AND prim) AS question_concept_name, g[1].term AS question_original_term, {', '.join(f's.{f}' for f in FIELDS)},
    '[' || array_to_string(list_transform(g[1:depth], lambda x, i: '{{"step":' || i || ',"concept_id":' || to_json(x.concept) || ',"original":' || to_json(x.term) || ',"replacement":' || to_json(x.replacement) || ',"mode":' || to_json(x.mode) || ',"target_language":' || to_json(x.target) || '}}'), ',') || ']' AS replacements_json FROM ld"""
)
def swap_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Rows with zero to three names replaced, step by step."""
    labels = concept_names(spark, d).where("primary").groupBy("concept").agg(F.min("surface").alias("name"))
    return V.ladder(rows(spark, d), all_swaps(spark, d), labels, N_STEPS, SEED)


@query(f"WITH {LADDER} SELECT depth, CASE depth WHEN 0 THEN 'none' ELSE g[depth].mode END AS mode_added, count(*) AS n FROM ld GROUP BY 1, 2")
def ladder_steps(spark: SparkSession, d: str) -> DataFrame:
    """Ladder rows by depth and added mode."""
    return swap_ladder(spark, d).groupBy("depth", "mode_added").agg(F.count("*").alias("n"))


@query(f"WITH src AS (SELECT DISTINCT chebi_id, lang, title, chebi_id || '|' || lang AS seed FROM concept_names WHERE trim(title) != ''), {perturbed_sql('src', 'title', 'seed')} SELECT chebi_id, lang, title, spelled FROM src_spelled")
def perturbed_names(spark: SparkSession, d: str) -> DataFrame:
    """A changed spelling of each name."""
    n = table(spark, d, "concept_names").where("trim(title) != ''").distinct()
    return n.select("chebi_id", "lang", "title", perturbed(F.col("title"), F.concat_ws("|", "chebi_id", "lang")).alias("spelled"))


@query(f"SELECT DISTINCT a.chebi_id, a.lang, b.lang AS target, a.title AS original, b.title AS replacement, {clean_sql('trim(a.title)', 'trim(b.title)')} AS clean FROM concept_names a JOIN concept_names b ON a.chebi_id = b.chebi_id AND a.lang < b.lang")
def clean_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name may replace another of the same concept."""
    n = table(spark, d, "concept_names")
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.chebi_id") == F.col("b.chebi_id")) & (F.col("a.lang") < F.col("b.lang")))
    return j.select("a.chebi_id", "a.lang", F.col("b.lang").alias("target"), F.col("a.title").alias("original"), F.col("b.title").alias("replacement"), T.clean_swap(F.col("a.title"), F.col("b.title")).alias("clean")).distinct()
