"""Controlled text variants: one name of a concept replaced by another, once or step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.perturb import draw, perturbed
from . import matching as M

LANGUAGES = ("en", "de", "fr", "es", "zh")
TEXT_FIELDS = ("title", "abstract", "description", "first_claim", "context")
MODES = ("B", "C", "D", "F")


def document_text(row_fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """All texts of a row joined by line ends.

    A context that only repeats title, abstract and first claim adds its labels and nothing else.
    """
    texts = {f: F.coalesce(F.col(f), F.lit("")) for f in row_fields}
    if {"title", "abstract", "first_claim", "context"} <= set(row_fields):
        parts = [F.col(f) for f in ("title", "abstract", "first_claim")]
        texts["context"] = F.when(texts["context"] == T.context(*parts), F.lit("Title: \n\nAbstract: \n\nFirst claim: ")).otherwise(texts["context"])
    return F.concat_ws("\n", *texts.values())


def holds(text: Column, term: Column) -> Column:
    """Whether a text holds a term at word borders; Chinese terms match anywhere."""
    # the plain test comes first: patterns differ by row and are costly to compile
    quoted = F.when(T.has_cjk(term), F.contains(text, term)).otherwise(F.contains(F.lower(text), F.lower(term)) & F.regexp_like(text, T.term_pattern(term)))
    return F.coalesce(quoted & (F.trim(term) != ""), F.lit(False))


def replace_in_fields(rows: DataFrame, term: Column, replacement: Column, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """``rows`` with every occurrence of the term replaced in all text fields, and ``changed``; fields without it aren't searched twice."""
    flagged = rows.withColumns({f"_{f}": holds(F.coalesce(F.col(f), F.lit("")), term) for f in fields})
    changed = F.greatest(*[F.col(f"_{f}") for f in fields]) if len(fields) > 1 else F.col(f"_{fields[0]}")
    out = flagged.withColumns({"changed": changed, **{f: F.when(F.col(f"_{f}"), T.replace_term(F.col(f), term, replacement)).otherwise(F.col(f)) for f in fields}})
    return out.drop(*[f"_{f}" for f in fields])


def order(seed: int, *columns: str) -> Column:
    """Seeded order."""
    return draw(F.lit(str(seed)), *map(F.col, columns))


def anchor_names(names: DataFrame) -> DataFrame:
    """(concept, name_language, term) that may anchor a concept: names in the languages of rows, and of the
    ontology's forms (``chebi``) the primary one and the distinctive ones; ``names`` is (concept, lang, surface, primary)."""
    use = F.col("lang").isin(*LANGUAGES) | ((F.col("lang") == "chebi") & (F.col("primary") | T.distinctive(F.col("surface"))))
    return names.where(use).select("concept", F.col("lang").alias("name_language"), F.trim("surface").alias("term")).distinct()


def named_rows(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, pub, anchor_language, concept, natural, term): names that each row of a known language holds.

    Names of the row's own language are natural ones; the ontology's forms count where the row holds no natural
    name of the concept. The texts are read once; only keys and names leave this step.
    """
    fields = tuple(f for f in TEXT_FIELDS if f in rows.columns)
    use = rows.where(F.col("language").isin(*LANGUAGES)).select("id", "pub", F.col("language").alias("anchor_language"), document_text(fields).alias("doc"))
    hits = M.term_hits(use, anchor_names(names), ("id", "pub", "anchor_language"), "doc")
    hits = hits.withColumn("natural", F.col("name_language") == F.col("anchor_language")).where(F.col("natural") | (F.col("name_language") == "chebi"))
    best = F.max("natural").over(Window.partitionBy("id", "pub", "anchor_language", "concept"))
    return hits.withColumn("_best", best).where("natural = _best").select("id", "pub", "anchor_language", "concept", "natural", "term")


def anchors(concept_pubs: DataFrame, names: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """(concept, pub, anchor_language, term, id): per concept and publication a row and a name that it holds.

    Natural names of any of the publication's rows come before forms of the ontology; of equal ones the
    seeded order decides.
    """
    found = named_rows(names, rows).join(concept_pubs.select("concept", "pub"), ["concept", "pub"], "left_semi")
    w = Window.partitionBy("concept", "pub").orderBy(F.desc("natural"), order(seed, "id", "term"), "id", "term")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("concept", "pub", "anchor_language", "term", "id")


def row_anchors(concept_pubs: DataFrame, names: DataFrame, rows: DataFrame) -> DataFrame:
    """(concept, pub, anchor_language, term, id): for every row one name of every concept that it holds, the smallest."""
    found = named_rows(names, rows).join(concept_pubs.select("concept", "pub"), ["concept", "pub"], "left_semi")
    return found.groupBy("concept", "pub", "anchor_language", "id").agg(F.min("term").alias("term")).select("concept", "pub", "anchor_language", "term", "id")


def replacements(anchor: DataFrame, names: DataFrame, rows: DataFrame, modes: tuple[str, ...], seed: int) -> DataFrame:
    """(anchor..., mode, target, replacement): for each mode one replacement of an anchor, if there is a clean one.

    A the term as it is; B a name in another language that the publication has, C in one that it lacks, F a form
    of the ontology, those with a digit first; D another spelling. Of equal ones the seeded order decides. The
    names of a concept, a few, stand in one array, so each anchor meets them once.
    """
    have = rows.where(F.col("language").isin(*LANGUAGES)).groupBy("pub").agg(F.collect_set("language").alias("have"))
    new = F.when(F.col("lang") == "chebi", F.col("surface")).otherwise(T.clean_name(F.col("surface")))
    n = names.select("concept", F.col("lang").alias("target"), new.alias("replacement")).where(F.col("target").isin(*LANGUAGES, "chebi")).distinct()
    n = n.groupBy("concept").agg(F.collect_list(F.struct(draw(F.lit(str(seed)), F.col("target"), F.col("replacement")).alias("h"), "target", "replacement")).alias("options"))
    met = anchor.join(have, "pub").join(n, "concept", "left")
    clean = F.filter(F.coalesce("options", F.array().cast("array<struct<h:string,target:string,replacement:string>>")), lambda o: T.clean_swap(F.col("term"), o["replacement"]))
    met = met.withColumn("options", clean)
    here = lambda o: F.array_contains("have", o["target"])
    of = {
        "B": lambda o: (o["target"] != "chebi") & (o["target"] != F.col("anchor_language")) & here(o),
        "C": lambda o: (o["target"] != "chebi") & ~here(o),
        "F": lambda o: o["target"] == "chebi",
    }
    choice = lambda mode, o: F.struct(F.lit(mode).alias("mode"), o["target"].alias("target"), o["replacement"].alias("replacement"))
    picks = []
    for m in modes:
        if m in of:
            ranked = F.transform(F.filter("options", of[m]), lambda o: F.struct(F.when(o["replacement"].rlike(r"\d") & F.lit(m == "F"), 0).otherwise(1).alias("r"), o["h"], o["target"], o["replacement"]))
            best = F.try_element_at(F.sort_array(ranked), F.lit(1))
            picks.append(F.when(best.isNotNull(), choice(m, {"target": best["target"], "replacement": best["replacement"]})))
        elif m == "D":
            spelled = perturbed(F.col("term"), F.concat_ws("|", F.lit(str(seed)), "concept", "pub"))
            picks.append(F.when(spelled.isNotNull(), choice(m, {"target": F.col("anchor_language"), "replacement": spelled})))
        else:
            picks.append(choice(m, {"target": F.lit(""), "replacement": F.lit("")}))
    each = met.select(*anchor.columns, F.explode(F.filter(F.array(*picks), lambda s: s.isNotNull())).alias("s"))
    return each.select(*anchor.columns, "s.mode", "s.target", "s.replacement")


def code_switched(swaps: DataFrame, rows: DataFrame) -> DataFrame:
    """Variant rows: the anchor row as it is (mode A), and with its term replaced; rows in which nothing changed are left out.

    ``rows`` has id and the text fields, all of which are carried; the result adds variant, concept, original_term,
    replacement_term, anchor_language, target_language, source_id and source_publication_number.
    """
    tracked = swaps.select(
        F.col("mode").alias("variant"), "concept", F.col("term").alias("original_term"), F.col("replacement").alias("replacement_term"), "anchor_language",
        F.col("target").alias("target_language"), F.col("id").alias("source_id"), F.col("pub").alias("source_publication_number"),
    )
    fields = tuple(f for f in TEXT_FIELDS if f in rows.columns)
    made = tracked.join(rows.select(F.col("id").alias("source_id"), *fields), "source_id")
    copy = F.col("variant") == "A"
    made = replace_in_fields(made, F.when(copy, "").otherwise(F.col("original_term")), F.col("replacement_term"), fields).where(copy | F.col("changed")).drop("changed")
    return made.withColumn("id", F.concat_ws("__", "source_id", "variant", "concept"))


def ladder(rows: DataFrame, swaps: DataFrame, concept_labels: DataFrame, n_steps: int, seed: int) -> DataFrame:
    """Each base row with 0 to ``n_steps`` terms replaced, cumulatively.

    (id, base_id, source_publication_number, anchor_language, depth, mode_added, question_concept_chebi_id,
    question_concept_name, question_original_term, text..., replacements_json). Per publication the row with
    the most swappable terms, by the order of languages on ties; ``n_steps`` terms in seeded order whose
    surfaces don't overlap, each with one seeded mode; the question is about the first. A base in which a
    term is gone before its turn is dropped as a whole. Everything up to the choice works on keys; the
    texts join once. ``concept_labels`` is (concept, name).
    """
    s = lambda *c: order(seed, "id", *c)
    one = swaps.groupBy("pub", "id", "anchor_language", "concept").agg(F.min(F.struct(s("concept", "mode", "replacement").alias("h"), "term", "mode", "target", "replacement")).alias("m"))
    step = F.struct(s("concept").alias("h"), "concept", "m.term", "m.mode", "m.target", "m.replacement")
    terms = one.groupBy("pub", "id", "anchor_language").agg(F.sort_array(F.collect_list(step)).alias("steps")).withColumn("n", F.size("steps")).where(F.col("n") >= n_steps)
    place = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("anchor_language"))
    w = Window.partitionBy("pub").orderBy(F.desc("n"), place, "id")
    base = terms.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    low = lambda x: F.lower(x["term"])
    clash = lambda a, b: F.contains(low(a), low(b)) | F.contains(low(b), low(a))
    add = lambda acc, x: F.when((F.size(acc) < n_steps) & ~F.exists(acc, lambda t: clash(t, x)), F.array_append(acc, x)).otherwise(acc)
    chosen = base.withColumn("chosen", F.aggregate("steps", F.slice("steps", 1, 0), add)).where(F.size("chosen") == n_steps)
    chosen = chosen.withColumn("concept", F.element_at("chosen", 1)["concept"]).join(concept_labels, "concept", "left")
    fields = [f for f in TEXT_FIELDS if f in rows.columns]
    full = chosen.join(rows.select("id", *[F.coalesce(f, F.lit("")).alias(f) for f in fields]), "id")

    def swapped(state: Column, x: Column) -> Column:
        found = F.lit(False)
        for f in fields:
            found = found | holds(state[f], x["term"])
        return F.struct(*[T.replace_term(state[f], x["term"], x["replacement"]).alias(f) for f in fields], (state["whole"] & found).alias("whole"))

    start = F.array(F.struct(*fields, F.lit(True).alias("whole")))
    climbed = full.withColumn("rungs", F.aggregate("chosen", start, lambda acc, x: F.array_append(acc, swapped(F.element_at(acc, -1), x))))
    told = F.transform("chosen", lambda x, i: F.named_struct(F.lit("step"), i + 1, F.lit("concept_id"), x["concept"], F.lit("original"), x["term"], F.lit("replacement"), x["replacement"], F.lit("mode"), x["mode"], F.lit("target_language"), x["target"]))
    each = climbed.where(F.element_at("rungs", -1)["whole"]).select("id", "pub", "anchor_language", "concept", "name", "chosen", told.alias("told"), F.posexplode("rungs").alias("depth", "r"))
    return each.select(
        F.concat("id", F.lit("__r"), "depth").alias("id"), F.col("id").alias("base_id"), F.col("pub").alias("source_publication_number"), "anchor_language", "depth",
        F.when(F.col("depth") == 0, "none").otherwise(F.try_element_at("chosen", F.greatest("depth", F.lit(1)))["mode"]).alias("mode_added"),
        F.col("concept").alias("question_concept_chebi_id"), F.col("name").alias("question_concept_name"), F.element_at("chosen", 1)["term"].alias("question_original_term"),
        *[F.col("r")[f].alias(f) for f in fields], F.to_json(F.slice("told", F.lit(1), F.col("depth"))).alias("replacements_json"),
    )
