"""Name index over a taxonomy and its scan over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Longest name in tokens, shortest Latin and Chinese name in characters, most owners of a name.
MAX_TOKENS, MIN_LATIN, MIN_CJK, MAX_OWNERS = 8, 4, 2, 3
#: Owners up to which a shared name goes to the most general of them.
RESOLVE_OWNERS = 8

# Names too general to mean a concept.
BLACKLIST = (
    "acid", "acids", "base", "bases", "salt", "salts", "water", "ion", "ions", "gas", "oil", "oils", "metal", "metals", "group", "groups", "compound", "compounds", "element", "elements",
    "molecule", "molecules", "mixture", "solution", "solvent", "polymer", "polymers", "ester", "esters", "amine", "amines", "alcohol", "alcohols", "sugar", "sugars", "dye", "dyes", "fuel",
    "agent", "agents", "drug", "drugs", "food", "light", "heat", "carbon", "agua", "sel", "eau", "wasser", "salz", "saeure", "acide", "acido", "acida",
)


#: Characters that compatibility forms leave alone and whose case folding is ``fold``: only texts with others go
#: through Python. (Ranges: ASCII, Latin letters without ligatures, letters of Greek but sigma, Cyrillic, dashes and
#: quotation marks, Chinese marks and characters.)
PLAIN = "\x00-\x7f¡-§©«¬®°±¶·»¿-ĲĴ-ĿŁ-ňŊ-žΑ-ΡΤ-Ωα-ρσ-ωА-џ‐‒-–—―‘-‟†-•‰、-〃〈-】〔-〛㐀-䶵一-龥".replace("Ĳ", "ı").replace("Ŀ", "ľ")


def fold(c: Column) -> Column:
    """Lower case with ß as ss: full case folding of plain characters, as a JVM expression."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def folded(c: Column) -> Column:
    """Compatibility form and full case folding; only texts that hold a character outside ``PLAIN`` leave the JVM."""
    return F.coalesce(T.nfkc_fold(F.when(c.rlike(f"[^{PLAIN}]"), c)), fold(c))


def normalized(c: Column) -> Column:
    """Tokens of a text in folded form."""
    return T.name_tokens(folded(c))


def name_index(names: DataFrame, closure: DataFrame | None = None, min_latin: int = MIN_LATIN, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(norm, cjk, n_tokens, concept, langs) from (concept, lang, surface, primary).

    In this order: empty and overlong names are dropped; then names that are the primary name of
    another concept; then short, blacklisted and all-digit ones; a name with 2 to 8 owners loses those
    that descend from another owner; what still has too many owners is dropped.
    """
    toks = names.select("concept", "lang", "surface", "primary", normalized(F.col("surface")).alias("tokens"))
    toks = toks.select("*", F.array_join("tokens", " ").alias("norm"), F.size("tokens").alias("n_tokens"), T.has_cjk(F.col("surface")).alias("cjk")).where((F.col("norm") != "") & (F.col("n_tokens") <= MAX_TOKENS))
    owned = toks.where("primary").select("norm", F.col("concept").alias("owner")).distinct()
    taken = toks.where("not primary").join(owned, "norm").where("owner != concept").select("norm", "concept").distinct()
    own = owned.select("norm", F.col("owner").alias("concept")).distinct()
    kept = toks.join(taken.join(own, ["norm", "concept"], "left_anti"), ["norm", "concept"], "left_anti")
    latin = (F.length("norm") >= min_latin) & ~F.col("norm").isin(*BLACKLIST) & ~F.col("norm").rlike("^[0-9]+$")
    kept = kept.where(F.when(F.col("cjk"), F.length(F.replace("norm", F.lit(" "), F.lit(""))) >= MIN_CJK).otherwise(latin))
    index = kept.groupBy("norm", "cjk", "n_tokens", "concept").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    if closure is not None:
        owners = index.groupBy("norm").agg(F.count("*").alias("n"))
        shared = index.join(owners, "norm").where(F.col("n").between(2, RESOLVE_OWNERS)).select("norm", "concept")
        up = closure.where("depth > 0").select(F.col("node").alias("concept"), "ancestor")
        below = shared.join(up, "concept").join(shared.select("norm", F.col("concept").alias("ancestor")), ["norm", "ancestor"]).select("norm", "concept").distinct()
        index = index.join(below, ["norm", "concept"], "left_anti")
    few = index.groupBy("norm").agg(F.count("*").alias("n")).where(F.col("n") <= max_owners).select("norm")
    return index.join(few, "norm", "left_semi")


def prune(index: DataFrame, names: DataFrame) -> DataFrame:
    """Index without the given names."""
    return index.join(names.select("norm").distinct(), "norm", "left_anti")


#: A table of names up to this size goes to every task; a larger one is joined, its hot first tokens salted.
BROADCAST_BYTES, SALTS = 64 << 20, 8


def spread(names: DataFrame, key: str, n: Column) -> tuple[DataFrame, Column, int]:
    """``names`` with a column ``salt``, the salt that a document row must carry, and the largest ``n``.

    Their size is measured: a small table is broadcast whole (one salt); of a larger one each name comes
    once per salt and rows of documents are dealt over the salts, so that no first token is one key.
    """
    total, most = names.agg(F.sum(F.length(key) * 4 + 64), F.max(n)).first()
    if (total or 0) <= BROADCAST_BYTES:
        return F.broadcast(names.withColumn("salt", F.lit(0))), F.lit(0), most or 1
    return names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.pmod(F.hash("rest"), F.lit(SALTS)), most or 1


def windows(items: str, n: int, joint: str = "", around: bool = False) -> Column:
    """Rows (token, rest) of an array: each item, and it with the next ones, ``n`` in all, joined.

    ``around`` adds the item before it and its place (before, at). Only this much of a text is copied per item,
    so the work is linear in the text.
    """

    def row(x: Column, i: Column) -> Column:
        more = (F.when(i > 0, F.get(items, i - 1)).otherwise("").alias("before"), i.alias("at")) if around else ()
        return F.struct(x.alias("token"), F.array_join(F.slice(items, i + 1, n), joint).alias("rest"), *more)

    return F.inline(F.transform(items, row))


def characters(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def scan(docs: DataFrame, index: DataFrame, doc: str = "id", text: str = "text") -> DataFrame:
    """(doc, concept, norm, n_tokens, cjk): names of the index that a document holds; null texts hold none.

    Latin names: each token joins the names that start with it, and the next tokens are compared, so one
    row per token is made, not one per n-gram. Chinese names have no token borders: they join the
    documents' characters on their first one, and the next characters are compared.
    """
    latin = index.where("not cjk").select("norm", "concept", "n_tokens", F.substring_index("norm", " ", 1).alias("token"))
    names, salt, most = spread(latin, "norm", F.col("n_tokens"))
    toks = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), normalized(F.col(text)).alias("tokens"))
    each = toks.select("doc", windows("tokens", most, " ")).withColumn("salt", salt)
    hits = each.join(names, ["token", "salt"]).where(F.startswith(F.concat("rest", F.lit(" ")), F.concat("norm", F.lit(" "))))
    out = hits.select("doc", "concept", "norm", "n_tokens", F.lit(False).alias("cjk")).distinct()
    han = index.where("cjk").select("norm", "concept", "n_tokens", F.replace("norm", F.lit(" "), F.lit("")).alias("dense")).withColumn("token", F.substring("dense", 1, 1))
    names, salt, most = spread(han, "norm", F.length("dense"))
    dense = docs.where(T.has_cjk(F.col(text))).select(F.col(doc).alias("doc"), characters(F.array_join(normalized(F.col(text)), "")).alias("cs"))
    each = dense.select("doc", windows("cs", most)).withColumn("salt", salt)
    found = each.join(names, ["token", "salt"]).where(F.startswith("rest", "dense")).select("doc", "concept", "norm", "n_tokens", F.lit(True).alias("cjk")).distinct()
    return out.unionByName(found)


#: A run of word characters, or of others.
_RUN = r"(?U)(\w+|\W+)"


def lowered(c: Column) -> Column:
    return F.translate(F.lower(c), "ς", "σ")


def term_hits(docs: DataFrame, terms: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keep..., columns of terms): documents with the terms (column ``term``) that they hold at word borders, distinct.

    Letter case is ignored; Chinese terms match anywhere, as they are; terms without a word character are not
    looked for. A text is cut into runs of word and other characters; each word joins the terms whose first
    word it is, and what stands before and after is compared.
    """
    others = [c for c in terms.columns if c != "term"]
    t = terms.where(F.trim("term") != "").distinct().withColumn("low", lowered(F.col("term"))).withColumn("cjk", T.has_cjk(F.col("term")))
    latin = t.where(~F.col("cjk") & F.col("low").rlike(r"(?U)\w")).select(
        *others, "term", "low", F.regexp_extract("low", r"(?U)^\W+", 0).alias("lead"), F.regexp_extract("low", r"(?U)\w+", 0).alias("token"), F.size(F.regexp_extract_all("low", F.lit(_RUN), F.lit(1))).alias("n")
    )
    latin = latin.withColumn("body", F.substr("low", F.length("lead") + 1))
    names, salt, most = spread(latin, "term", F.col("n"))
    runs = docs.where(F.col(text).isNotNull()).select(*keep, F.regexp_extract_all(lowered(F.col(text)), F.lit(_RUN), F.lit(1)).alias("runs"))
    each = runs.select(*keep, windows("runs", most + 1, around=True)).withColumn("salt", salt)
    near = each.join(names, ["token", "salt"]).where(F.startswith("rest", "body"))
    ends = ~F.coalesce(F.substr("rest", F.length("body") + 1, F.lit(1)).rlike(r"(?U)\w"), F.lit(False))
    begins = (F.col("lead") == "") | (F.endswith("before", "lead") & ((F.length("before") > F.length("lead")) | (F.col("at") == 1)))
    out = near.where(ends & begins).select(*keep, *others, "term").distinct()
    han = t.where("cjk").select(*others, "term", F.substring("term", 1, 1).alias("token"))
    names, salt, most = spread(han, "term", F.length("term"))
    chars = docs.where(T.has_cjk(F.col(text))).select(*keep, characters(F.col(text)).alias("cs"))
    each = chars.select(*keep, windows("cs", most)).withColumn("salt", salt)
    found = each.join(names, ["token", "salt"]).where(F.startswith("rest", "term")).select(*keep, *others, "term").distinct()
    return out.unionByName(found)


def best_match(hits: DataFrame) -> DataFrame:
    """(doc, concept, norm): per document and concept the Chinese, else the longest, else the last name in order."""
    w = Window.partitionBy("doc", "concept").orderBy(F.desc("cjk"), F.desc("n_tokens"), F.desc("norm"))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc", "concept", "norm")


def name_document_frequency(hits: DataFrame) -> DataFrame:
    """(norm, n_docs): documents that hold a name."""
    return hits.select("norm", "doc").distinct().groupBy("norm").agg(F.count("*").alias("n_docs"))


def stop_names(frequency: DataFrame, n_docs: int, ratio: float) -> DataFrame:
    """Names in more than ``ratio`` of the documents."""
    return frequency.where(F.col("n_docs") > ratio * n_docs).select("norm")


def pick_language(langs: Column, doc_language: Column) -> Column:
    """Language of a match: the document's, else the ontology's when it is the only one, else the first other."""
    others = F.sort_array(F.array_remove(langs, "chebi"))
    return F.when(F.array_contains(langs, doc_language), doc_language).when(F.size(others) == 0, F.lit("chebi")).otherwise(others[0])
