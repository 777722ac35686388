"""Column functions over text: cleaning, counting, cutting, codes, identifiers and names.

Everything here is a JVM expression, but for the forms that Spark has no function for
(compatibility normalization, full case folding, HTML entities), which are Arrow-batched.
Character classes are Unicode-aware throughout.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"

# Limits of the corpus (words and characters).
MIN_ABSTRACT_WORDS, MIN_ABSTRACT_CHARS = 50, 300
MIN_CLAIM_WORDS = 10
MAX_CLAIM_CHARS, MAX_DESCRIPTION_CHARS, MAX_XML_CLAIM_CHARS = 1500, 1500, 2000

# Classification prefixes of chemistry.
CHEMISTRY_PREFIXES = ("C", "A01N", "A23L", "A61K", "A61P", "B01D", "B01F", "B01J", "B01L", "C25", "G01N", "H01M")
# Words of chemistry looked for in titles (lower case).
CHEMISTRY_KEYWORDS = (
    "adhesive", "antibody", "battery", "biomarker", "catalyst", "cell culture", "chemical", "chemistry", "coating", "composition", "compound", "crystal form",
    "detergent", "drug", "electrolyte", "excipient", "fermentation", "formulation", "inhibitor", "material", "molecule", "nanoparticle", "peptide", "pharmaceutical",
    "pharmaceutically", "polymer", "protein", "resin", "semiconductor composition", "slurry", "solvent", "surfactant", "synthesis", "therapeutic",
)


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and white-space values."""
    return F.when(F.trim(c) != "", c)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def escape_markup(c: Column) -> Column:
    """A text as it stands in mark-up and in quoted attributes; '' for null."""
    t = F.coalesce(c, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(mark), F.lit(entity))
    return t


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """HTML entities to characters; null stays null."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalization; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_fold(s: pd.Series) -> pd.Series:
    """Compatibility normalization and full case folding; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Letters without their accents, anything else outside ASCII dropped; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def clean_text(c: Column) -> Column:
    """Entities resolved and white space collapsed; '' for null."""
    return F.coalesce(collapse(unescape_html(c)), F.lit(""))


def clean_markup_text(c: Column) -> Column:
    """Cleaning for text from mark-up: one character form, no control or invisible characters, tidy marks."""
    t = unescape_html(nfkc(c))
    t = F.regexp_replace(t, "[­﻿​]", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    t = collapse(t)
    t = F.regexp_replace(t, r"([(\[{]) +", "$1")
    t = F.regexp_replace(t, r" +([)\]},.;:!?])", "$1")
    return F.coalesce(F.trim(F.regexp_replace(t, r" */ *", "/")), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, SPACE), lambda w: w != "")), F.lit(0))


def min_abstract_chars(min_words: int) -> int:
    """Cheap character gate that goes with a word gate."""
    return max(MIN_ABSTRACT_CHARS, 5 * min_words)


def truncate_words(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut back to the last blank when something was cut."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) <= n, c).otherwise(F.rtrim(F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)))


def strip_claim_number(c: Column) -> Column:
    """A claim without its leading number."""
    return F.trim(F.regexp_replace(c, r"^\s*1\s*[.):\-]*\s*", ""))


def first_claim_of_text(c: Column) -> Column:
    """First claim of a claim list in plain text: up to the second number."""
    return strip_claim_number(F.split(collapse(c), r" 2\s*[.)] ").getItem(0))


def first_claim_of_html(c: Column) -> Column:
    """First claim element, without drawings of molecules and tags; '' where there is none."""
    body = F.regexp_extract(c, r"(?is)<claim\b[^>]*>(.*?)</claim>", 1)
    body = F.regexp_replace(body, r"(?is)<chemistry\b.*?</chemistry>", " ")
    return strip_claim_number(collapse(F.regexp_replace(body, r"<[^>]+>", " ")))


def first_claim(claim_html: Column, claim_text: Column, n: int = MAX_CLAIM_CHARS) -> Column:
    """The claim from HTML, else from text, cut to ``n`` characters; '' for neither."""
    got = F.coalesce(F.nullif(first_claim_of_html(claim_html), F.lit("")), F.nullif(first_claim_of_text(claim_text), F.lit("")), F.lit(""))
    return truncate_words(got, n)


def description_snippet(c: Column, n: int = MAX_DESCRIPTION_CHARS) -> Column:
    """Description without paragraph marks like [0001], collapsed and cut."""
    return truncate_words(collapse(F.regexp_replace(c, r"\[\d{3,5}\]", " ")), n)


def normalize_code(c: Column) -> Column:
    """The classification code within a text, blanks collapsed; '' where there is none."""
    return collapse(F.regexp_extract(F.upper(c), r"([A-HY]\d{2}[A-Z]?\s*\d+(?:/\d+)?)", 1))


def code_prefix(c: Column) -> Column:
    """A code in upper case without blanks, for prefix tests."""
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def code_list(ipc_codes: Column) -> Column:
    """The bar-separated codes as an array of distinct non-empty codes in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(ipc_codes, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def chemistry_codes(codes: Column, prefixes: tuple[str, ...] = CHEMISTRY_PREFIXES) -> Column:
    """The codes that start with a prefix of chemistry."""
    return F.filter(codes, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(code_prefix(c), p)))


def keyword_hits(title: Column, keywords: tuple[str, ...] = CHEMISTRY_KEYWORDS) -> Column:
    """Keywords that a title holds as plain substrings."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))


def localized(blocks: Column, language: str) -> Column:
    """First non-blank text of an array of (language, text) in a language, letter case ignored; null if none."""
    hits = F.filter(blocks, lambda b: (F.lower(b["language"]) == language.lower()) & (F.trim(b["text"]) != ""))
    return F.trim(F.try_element_at(hits, F.lit(1))["text"])


def richness(abstract: Column, claim: Column, description: Column) -> Column:
    """Characters of abstract and claim and a quarter of those of the description."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return n(abstract) + n(claim) + F.floor(n(description) / 4).cast("int")


def context(title: Column, abstract: Column, claim: Column) -> Column:
    """Title, abstract and first claim as labelled parts, joined by blank lines; absent parts are left out."""
    part = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n\n", part("Title", title), part("Abstract", abstract), part("First claim", claim))


def substantive(abstract: Column, claim: Column, words: int = MIN_ABSTRACT_WORDS) -> Column:
    """Enough words in the abstract or in the claim."""
    return (word_count(abstract) >= words) | (word_count(claim) >= MIN_CLAIM_WORDS)


def slug(c: Column, default: str = "default") -> Column:
    """Lower case, other characters than letters and digits as '-', ends trimmed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def name_slug(c: Column, n: int = 60) -> Column:
    """Slug of a name with its accents folded, at most ``n`` characters."""
    return F.substring(slug(ascii_fold(c), ""), 1, n)


def infer_language(identifier: Column) -> Column:
    """The last part of an identifier when it looks like a language code, else null."""
    parts = F.filter(F.split(F.replace(F.lower(identifier), F.lit("-"), F.lit("_")), "_"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last.rlike("^[a-z]{2,5}$"), last)


def patent_of(identifier: Column) -> Column:
    """Identifier without its language suffix."""
    return F.regexp_replace(identifier, "_(de|en|es|fr|zh)$", "")


def strip_query_suffix(identifier: Column) -> Column:
    """Query identifier without its language part."""
    return F.regexp_replace(identifier, "__q_[a-z]{2}$", "")


def title_and_text(title: Column, text: Column) -> Column:
    """Title and text joined by a blank, trimmed; null counts as empty."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


# Forms of names that are codes: food additives, refrigerants, CAS numbers, EC numbers, company codes.
CODE_LIKE = (r"^(?i:E)[ \-]?\d{3,4}(?i:[a-z])?$", r"^(?i:R)[ \-]?\d{2,4}(?i:[a-z])?$", r"^\d{1,7}-\d{2}-\d$", r"^\d{3}-\d{3}-\d$", r"^[A-Z]{2,5}[ \-]?\d{2,6}(-\d{1,5})?[a-z]?$")


def is_code_like(c: Column) -> Column:
    """Whether a name is a code rather than a word."""
    out = F.lit(False)
    for p in CODE_LIKE:
        out = out | F.trim(c).rlike(p)
    return out


def name_tokens(folded: Column) -> Column:
    """Tokens of a folded text: split at white space, outer marks stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(folded, SPACE), lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", "")), lambda w: w != "")


def has_cjk(c: Column) -> Column:
    """Whether a text holds Chinese characters."""
    return c.rlike("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def contains_name(text_tokens: Column, name_tokens_: Column, cjk: Column, most: int = 8) -> Column:
    """Whether a name's tokens occur in a row in a text; Chinese names match as substrings; long names never."""
    joined = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    dense = lambda t: F.array_join(t, "")
    n = F.size(name_tokens_)
    return (n > 0) & (n <= most) & F.when(cjk, F.contains(dense(text_tokens), dense(name_tokens_))).otherwise(F.contains(joined(text_tokens), joined(name_tokens_)))


def clean_name(c: Column) -> Column:
    """Name without a trailing part in brackets; unchanged where nothing would be left."""
    cut = F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))
    return F.coalesce(F.nullif(cut, F.lit("")), c)


def distinctive(c: Column) -> Column:
    """Long names and names with a digit, hyphen or blank."""
    return (F.length(c) >= 8) | c.rlike(r"[\d\- ]")


def term_pattern(term: Column) -> Column:
    """Regular expression of a term at word borders, letter case ignored; Chinese terms match anywhere."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # the literal comes first, so that the borders are only looked at where it matches
    return F.when(has_cjk(term), quoted).otherwise(F.concat(F.lit("(?iU)"), quoted, F.lit(r"(?!\w)(?<!\w"), quoted, F.lit(")")))


def clean_swap(original: Column, replacement: Column) -> Column:
    """Replacement is there, differs and doesn't hold the original as a word of its own, letter case ignored."""
    a, b = F.trim(original), F.trim(replacement)
    return F.coalesce((b != "") & (a != "") & (F.lower(a) != F.lower(b)) & ~F.regexp_like(b, term_pattern(a)), F.lit(False))


def replace_term(text: Column, term: Column, replacement: Column) -> Column:
    """Every occurrence of a term replaced, literally; null text stays null."""
    literal = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, term_pattern(term), literal)


def obo_unescape(c: Column) -> Column:
    """Quotes and backslashes of an ontology file without their escapes."""
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def json_body(c: Column) -> Column:
    """A response without the code fence around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def collision_id(base: Column, number: Column) -> Column:
    """Identifier with a suffix from the second use of its base on."""
    return F.when(number == 1, base).otherwise(F.concat(base, F.lit("_"), number.cast("string")))
