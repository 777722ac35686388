"""Spelling changes of a term as column expressions.

A change is a rule over the characters of the term; which rule applies and where comes from hashes of
the seed, so a term and a seed always give the same spelling, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Greek letters and their names, oxidation states and charges.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda",
    "μ": "mu", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
OXIDATION = {"(I)": "(1+)", "(II)": "(2+)", "(III)": "(3+)", "(IV)": "(4+)", "(V)": "(5+)", "(VI)": "(6+)", "(VII)": "(7+)"}

#: Both directions of each table, and the patterns of what they replace.
SPELLINGS = GREEK | {v: k for k, v in GREEK.items()}
CHARGES = OXIDATION | {v: k for k, v in OXIDATION.items()}
GREEK_PATTERN = "(?i)[" + "".join(GREEK) + "]|" + "|".join(sorted(GREEK.values(), key=lambda n: (-len(n), n)))
CHARGE_PATTERN = r"\((?:VII|VI|IV|V|III|II|I|[1-7]\+)\)"


def draw(seed: Column, *tags: Column | str) -> Column:
    """Hexadecimal hash of a seed and tags, the order of all random picks."""
    return F.md5(F.concat_ws("|", seed, *[F.lit(t) if isinstance(t, str) else t for t in tags]).cast("binary"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(array: Column, seed: Column, tag: str) -> Column:
    """An element of an array by hash; null for an empty one."""
    n = F.conv(F.substring(draw(seed, tag), 1, 7), 16, 10).cast("int")
    return F.try_element_at(array, F.when(F.size(array) > 0, n % F.size(array) + 1))


def spliced(term: Column, at: Column, n: Column, middle: Column) -> Column:
    """A term with the ``n`` characters from a place on replaced."""
    return F.concat(F.substr(term, F.lit(1), at - 1), middle, F.substr(term, at + n))


def exchanged(term: Column, pattern: str, table: dict[str, str]) -> Column:
    """The first match of a pattern by what a table gives for it."""
    found = F.nullif(F.regexp_extract(term, pattern, 0), F.lit(""))
    other = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(found) if table is SPELLINGS else found)
    return spliced(term, F.position(found, term), F.length(found), other)


class Term:
    """A term with its characters, the places of its letters (from 1), and of letters that another letter follows."""

    def __init__(self, text: Column, characters: Column, letters: Column, pairs: Column) -> None:
        self.text, self.characters, self.letters, self.pairs = text, characters, letters, pairs

    def at(self, i: Column) -> Column:
        return F.try_element_at(self.characters, i)


def hyphenated(t: Term, seed: Column) -> Column:
    return spliced(t.text, pick(t.pairs, seed, "hyphen") + 1, F.lit(0), F.lit("-"))


def mistyped(t: Term, seed: Column) -> Column:
    """Two letters swapped, one left out or one doubled; null for terms with fewer than two letters."""
    one, two = pick(t.letters, seed, "letter"), pick(t.pairs, seed, "pair")
    how = pick(F.array(F.lit("swap"), F.lit("drop"), F.lit("double")), seed, "typo")
    swapped = let(two, lambda i: spliced(t.text, i, F.lit(2), F.concat(t.at(i + 1), t.at(i))))
    out = F.when(how == "swap", swapped).when(how == "drop", spliced(t.text, one, F.lit(1), F.lit(""))).otherwise(let(one, lambda i: spliced(t.text, i, F.lit(0), t.at(i))))
    return F.when(F.size(t.letters) >= 2, out)


def recased(t: Term, seed: Column) -> Column:
    """A third of the letters, at least one, in the other case."""
    drawn = F.sort_array(F.transform(t.letters, lambda i: F.struct(draw(seed, i.cast("string")).alias("h"), i.alias("i"))))
    turned = F.transform(F.slice(drawn, 1, F.greatest(F.lit(1), F.floor(F.size(t.letters) / 3).cast("int"))), lambda s: s["i"])
    other = lambda c: F.when(c == "ß", c).when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))
    return let(turned, lambda places: F.array_join(F.transform(t.characters, lambda c, i: F.when(F.array_contains(places, i + 1), other(c)).otherwise(c)), ""))


Rule = Callable[[Term, Column], Column]
RULES: dict[str, Rule] = {
    "greek": lambda t, seed: exchanged(t.text, GREEK_PATTERN, SPELLINGS),
    "oxidation": lambda t, seed: exchanged(t.text, CHARGE_PATTERN, CHARGES),
    "hyphen": hyphenated,
    "typo": mistyped,
    "case": recased,
}


def perturbed(term: Column, seed: Column) -> Column:
    """The term changed by the first rule, in the order drawn for the seed, that changes it.

    Null for null and empty terms and for those that no rule changes (no letters, no charge).
    """

    def changed(t: Term) -> Column:
        made = F.array(*[F.struct(draw(seed, name).alias("at"), rule(t, seed).alias("out")) for name, rule in RULES.items()])
        return F.try_element_at(F.sort_array(F.filter(made, lambda r: (r["out"] != term) & (term != ""))), F.lit(1))["out"]

    places = lambda cs: F.filter(F.sequence(F.lit(1), F.greatest(F.size(cs), F.lit(1))), lambda i: F.try_element_at(cs, i).rlike(r"^\p{L}$"))
    pairs = lambda at: F.filter(at, lambda i: F.array_contains(at, i + 1))
    characters = F.filter(F.split(term, ""), lambda c: c != "")
    return let(characters, lambda cs: let(places(cs), lambda at: let(pairs(at), lambda two: changed(Term(term, cs, at, two)))))


def perturbed_sql(source: str, term: str, seed: str, out: str = "spelled") -> str:
    """SQL of the same: common table expressions over ``source`` that end in ``<source>_spelled``, with the column ``out``."""
    h = lambda *tags: "md5(concat_ws('|', " + ", ".join([seed, *tags]) + "))"
    choose = lambda a, tag: f"{a}[CAST('0x' || substr({h(repr(tag))}, 1, 7) AS BIGINT) % nullif(len({a}), 0) + 1]"
    table = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
    cut = lambda at, n, mid: f"substr({term}, 1, {at} - 1) || {mid} || substr({term}, {at} + {n})"
    swap = lambda p, d, low: f"(CASE WHEN regexp_matches({term}, '{p}') THEN {cut(f'strpos({term}, {f0(p)})', f'length({f0(p)})', f'{table(d)}[{low(f0(p))}]')} END)"
    f0 = lambda p: f"regexp_extract({term}, '{p}', 0)"
    rules = {
        "greek": swap(GREEK_PATTERN, SPELLINGS, lambda x: f"lower({x})"),
        "oxidation": swap(CHARGE_PATTERN, CHARGES, lambda x: x),
        "hyphen": f"(CASE WHEN len(_p) > 0 THEN {cut('(_a + 1)', '0', repr('-'))} END)",
        "typo": f"(CASE WHEN len(_l) < 2 THEN NULL WHEN _how = 'swap' THEN {cut('_b', '2', '_c[_b + 1] || _c[_b]')} WHEN _how = 'drop' THEN {cut('_o', '1', repr(''))} ELSE {cut('_o', '0', '_c[_o]')} END)",
        "case": "array_to_string(list_transform(_c, lambda c, i: CASE WHEN NOT list_contains(_t, i) OR c = 'ß' THEN c WHEN c = lower(c) THEN upper(c) ELSE lower(c) END), '')",
    }
    made = ", ".join(f"{{'at': {h(repr(name))}, 'out': {sql}}}" for name, sql in rules.items())
    s = source
    return rf"""{s}_1 AS (SELECT *, regexp_extract_all({term}, '(?s).') AS _c FROM {s}),
{s}_2 AS (SELECT *, list_filter(range(1, len(_c) + 1), lambda i: regexp_matches(_c[i], '^\p{{L}}$')) AS _l FROM {s}_1),
{s}_3 AS (SELECT *, list_filter(_l, lambda i: list_contains(_l, i + 1)) AS _p FROM {s}_2),
{s}_4 AS (SELECT *, {choose('_p', 'hyphen')} AS _a, {choose('_p', 'pair')} AS _b, {choose('_l', 'letter')} AS _o, {choose("['swap', 'drop', 'double']", 'typo')} AS _how,
  list_transform(list_sort(list_transform(_l, lambda i: {{'h': {h('CAST(i AS VARCHAR)')}, 'i': i}}))[1:greatest(1, len(_l) // 3)], lambda x: x.i) AS _t FROM {s}_3),
{s}_spelled AS (SELECT * EXCLUDE (_c, _l, _p, _a, _b, _o, _how, _t), list_sort(list_filter([{made}], lambda r: r.out != {term} AND {term} != ''))[1].out AS {out} FROM {s}_4)"""
