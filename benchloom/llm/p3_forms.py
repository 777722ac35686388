"""Problem 3: visually identical text with different characters.

Method: DuckDB runs inside the Arrow partitions. One embedded SQL expression brings a text to its
visible form: look-alike letters and width by ``translate``, invisible characters and the kinds of
space by regular expressions, composition by ``nfc_normalize``. Two texts look the same exactly when
their visible forms are equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import INVISIBLE, LOOKALIKE_FROM, LOOKALIKE_TO
from .common import cut_lineage

FIELDS = ("title", "abstract")

# Signs that look like others.
SIGN_FROM = "‐‑‒−﹣－ꞏ∙⋅‧ǃꓸ։：∶；՛＇ʼ′´｀″ⅼ∣µΩKÅ"
SIGN_TO = "------····!.:::;'''''`\"l|μΩKÅ"
# One character that looks like several, apart from compatibility forms.
SEVERAL = {"℃": "°C", "℉": "°F", "…": "..."}


@cache
def _maps() -> tuple[str, str, dict[str, str]]:
    """From and to of ``translate``, and replacements by several characters.

    Width forms, radicals, compatibility ideographs and ligatures follow from the compatibility
    decompositions of Unicode by rule. Raised and lowered characters, fractions, circled and
    other styled characters differ visibly and stay.
    """
    one: dict[str, str] = {}
    several = {k: v for k, v in SEVERAL.items() if k != v}
    for c in range(0x00A0, 0x30000):
        ch = chr(c)
        d = unicodedata.decomposition(ch)
        tag = d[1 : d.index(">")] if d.startswith("<") else ""
        to = unicodedata.normalize("NFKC", ch)
        radical = 0x2E80 <= c <= 0x2FDF
        if tag in ("wide", "narrow", "noBreak") or radical and tag == "compat" or 0xFB00 <= c <= 0xFB06 or 0x0132 <= c <= 0x0133 or 0x01C7 <= c <= 0x01CC:
            if to != ch and to.strip():
                (one if len(to) == 1 else several)[ch] = to
    looks = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO))
    for c in range(0x0370, 0x0530):  # accented look-alikes
        apart = unicodedata.normalize("NFD", chr(c))
        if len(apart) > 1 and apart[0] in looks:
            to = unicodedata.normalize("NFC", looks[apart[0]] + apart[1:])
            if len(to) == 1:
                one[chr(c)] = to
    one.update(zip(LOOKALIKE_FROM + SIGN_FROM, LOOKALIKE_TO + SIGN_TO))
    one = {a: one.get(b, b) for a, b in one.items() if a not in several}
    return "".join(one), "".join(one.values()), several


#: Every kind of space that shows as a blank.
_SPACE = "[ \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"


def visible_sql(column: str) -> str:
    """SQL expression of the visible form of a column, null for null."""
    source, target, several = _maps()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    invisible = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(set(INVISIBLE))) + "\\x{E0000}-\\x{E007F}]"
    expr = f"regexp_replace({column}, '{invisible}', '', 'g')"
    expr = f"regexp_replace({expr}, '{_SPACE}', ' ', 'g')"
    for a, b in several.items():
        expr = f"replace({expr}, {quote(a)}, {quote(b)})"
    expr = f"translate({expr}, {quote(source)}, {quote(target)})"
    return f"trim(nfc_normalize({expr}))"


def _fast_sql(column: str) -> str:
    """The same, with the long replacements only for texts beyond printable Latin-1."""
    return f"CASE WHEN regexp_matches({column}, '[^\\n\\t -~¡-¬®-³¶-ÿ一-鿿、。]') THEN {visible_sql(column)} ELSE trim({column}) END"


def visible_forms(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``{column}_form`` beside each column; nulls stay null, empty texts stay empty."""
    fields = ", ".join([*[f'"{k}"' for k in keys], *[f'"{c}", {_fast_sql(chr(34) + c + chr(34))} AS "{c}_form"' for c in columns]])
    query = f"SELECT {fields} FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            yield from con.sql(query).to_arrow_table().cast(schema).to_batches()
            con.unregister("batch")
        con.close()

    schema = pa.schema([*[(k, pa.string()) for k in keys], *[x for c in columns for x in ((c, pa.string()), (f"{c}_form", pa.string()))]])
    out = ", ".join([*[f"`{k}` string" for k in keys], *[f"`{c}` string, `{c}_form` string" for c in columns]])
    return rows.select(*keys, *columns).mapInArrow(run, out)


def mixed_forms(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, form, stored): rows whose visible form has at least two different stored texts, both as hashes."""
    forms = visible_forms(corpus.where(F.col("id").isNotNull()), ["id"], list(fields))
    one = forms.select(
        "id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("stored"), F.col(f"{f}_form").alias("form")) for f in fields])).alias("x"),
    ).where("x.form != ''")
    keyed = cut_lineage(
        one.select("id", "x.field", F.md5(F.col("x.form").cast("binary")).alias("form"), F.xxhash64("x.stored").alias("stored")).distinct()
    )
    mixed = keyed.groupBy("field", "form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a != b").select("field", "form")
    return keyed.join(mixed, ["field", "form"], "left_semi")


def classes(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, form, n_ids, n_texts): membership in the classes of values that look the same and aren't all equal, one row per id and field."""
    rows = mixed_forms(corpus, fields)
    size = rows.groupBy("field", "form").agg(F.countDistinct("id").alias("n_ids"), F.countDistinct("stored").alias("n_texts"))
    return rows.select("id", "field", "form").distinct().join(size, ["field", "form"]).select("id", "field", "form", "n_ids", "n_texts")


def same_look(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id_1, id_2, field): ids whose values of a field look the same and aren't equal.

    Rows meet by a 128-bit key of the visible form; only forms with at least two different stored
    texts go on. Pairs are formed between different stored texts and then given their ids, so copies
    of one stored text never meet, however many there are.
    Null and blank values have no partner; an id delivered twice counts once.
    """
    rows = mixed_forms(corpus, fields)
    classes = rows.select("field", "form", "stored").distinct()
    meet = ["field", "form"]
    both = classes.withColumnRenamed("stored", "s1").join(classes.withColumnRenamed("stored", "s2"), meet).where("s1 < s2")
    first = both.join(rows.select(*meet, F.col("stored").alias("s1"), F.col("id").alias("a")), [*meet, "s1"])
    pairs = first.join(rows.select(*meet, F.col("stored").alias("s2"), F.col("id").alias("b")), [*meet, "s2"]).where("a != b")
    return pairs.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), "field").distinct()


def consistent(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, form, changed): each id's fields in their visible form; an id delivered twice counts once."""
    forms = visible_forms(corpus.where(F.col("id").isNotNull()), ["id"], list(fields))
    one = forms.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_form").alias("form"), (~F.col(f).eqNullSafe(F.col(f"{f}_form"))).alias("changed")) for f in fields])).alias("x"))
    return one.select("id", "x.field", "x.form", "x.changed").distinct()
