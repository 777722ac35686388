"""Problem 2: text cut off by field limits.

Method: the lengths of unfinished values are recomputed under several encodings and grouped by
source and field; lengths at which they pile up are hidden storage limits. Then the endings are
inspected: broken escapes, marks of omission, open brackets, parts of words, and n-grams after
which no sentence ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .endings import OPEN, OPEN_NAMES, Grams, decided, open_rows, verdict, vocabulary

FIELDS = ("description", "first_claim")
#: A hidden limit holds at least so many unfinished values, and such a share of the source's.
LEAST_COUNT, LEAST_SHARE = 6, 0.03
#: ... and this many times as many as lengths nearby lead to expect.
LEAST_EXCESS = 6.0
#: Lengths below a limit that a cut back to the last word, or at a whole character, can have.
WORD_SLACK, CHARACTER_SLACK = 15, 3
#: A value without a final stop counts as whole when at least such a share of the n-grams at its end are
#: ends: elsewhere, below a limit that cuts back to a word, and at an exact limit (never).
WHOLE_FROM = (0.25, 0.9, 2.0)


def source_name(source: Column) -> Column:
    """Trimmed, lower-cased source; '' for null."""
    return F.coalesce(F.lower(F.trim(source)), F.lit(""))


def encoded_lengths(text: Column) -> dict[str, Column]:
    """Length of a text under the encodings in which a store may count."""
    n = F.length(text)
    count = lambda chars: n - F.length(F.translate(text, chars, ""))
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return {
        "characters": n,
        "utf8_bytes": F.octet_length(text),
        "utf16_units": n + astral,
        "html_escaped": n + 4 * count("&") + 3 * count("<>") + 5 * count('"') + 4 * count("'"),
        "json_escaped": n + 5 * wide + count('"\\\n\r\t'),
        "crlf_newlines": n + count("\n"),
    }


def values(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, source, field, text, around): one row per value with text; ``around`` are the row's other texts."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("v")
    return (
        corpus.where(F.col("id").isNotNull())
        .select("id", source_name(F.col("source")).alias("source"), "title", *fields, each)
        .where(F.trim("v.text") != "")
        .select("id", "source", "v.field", "v.text", F.concat_ws(" ", "title", *fields).alias("around"))
    )


def unfinished(text: Column) -> Column:
    """Values whose end must be looked at: without a final stop, or with one that may deceive."""
    tail = F.substring(text, -24, 24)
    return ~tail.rlike(r"[.!?。！？][\"”»“’)）\]]*\s*\z") | tail.rlike(r"(?:\.\.|…|\d\.|[.\s(][^\W\d_]{1,7}\.)[\s\]]*\z")


def limits(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source, field, encoding, limit, n_values, exact): lengths at which unfinished values pile up.

    ``exact`` limits cut at the length itself, others back to the last word. A pile may show under several
    encodings; the highest exact one, else the highest, explains its values, and another pile is given too
    where enough values are in it that no better limit explains, so a source with several stores has the
    limits of each.
    """
    rows = values(corpus, fields).drop("around").where(~F.col("text").rlike(r"[.!?。！？][\"”»“’)）\]]*\s*\z"))
    lengths = F.array(*[F.struct(F.lit(k).alias("encoding"), v.cast("int").alias("length")) for k, v in encoded_lengths(F.col("text")).items()])
    rows = rows.select("source", "field", lengths.alias("lengths"))
    histogram = rows.select("source", "field", F.explode("lengths").alias("e")).groupBy("source", "field", "e.encoding", "e.length").agg(F.count("*").alias("n"))
    group = Window.partitionBy("source", "field", "encoding")
    by = group.orderBy("length")
    span = lambda a, b: F.coalesce(F.sum("n").over(by.rangeBetween(a, b)), F.lit(0))
    piles = (
        histogram.withColumn("total", F.sum("n").over(group))
        .withColumn("at", span(-1, 0))
        .withColumn("slack", span(-WORD_SLACK, 0))
        .withColumn("near", (span(-WORD_SLACK - 48, -WORD_SLACK - 1) + span(1, 48)) / F.lit(96.0))
    )
    exact = (F.col("at") >= 0.6 * F.col("slack")) & (F.col("at") >= LEAST_EXCESS * (2 * F.col("near") + 0.5))
    soft = (F.col("encoding") == "characters") & (F.col("slack") >= LEAST_EXCESS * ((WORD_SLACK + 1) * F.col("near") + 0.5))
    wanted = F.greatest(F.lit(LEAST_COUNT), LEAST_SHARE * F.col("total"))
    found = (
        piles.withColumn("exact", exact)
        .where((exact & (F.col("at") >= wanted)) | (soft & (F.col("slack") >= 2 * wanted)))
        .withColumn("n_values", F.when(F.col("exact"), F.col("at")).otherwise(F.col("slack")))
        .withColumn("wanted", F.when(F.col("exact"), wanted).otherwise(2 * wanted))
    )
    close = Window.partitionBy("source", "field", "encoding").orderBy("length").rangeBetween(-WORD_SLACK, WORD_SLACK)
    peak = found.withColumn("top", F.max("n_values").over(close)).where("n_values = top")
    # a store counts in one encoding: the one with the highest exact pile, else the highest of all, goes first
    rank = [F.desc("exact"), F.desc("n_values"), F.when(F.col("encoding") == "characters", 0).otherwise(1), "encoding", "length"]
    first = Window.partitionBy("source", "field").orderBy(*rank)
    peak = peak.withColumn("own", F.col("encoding") == F.first("encoding").over(first)).withColumn("place", F.row_number().over(Window.partitionBy("source", "field").orderBy(F.desc("own"), *rank)))
    peak = cut_lineage(peak.select("source", "field", "encoding", F.col("length").alias("limit"), "n_values", "exact", "own", "place", "wanted"))
    # each value goes to the first limit that explains it; what another limit explains beyond that must make a pile of its own
    held = F.exists("lengths", lambda e: (e["encoding"] == F.col("encoding")) & e["length"].between(F.col("limit") - low_slack(), F.col("limit")))
    told = rows.join(few(peak.select("source", "field", "encoding", "limit", "exact", "place")), ["source", "field"]).withColumn("_held", held).where("_held")
    each = told.withColumn("_v", F.xxhash64("lengths")).groupBy("source", "field", "_v").agg(F.min("place").alias("place"), F.count("*").alias("_n"), F.countDistinct("place").alias("_p"))
    rest = each.groupBy("source", "field", "place").agg(F.sum((F.col("_n") / F.col("_p")).cast("bigint")).alias("left"))
    kept = peak.join(rest, ["source", "field", "place"], "left").where(F.col("own") | ((F.coalesce("left", F.lit(0)) >= F.col("wanted")) & (F.col("left") >= 0.5 * F.col("n_values"))))
    return kept.select("source", "field", "encoding", "limit", "n_values", "exact")


#: Rows up to which a table of limits is broadcast: sources x fields x piles, a few hundred; beyond it is joined.
FEW_LIMITS = 100_000


def few(found: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast after a count of its rows."""
    return F.broadcast(found) if found.count() <= FEW_LIMITS else found


def low_slack() -> Column:
    """Lengths below a limit at which its cuts can lie."""
    return F.when(F.col("exact"), F.when(F.col("encoding") == "utf8_bytes", CHARACTER_SLACK).otherwise(1)).otherwise(WORD_SLACK)


def met_limit(x: Column) -> Column:
    """Whether a value's ``lengths`` meet a limit: 2 an exact one, 1 another, 0 not."""
    slack = F.when(x["exact"], F.when(x["encoding"] == "utf8_bytes", CHARACTER_SLACK).otherwise(1)).otherwise(WORD_SLACK)
    length = F.try_element_at("lengths", x["encoding"])
    return F.when(F.coalesce(length.between(x["limit"] - slack, x["limit"]), F.lit(False)), F.when(x["exact"], 2).otherwise(1)).otherwise(0)


def truncated(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field) of the values that were cut; null and blank values are none, an id delivered twice counts once."""
    each = values(corpus, fields)
    texts = cut_lineage(each.select("text").distinct())
    known = vocabulary(texts)
    rows = each.where(unfinished(F.col("text")))
    found = cut_lineage(limits(corpus, fields)).select(F.col("source").alias("s"), F.col("field").alias("f"), "encoding", "limit", "exact")
    lengths = F.create_map(*[x for k, v in encoded_lengths(F.col("text")).items() for x in (F.lit(k), v)])
    at = (F.col("source") == F.col("s")) & (F.col("field") == F.col("f"))
    # the texts stay where they are read; of several limits that a value meets the strictest counts
    by_key = found.groupBy("s", "f").agg(F.collect_list(F.struct("encoding", "limit", "exact")).alias("limits"))
    marked = (
        rows.join(F.broadcast(cut_lineage(by_key)) if found.count() <= FEW_LIMITS else by_key, at, "left")
        .withColumn("lengths", lengths)
        .withColumn("hit", F.coalesce(F.array_max(F.transform("limits", met_limit)), F.lit(0)))
        .select("id", "field", "text", "around", "hit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Grams(known)
        for b in batches:
            got = [(*verdict(known, text, around), WHOLE_FROM[hit]) for text, around, hit in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            keep = [k for k, (x, _, _) in enumerate(got) if x]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)), *open_rows(counter, [got[k] for k in keep])], names=["id", "field", *OPEN_NAMES])

    return decided(texts, known, marked.mapInArrow(run, f"id string, field string, {OPEN}"), ["id", "field"]).distinct()


def rates(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(source, field, n_values, n_cut, share): how often each source cuts its values; each id counts once."""
    each = values(corpus, fields).groupBy("id", "field").agg(F.min("source").alias("source"))
    cut = truncated(corpus, fields).withColumn("cut", F.lit(1))
    return (
        each.join(cut, ["id", "field"], "left")
        .groupBy("source", "field")
        .agg(F.count("*").alias("n_values"), F.coalesce(F.sum("cut"), F.lit(0)).alias("n_cut"))
        .withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )
