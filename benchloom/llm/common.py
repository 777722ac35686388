"""Shared pieces of the training-data operators: scans, sampling, checkpoints, sentence ends."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Publication number that stands for a lost number; its rows share nothing else.
LOST_PUBLICATIONS = ("EP-0000000-A0",)

#: A sentence ends after . ! ? before white space or the end, and after the full-width marks.
SENTENCE_END = re.compile(r"[.!?](?=\s|$)|[。！？]")

_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan of one table, pruned to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``; only where the session has none (tests, one
    machine) a folder of its own is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="benchloom-ckpt-")))
    return df.checkpoint(eager=True)


def bounded_sample(df: DataFrame, key: str, bound: int, strata: str | None = None, seed: int = 42) -> list[Row]:
    """At most ``bound`` rows (of each value of ``strata``), the same for any partitioning.

    The rows with the smallest seeded hashes of ``key``: a count gives the hash below which hardly
    more than ``bound`` rows lie, so only about so many leave their tasks, however many tasks there
    are. Of a key that comes several times one row is taken, before anything is shuffled, so a
    key that holds a third of all rows is one row, too. Rows with a null key or stratum are left out.
    Only models are fitted on it, never counts of the corpus.
    """
    df = df.where(F.col(key).isNotNull())
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    wanted = bound + 4 * bound**0.5 + 8
    if strata is None:
        n = df.count()
        rows = df.where(share < wanted / n if n > wanted else F.lit(True))
    else:
        counts = {r[0]: r[1] for r in df.where(F.col(strata).isNotNull()).groupBy(strata).count().collect()}
        if not counts:
            return []
        limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, wanted / n)])
        rows = df.where(share < F.try_element_at(limit, F.col(strata)))
    one = rows.groupBy(F.col(key).alias("_key"), share.alias("_share")).agg(F.min(F.struct(*df.columns)).alias("_row"))
    got = sorted(one.select("_row.*", "_share").collect(), key=lambda r: (r["_share"], str(r[key]), str(r)))
    taken: dict = {}
    out = []
    for r in got:
        group = r[strata] if strata else None
        if taken.setdefault(group, 0) < bound:
            taken[group] += 1
            out.append(r)
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, numbered as they come; blank tails are none."""
    spans, start = [], 0
    for m in SENTENCE_END.finditer(text):
        if text[start : m.end()].strip():
            spans.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        spans.append((start, len(text)))
    return spans
