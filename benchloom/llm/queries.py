"""Queries of the training-data operators, with SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p1_alignment, p2_truncation, p3_forms, p4_pairs, p5_language, p6_budget, p7_encode, p8_pack, p9_repetition
from .common import table

P1_COLUMNS = ("id", "language", "abstract", "publication_number")
P2_COLUMNS = ("id", "source", "title", "description", "first_claim")
P4_COLUMNS = ("query_id", "query_language", "question", "answer")
P5_COLUMNS = ("id", "language", "abstract", "description")
P6_COLUMNS = ("id", "language", "source", "context", "ipc_codes")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = p1_alignment.align(table(spark, sf_dir, "corpus", *P1_COLUMNS))
    return pairs.select("id_1", "sent_1", "id_2", "sent_2").distinct()


def p1_alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_alignment.align(table(spark, sf_dir, "corpus", *P1_COLUMNS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_truncation.truncated(table(spark, sf_dir, "corpus", *P2_COLUMNS))


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_truncation.limits(table(spark, sf_dir, "corpus", *P2_COLUMNS))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_truncation.rates(table(spark, sf_dir, "corpus", *P2_COLUMNS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_forms.same_look(table(spark, sf_dir, "corpus", "id", "title", "abstract"))


def p3_consistent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_forms.consistent(table(spark, sf_dir, "corpus", "id", "title", "abstract"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_forms.classes(table(spark, sf_dir, "corpus", "id", "title", "abstract"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs.defects(table(spark, sf_dir, "qac", *P4_COLUMNS))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_language.unnamed_languages(table(spark, sf_dir, "corpus", *P5_COLUMNS))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_language.segments(table(spark, sf_dir, "corpus", *P5_COLUMNS))


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_language.documents(table(spark, sf_dir, "corpus", *P5_COLUMNS))


def p6_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_budget.token_budget(table(spark, sf_dir, "corpus", *P6_COLUMNS))


def p6_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_budget.context_tokens(table(spark, sf_dir, "corpus", *P6_COLUMNS))


def p6_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null")
    return p6_budget.document_tokens(docs, "doc_id", "text", [])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_encode.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = p8_pack.document_sizes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return p8_pack.pack(sizes, table(spark, sf_dir, "containers", "container_type", "capacity_tokens"))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pack.summary(p8_containers(spark, sf_dir), table(spark, sf_dir, "containers", "container_type", "capacity_tokens"))


def p8_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = table(spark, sf_dir, "containers", "container_type", "capacity_tokens")
    sizes = p8_pack.document_sizes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return p8_pack.limited_summary(p8_pack.pack_limited(sizes, containers), containers)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repetition.repetitive(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repetition.measure(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_alignment_scores,
        p2_found,
        p2_limits,
        p2_rates,
        p3_found,
        p3_consistent_text,
        p3_classes,
        p4_found,
        p5_found,
        p5_segments,
        p5_documents,
        p6_token_budget,
        p6_context_tokens,
        p6_document_tokens,
        p7_ids,
        p8_containers,
        p8_summary,
        p8_limited,
        p9_found,
        p9_shares,
    )
}

ORACLE_SQL: dict[str, str] = {}
