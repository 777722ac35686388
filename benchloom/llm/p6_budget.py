"""Problem 6: token budget per source and language.

Method: oversized texts are cut only where the tokenizer provably never joins, the chunks are
salted over the workers, exact counts are summed per document, then slices are rolled up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS
from .labels import canonical_label
from .p7_encode import count_tokens, publish_lexicon

#: Characters from which a text is cut into chunks of at least this size.
CHUNK_CHARS = 8_192


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Array of chunks that give the text again and the same tokens one by one.

    A cut lies before a single blank between two non-blanks, or between a letter or digit and
    punctuation other than the apostrophe: no pre-token of the pattern spans such a place. A
    text without such a place stays whole.
    """
    place = r"(?<=\S)(?= \S)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])|\z"
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s)(.{{{size},}}?(?:{place})|.+)"), F.lit(1))
    )


def document_tokens(docs: DataFrame, key: str, text: str, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, size: int = CHUNK_CHARS) -> DataFrame:
    """(key, keep..., n_tokens) once per distinct (key, keep...); null and empty texts count 0.

    Only chunks of oversized texts are shuffled, salted by chunk number; all others are counted
    where they are read. A key that is delivered again with an equal text counts once.
    """
    handle = publish_lexicon(docs, key, text, tokenizer, folder)
    cols = [key, *keep]
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.where(F.length(body) <= size).select(*cols, F.lit(0).alias("chunk"), body.alias("t"))
    cut = docs.where(F.length(body) > size).select(*cols, F.posexplode(chunks(body, size)).alias("chunk", "t"))
    salted = cut.repartition(F.col(key), F.col("chunk"))
    counted = count_tokens(whole, handle, [*cols, "chunk"], "t").unionByName(count_tokens(salted, handle, [*cols, "chunk"], "t"))
    once = counted.groupBy(*cols, "chunk").agg(F.max("n_tokens").alias("n_tokens"))
    return once.groupBy(*cols).agg(F.sum("n_tokens").alias("n_tokens"))


def context_tokens(corpus: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, language, source, domain, n_tokens) of the contexts, each id once.

    Language is the canonical code of the label, ``und`` where it names none; source is trimmed
    and lower-cased; domain is the upper-cased subclass of the first code, null without codes.
    An id delivered with several slices counts in the smallest (language, source, domain).
    """
    domain = F.upper(F.substring(F.trim(F.get(F.split("ipc_codes", r"\|"), F.lit(0))), 1, 4))
    rows = corpus.select(
        "id",
        "context",
        F.coalesce(canonical_label(F.col("language")), F.lit("und")).alias("language"),
        F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"),
        F.when(domain != "", domain).alias("domain"),
    ).where(F.col("id").isNotNull())
    each = document_tokens(rows, "id", "context", ["language", "source", "domain"], tokenizer, folder)
    one = each.groupBy("id").agg(F.min(F.struct("language", "source", "domain", "n_tokens")).alias("s"))
    return one.select("id", "s.language", "s.source", "s.domain", "s.n_tokens")


def token_budget(corpus: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(language, source, domain, n_documents, n_tokens): the roll-up of ``context_tokens`` to slices."""
    one = context_tokens(corpus, tokenizer, folder)
    return one.groupBy("language", "source", "domain").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
