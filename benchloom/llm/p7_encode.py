"""Problem 7: encoding of the whole corpus with a public tokenizer.

Method: minimal acyclic transducer lexicon, see ``bpe``. Ids equal those of the public
tokenizer without special tokens; strings that look like special tokens are ordinary text.
Null and empty texts give an empty list. One pass, no shuffle; rows stream through Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS, Published, build_lexicon
from .common import bounded_sample

#: Documents that decide which words the lexicon holds; it only affects speed.
LEXICON_DOCUMENTS = 2_000


def publish_lexicon(docs: DataFrame, key: str, text: str, tokenizer: str, folder: str, bound: int = LEXICON_DOCUMENTS) -> Published:
    """Lexicon of the frequent words of a bounded sample, at hand on every executor."""
    sample = bounded_sample(docs.select(key, text), key, bound)
    blob = build_lexicon((r[1] for r in sample), tokenizer, folder)
    return Published(docs.sparkSession, blob, tokenizer, folder)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids list of int) of every row of ``docs``; other columns are ignored.

    Repeated rows stay repeated rows, an empty table gives an empty table.
    """
    handle = publish_lexicon(docs, key, text, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = handle.open().ids
        for b in batches:
            parts = [ids(t) for t in b.column(1).to_pylist()]
            ends, at = [0], 0
            for p in parts:
                at += len(p) >> 2
                ends.append(at)
            values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(docs: DataFrame, handle: Published, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of ``text`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = handle.open().count
        for b in batches:
            n = pa.array([count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint")
