"""Problem 8: filling fixed-capacity containers.

Method: vector best-fit. A container has residual tokens, documents and attention cost (the sum
of squared piece lengths); an item goes into the container that stays fullest under every
constraint, chosen by the smallest weighted residual norm. Items come in decreasing size. The
registered packing has the limits that tokens imply, which divide no text that fits; the limited
one has a document and an attention limit that bind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS
from .common import cut_lineage
from .p7_encode import count_tokens, publish_lexicon

#: Items that one task packs at once; more items mean more tasks, not longer ones.
GROUP_ITEMS = 25_000
#: Containers filled less than this share in every dimension are opened again in the next round, over larger groups.
REOPEN_BELOW = 0.98
#: A round that saves less than this share of the reopened containers is the last.
LEAST_GAIN = 0.01
#: Weights of residual tokens, documents and attention cost in the norm.
WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(sizes: list[int], capacity: int, max_items: int | None = None, max_cost: int | None = None, weights: tuple = WEIGHTS) -> list[int]:
    """Container number of each size (all at most ``capacity``, in decreasing order for the best result).

    Every container that holds the item under all three capacities is weighed, and the one with the
    smallest norm of what would remain is taken, the first of equals. Without other limits a container
    takes as many documents as tokens and the attention cost of one full piece. A lower cost limit
    never divides a text: a piece that alone exceeds it has a container to itself.
    """
    items = capacity if max_items is None else max_items
    cost = capacity * capacity if max_cost is None else max_cost
    wt, wd, wa = weights
    tokens, docs, spent = (np.zeros(len(sizes), np.int64) for _ in range(3))
    used = 0
    out = []
    for size in sizes:
        fit = np.flatnonzero((tokens[:used] + size <= capacity) & (docs[:used] < items) & (spent[:used] + size * size <= cost))
        if len(fit):
            norm = wt * (1 - (tokens[fit] + size) / capacity) ** 2 + wd * (1 - (docs[fit] + 1) / items) ** 2 + wa * (1 - (spent[fit] + size * size) / cost) ** 2
            chosen = int(fit[np.argmin(norm)])
        else:
            chosen, used = used, used + 1
        tokens[chosen] += size
        docs[chosen] += 1
        spent[chosen] += size * size
        out.append(chosen)
    return out


def document_sizes(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have 0 tokens."""
    return count_tokens(docs, publish_lexicon(docs, "doc_id", "text", tokenizer, folder), ["doc_id"], "text")


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_type, capacity, doc_id, piece, n_tokens): a text over the capacity is divided into full pieces and a rest."""
    caps = containers.select("container_type", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()  # the configured types, a handful
    if not caps:
        return sizes.select(F.lit("").alias("container_type"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).alias("piece"), "n_tokens").limit(0)
    kinds = F.explode(F.array(*[F.struct(F.lit(c[0]).alias("container_type"), F.lit(int(c[1])).alias("capacity")) for c in caps]))
    count = F.greatest(F.ceil(F.col("n_tokens") / F.col("k.capacity")), F.lit(1)).cast("int")
    full = F.col("piece").cast("long") * F.col("capacity")
    return (
        sizes.where("doc_id is not null")
        .select("doc_id", "n_tokens", kinds.alias("k"))
        .select("k.container_type", "k.capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
        .select("container_type", "capacity", "doc_id", "piece", F.least(F.col("n_tokens") - full, F.col("capacity").cast("long")).alias("n_tokens"))
    )


SCHEMA = "container_type string, capacity int, container_id string, doc_id bigint, piece int, n_tokens bigint, fill double"


def _pack(round_no: int, max_items: int | None, max_cost: Callable[[int], int] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [b for b in batches if len(b)]
        if not held:
            return
        for (kind, cap), g in pd.concat(held).groupby(["container_type", "capacity"], sort=True):
            g = g.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            bins = best_fit(g["n_tokens"].tolist(), int(cap), max_items, max_cost(int(cap)) if max_cost else None)
            g = g.assign(container_id=bins, cost=g["n_tokens"].astype("float64") ** 2)
            by = g.groupby("container_id")
            full = (by["n_tokens"].transform("sum") / cap, by["n_tokens"].transform("count") / (max_items or cap), by["cost"].transform("sum") / (max_cost(cap) if max_cost else cap * cap))
            g["fill"] = np.maximum.reduce([f.to_numpy(float) for f in full])
            g["container_id"] = [f"{kind}-{round_no}-{part}-{b}" for b in bins]
            yield g[["container_type", "capacity", "container_id", "doc_id", "piece", "n_tokens", "fill"]]

    return run


def pack(sizes: DataFrame, containers: DataFrame, max_items: int | None = None, max_cost: Callable[[int], int] | None = None, group: int = GROUP_ITEMS) -> DataFrame:
    """(container_type, container_id, doc_id, piece, n_tokens): every piece in one container, none over capacity.

    ``max_cost`` gives the attention limit for a capacity. Items are dealt at random over tasks of about
    ``group`` items, so that each task sees the whole mix of sizes, whatever the order or skew of the input.
    Containers that stayed open in every dimension are packed again together, over groups that hold as many
    items, so of more containers: the waste is that of one group, not of each. This goes on until one task
    holds them all, none is left, or a round hardly saves any. Texts without tokens take part with size 0.
    """
    items = cut_lineage(pieces(sizes.distinct(), containers))
    done, round_no, before = None, 0, None
    reopened = None
    while True:
        n = items.count()
        tasks = max(1, -(-n // group))
        dealt = items.repartition(tasks, F.xxhash64(F.lit(round_no), "doc_id", "piece", "container_type"))
        packed = cut_lineage(dealt.mapInPandas(_pack(round_no, max_items, max_cost), SCHEMA))
        count = packed.select("container_id").distinct().count()
        if before is not None and count > (1 - LEAST_GAIN) * before:  # what the last round left is as good
            packed, tasks = (packed if count <= before else reopened), 1
        if tasks == 1:
            done = packed if done is None else done.unionByName(packed)
            break
        full = packed.where(F.col("fill") >= REOPEN_BELOW)
        reopened = packed.where(F.col("fill") < REOPEN_BELOW)
        done = full if done is None else done.unionByName(full)
        before = reopened.select("container_id").distinct().count()
        items = reopened.select("container_type", "capacity", "doc_id", "piece", "n_tokens")
        round_no += 1
        if not before:
            break
    return done.select("container_type", "container_id", "doc_id", "piece", "n_tokens")


#: Limits of the limited packing: documents in a container, and the share of the largest possible attention cost.
LIMITED_ITEMS, LIMITED_COST = 16, 0.5


def limited_cost(capacity: int) -> int:
    return int(LIMITED_COST * capacity * capacity)


def pack_limited(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``pack`` with a document and an attention limit that bind: few short texts or one long one per container."""
    return pack(sizes, containers, LIMITED_ITEMS, limited_cost)


def limited_summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_type, capacity_tokens, n_containers, and the least number by tokens, documents and attention cost) per type.

    A piece over the attention limit counts as one whole container there.
    """
    caps = containers.select("container_type", "capacity_tokens").distinct()
    size = F.col("n_tokens").cast("double")
    limit = F.floor(LIMITED_COST * F.col("capacity_tokens").cast("double") * F.col("capacity_tokens"))
    agg = packed.join(F.broadcast(caps), "container_type").groupBy("container_type", "capacity_tokens").agg(
        F.countDistinct("container_id").alias("n_containers"), F.ceil(F.sum("n_tokens") / F.col("capacity_tokens")).cast("long").alias("least_by_tokens"),
        F.ceil(F.count("*") / F.lit(LIMITED_ITEMS)).cast("long").alias("least_by_documents"), F.ceil(F.round(F.sum(F.least(size * size / limit, F.lit(1.0))), 6)).cast("long").alias("least_by_cost"),
    )
    return agg


def summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_type, capacity_tokens, n_containers, n_pieces, n_tokens, least_containers) per type."""
    caps = containers.select("container_type", "capacity_tokens").distinct()
    agg = packed.groupBy("container_type").agg(F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return agg.join(F.broadcast(caps), "container_type").select("container_type", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("long").alias("least_containers"))
