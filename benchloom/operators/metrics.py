"""Ranking metrics and exact top-k search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

CUTOFFS = (10, 20, 50, 100)
#: Queries that one block holds; a block is scored against a partition of the documents at a time.
QUERY_BLOCK = 512
#: Documents that a task scores at once.
DOCUMENT_CHUNK = 100_000


def normalized_vector(vectors: DataFrame, column: str) -> DataFrame:
    """``vectors`` with the column scaled to unit length in double; a zero vector stays zero."""
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn(column, F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))


def top_k(queries: DataFrame, docs: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` nearest documents of each query by dot product, ties by doc_id.

    ``queries`` (query_id, vector) and ``docs`` (doc_id, vector). Queries are cut into blocks; every
    document meets each block, and a task keeps the best ``k`` per query of the documents it has seen,
    so k rows per query and task are shuffled, not all pairs. Scores are rounded before ranking, so that
    the order of additions can't decide ties.
    """

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        qs = [q for part in right["queries"] for q in part]
        q = np.array([x["vector"] for x in qs], float)
        x = np.array(left["vector"].tolist(), float)
        ids = left["doc_id"].to_numpy()
        out = []
        for i in range(0, len(q), 64):
            s = np.round(q[i : i + 64] @ x.T, digits)
            for j, row in enumerate(s):
                kept = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                order = np.lexsort((ids[kept], -row[kept]))[:k]
                out.append(pd.DataFrame({"query_id": qs[i + j]["query_id"], "doc_id": ids[kept][order], "score": row[kept][order]}))
        return pd.concat(out)

    kind_q, kind_d = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    left, right = _blocks(queries, docs)
    part = left.cogroup(right).applyInPandas(score, f"query_id {kind_q}, doc_id {kind_d}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return part.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _blocks(queries: DataFrame, docs: DataFrame) -> tuple[GroupedData, GroupedData]:
    """Documents in chunks and queries in blocks, grouped by (block, chunk): every chunk meets every block once."""
    blocks = -(-max(queries.count(), 1) // QUERY_BLOCK)
    chunks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // DOCUMENT_CHUNK))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct(*queries.columns)).alias("queries"))
    keyed = packed.select("block", "queries", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    spread = chunked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return spread.groupBy("block", "chunk"), keyed.groupBy("block", "chunk")


def ranks_in_haystack(queries: DataFrame, docs: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): 1 + documents of other groups that score above each of a query's own scores.

    ``queries`` (query_id, vector, group, own array<struct<key, score>>), ``docs`` (doc_id, vector, group).
    Counts are added per task, so a row per own score and task is shuffled, never the pairs.
    """

    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "key": [], "score": [], "better": []}
        if len(left):
            x, group = np.array(left["vector"].tolist(), float), left["group"].to_numpy()
            for q in (q for part in right["queries"] for q in part):
                s = np.sort(np.round(x[group != q["group"]] @ np.array(q["vector"], float), digits))
                for own in q["own"]:
                    out["query_id"].append(q["query_id"])
                    out["key"].append(own["key"])
                    out["score"].append(own["score"])
                    out["better"].append(len(s) - int(np.searchsorted(s, own["score"], "right")))
        return pd.DataFrame(out)

    kind = queries.schema["query_id"].dataType.simpleString()
    left, right = _blocks(queries, docs)
    part = left.cogroup(right).applyInPandas(count, f"query_id {kind}, key int, score double, better bigint")
    return part.groupBy("query_id", "key", "score").agg((1 + F.sum("better")).alias("rank"))


def rank(results: DataFrame, by: list[str]) -> DataFrame:
    """``results`` (by..., corpus_id, score) with ``rank`` from 1, score falling, corpus_id rising."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "corpus_id")
    return results.withColumn("rank", F.row_number().over(w).cast("long"))


def judged(ranked: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """Ranked rows with ``hit`` and the query's ``n_relevant``; queries without a relevant document are left out.

    ``qrels`` (query_id, corpus_id) of relevant documents, distinct.
    """
    rel = qrels.select("query_id", "corpus_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return ranked.join(rel.withColumn("hit", F.lit(1)), ["query_id", "corpus_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0))).join(n, "query_id")


def per_query(hits: DataFrame, by: list[str], cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Recall, average precision, nDCG, reciprocal rank and hit at each cutoff, and full average precision.

    One window for the running hit count and one aggregation give all cutoffs. Average precision is
    divided by min(relevant, k), its full form by all relevant documents; gain is binary.
    """
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = hits.withColumn("precision", F.sum("hit").over(w) / F.col("rank")).withColumn("gain", 1 / F.log2(F.col("rank") + 1.0))
    aggs = [F.max("n_relevant").alias("n_relevant"), (F.sum(F.col("hit") * F.col("precision")) / F.max("n_relevant")).alias("map")]
    for k in cutoffs:
        top = F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)
        m = F.least(F.max("n_relevant"), F.lit(k).cast("long"))
        ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), m), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
        aggs += [
            (F.sum(top) / F.max("n_relevant")).alias(f"recall_{k}"),
            (F.sum(top * F.col("precision")) / m).alias(f"map_{k}"),
            (F.sum(top * F.col("gain")) / ideal).alias(f"ndcg_{k}"),
            F.coalesce(1 / F.min(F.when(top == 1, F.col("rank"))), F.lit(0.0)).alias(f"mrr_{k}"),
            F.max(top).cast("double").alias(f"hit_{k}"),
        ]
    return x.groupBy(*by).agg(*aggs)


def means(per: DataFrame, by: list[str], digits: int = 5) -> DataFrame:
    """Mean of every metric over queries, with the number of queries; metrics are the double columns."""
    metrics = [c for c, t in per.dtypes if t == "double"]
    return per.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), digits).alias(c) for c in metrics])


def same_language_share(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., share): share of the irrelevant documents in the top ``k`` that are in the query's language; 0 when none is irrelevant.

    ``hits`` has query_language and corpus_language; queries without a language are left out.
    """
    wrong = (F.col("rank") <= k) & (F.col("hit") == 0)
    own = wrong & (F.col("query_language") == F.col("corpus_language"))
    x = hits.where("query_language is not null")
    return x.groupBy(*by, "query_language").agg(F.coalesce(F.sum(F.when(own, 1).otherwise(0)) / F.nullif(F.sum(F.when(wrong, 1).otherwise(0)), F.lit(0)), F.lit(0.0)).alias("share"))


def split_recall(hits: DataFrame, qrels: DataFrame, query_languages: DataFrame, doc_languages: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., same_recall, cross_recall): recall over relevant documents in, and not in, the query's language; null where there are none."""
    total = (
        qrels.select("query_id", "corpus_id").distinct().join(query_languages, "query_id").join(doc_languages, "corpus_id", "left")
        .withColumn("same", F.coalesce(F.col("query_language") == F.col("corpus_language"), F.lit(False)))
        .groupBy("query_id").agg(F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("n_same"), F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("n_cross"))
    )
    top = (F.col("rank") <= k) & (F.col("hit") == 1)
    same = F.coalesce(F.col("query_language") == F.col("corpus_language"), F.lit(False))
    got = hits.groupBy(*by).agg(F.sum(F.when(top & same, 1).otherwise(0)).alias("g_same"), F.sum(F.when(top & ~same, 1).otherwise(0)).alias("g_cross"))
    return got.join(total, "query_id").select(*by, (F.col("g_same") / F.nullif(F.col("n_same"), F.lit(0))).alias("same_recall"), (F.col("g_cross") / F.nullif(F.col("n_cross"), F.lit(0))).alias("cross_recall"))


def rank_against(scores: DataFrame, haystack: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` (by..., score) with ``rank`` = 1 + number of haystack scores of the query that are greater.

    Both sides are merged in one sort per key with a running count: no candidate meets every haystack row.
    """
    a = scores.withColumn("_h", F.lit(0))
    b = haystack.select(*by, "score").withColumn("_h", F.lit(1))
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    eq = Window.partitionBy(*by, "score")
    counted = u.withColumn("rank", (1 + F.sum("_h").over(w) - F.sum("_h").over(eq)).cast("long"))
    return counted.where("_h = 0").drop("_h")
