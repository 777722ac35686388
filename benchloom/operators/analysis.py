"""Error analyses: confusion with look-alikes, reports by group, language pairs, decay curves, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(ranked: DataFrame, gold: DataFrame, negatives: DataFrame) -> DataFrame:
    """(model, query_id, gold_rank, negative_rank, win, neighbor_name): best ranks of gold and look-alikes.

    ``gold`` (query_id, corpus_id); ``negatives`` (query_id, corpus_id, neighbor_name). The look-alike wins
    when it ranks better; unranked counts as last; queries without a look-alike, or with neither ranked, are left out.
    """
    g = gold.select("query_id", "corpus_id").distinct().withColumn("is_gold", F.lit(True))
    n = negatives.groupBy("query_id", "corpus_id").agg(F.min("neighbor_name").alias("neighbor_name")).withColumn("is_negative", F.lit(True))
    x = ranked.join(g, ["query_id", "corpus_id"], "left").join(n, ["query_id", "corpus_id"], "left").join(n.select("query_id").distinct(), "query_id", "left_semi")
    neg = F.when(F.col("is_negative") & F.col("is_gold").isNull(), F.col("rank"))
    out = x.groupBy("model", "query_id").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("gold_rank"), F.min(neg).alias("negative_rank"), F.min_by(F.when(neg.isNotNull(), F.col("neighbor_name")), neg).alias("neighbor_name"))
    out = out.where("gold_rank is not null or negative_rank is not null")
    far = F.lit(1 << 62)
    return out.withColumn("win", F.coalesce("negative_rank", far) < F.coalesce("gold_rank", far)).select("model", "query_id", "gold_rank", "negative_rank", "win", F.when(F.col("win"), F.col("neighbor_name")).alias("neighbor_name"))


def confusion_report(conf: DataFrame) -> DataFrame:
    """(model, language, n, confusion_rate, gold_rank, negative_rank) by language and over all (ALL), as grouping sets."""
    out = conf.groupingSets([["model", "query_language"], ["model"]], "model", "query_language").agg(
        F.grouping("query_language").alias("g"), F.count("*").alias("n"), F.round(F.avg(F.col("win").cast("int")), 4).alias("confusion_rate"), F.round(F.avg("gold_rank"), 2).alias("gold_rank"), F.round(F.avg("negative_rank"), 2).alias("negative_rank")
    )
    return out.select("model", F.when(F.col("g") == 1, F.lit("ALL")).otherwise(F.coalesce("query_language", F.lit("?"))).alias("language"), "n", "confusion_rate", "gold_rank", "negative_rank")


def frequent_confusions(conf: DataFrame, most: int = 30) -> DataFrame:
    """(model, query_language, neighbor_name, n): most frequent winning look-alikes, a top-n report."""
    return conf.where("win").groupBy("model", "query_language", "neighbor_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model", "query_language", "neighbor_name").limit(most)


def group_report(per: DataFrame, dimensions: list[str], metric: str, digits: int = 4) -> DataFrame:
    """(model, dimension, value, n, mean): a metric by each of several dimensions, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions])).alias("d")
    return per.select("model", metric, each).groupBy("model", "d.dimension", "d.value").agg(F.count("*").alias("n"), F.round(F.avg(metric), digits).alias("mean"))


def best_model(per: DataFrame, metric: str) -> DataFrame:
    """(model, mean): the model with the highest mean, the first name on ties."""
    m = per.groupBy("model").agg(F.round(F.avg(metric), 9).alias("mean"))
    return m.orderBy(F.desc("mean"), "model").limit(1)


def language_pairs(per: DataFrame, metric: str) -> DataFrame:
    """(query_language, corpus_language, n, mean) of the best model."""
    best = best_model(per, metric).select("model")
    return per.join(best, "model", "left_semi").groupBy("query_language", "corpus_language").agg(F.count("*").alias("n"), F.round(F.avg(metric), 4).alias("mean"))


def pivot_by_model(report: DataFrame, models: list[str]) -> DataFrame:
    """Report rows with a column per model."""
    return report.groupBy("dimension", "value").pivot("model", models).agg(F.first("mean"))


def winners(metrics: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(metric, model, value): per metric the best model, the first name on ties; ``metrics`` (model, metric, value)."""
    key = F.when(F.col("metric").isin(*lower_is_better), -F.col("value")).otherwise(F.col("value")) if lower_is_better else F.col("value")
    w = Window.partitionBy("metric").orderBy(F.desc_nulls_last(key), "model")
    return metrics.withColumn("_n", F.row_number().over(w)).where("_n = 1 and value is not null").select("metric", "model", "value")


def leaderboard(metrics: DataFrame, main: str) -> DataFrame:
    """(rank, model, value) by the main metric, best first; ``metrics`` (model, metric, value)."""
    m = metrics.where(F.col("metric") == main)
    return m.select(F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), "model")).cast("long").alias("rank"), "model", "value")


def with_drops(curve: DataFrame) -> DataFrame:
    """Curve rows (model, query_id, depth, score) with ``drop``: the score at the previous depth less this one."""
    w = Window.partitionBy("model", "query_id").orderBy("depth")
    return curve.withColumn("drop", F.lag("score").over(w) - F.col("score"))


# Strategies by number; any language is the random one.
STRATEGIES = {"0": "forced_zh", "1": "random", "2": "random_missing", "3": "random_existing", "4": "all", "random_any": "random"}


def strategy_label(c: Column) -> Column:
    """Name of a strategy that is given by number (also as 1.0) or name; unknown ones stay as they are, trimmed."""
    plain = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), plain), plain)


def short_label(c: Column) -> Column:
    """Name of a model without its owner and the words that many share."""
    return F.regexp_replace(F.substring_index(c, "/", -1), "(paraphrase-)?multilingual-", "")


def curve_summary(curve: DataFrame, by: list[str], cutoffs: tuple[int, ...] = (1, 10, 100), digits: int = 6) -> DataFrame:
    """Per group: distinct queries, mean score and drop, exact median rank and recall at cutoffs."""
    return curve.groupBy(*by).agg(
        F.count_distinct("query_id").alias("n"),
        F.round(F.avg("score"), digits).alias("mean_score"),
        F.round(F.avg("drop"), digits).alias("mean_drop"),
        F.median("rank").alias("median_rank"),
        *[F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"recall_{k}") for k in cutoffs],
    )


def mode_breakdown(curve: DataFrame) -> DataFrame:
    """(model, mode, n, mean_drop): rows and mean drop by the mode that a step added, from depth 1 on."""
    return curve.where("depth >= 1").groupBy("model", "mode").agg(F.count("*").alias("n"), F.round(F.avg("drop"), 6).alias("mean_drop"))


def end_to_end(curve: DataFrame) -> DataFrame:
    """(model, first_score, last_score, loss): mean scores at the first and the last depth."""
    ends = curve.groupBy("model").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    x = curve.join(ends, "model").groupBy("model").agg(F.round(F.avg(F.when(F.col("depth") == F.col("lo"), F.col("score"))), 6).alias("first_score"), F.round(F.avg(F.when(F.col("depth") == F.col("hi"), F.col("score"))), 6).alias("last_score"))
    return x.withColumn("loss", F.round(F.col("first_score") - F.col("last_score"), 6))


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
