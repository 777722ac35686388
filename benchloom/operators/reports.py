"""Reports from small results: leaderboards, summaries, run metadata and the trend log.

Everything here takes rows that were aggregated before (a row per model and metric, or a top-n).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Metrics in the order of the tables, and those that the trend log keeps.
METRIC_ORDER = ("main_score", "recall@10", "recall@100", "ndcg@10", "map@10", "mrr@10")
LOWER_IS_BETTER = ("same_language_share@100",)
LABELS = {"main_score": "Main score", "recall@10": "Recall@10", "recall@100": "Recall@100", "ndcg@10": "nDCG@10", "map@10": "MAP@10", "mrr@10": "MRR@10"}
# Characters that a table in LaTeX must escape.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}

INDEX_SCHEMA = "run_id string, created_at string, dataset string, variant string, model string, " + ", ".join(f"`{m}` double" for m in METRIC_ORDER) + ", sizes string"


def metric_order(names: set[str]) -> list[str]:
    """Known metrics in their order, then the others sorted."""
    return [m for m in METRIC_ORDER if m in names] + sorted(names - set(METRIC_ORDER))


def marked_best(metrics: DataFrame) -> DataFrame:
    """(model, metric, value, shown, best): values as shown, with whether they are the best of their metric."""
    by = Window.partitionBy("metric")
    best = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.min("value").over(by)).otherwise(F.max("value").over(by))
    return metrics.select("model", "metric", "value", F.format_string("%.4f", F.col("value")).alias("shown"), (F.col("value") == best).alias("best"))


def _cells(metrics: DataFrame) -> tuple[list[str], list[str], dict]:
    rows = marked_best(metrics).collect()
    cell = {(r.model, r.metric): r for r in rows}
    names = metric_order({r.metric for r in rows})
    models = sorted({r.model for r in rows}, key=lambda m: (-(cell[m, names[0]].value if (m, names[0]) in cell and cell[m, names[0]].value is not None else float("-inf")), m))
    return models, names, cell


def markdown_table(metrics: DataFrame) -> str:
    """Leaderboard in Markdown, best values in bold."""
    models, names, cell = _cells(metrics)
    out = ["| # | Model | " + " | ".join(LABELS.get(n, n) for n in names) + " |", "|---" * (len(names) + 2) + "|"]
    for k, m in enumerate(models, 1):
        shown = [(f"**{c.shown}**" if c.best else c.shown) if (c := cell.get((m, n))) and c.value is not None else "-" for n in names]
        out.append(f"| {k} | {m} | " + " | ".join(shown) + " |")
    return "\n".join(out) + "\n"


def latex_escape(text: str) -> str:
    return "".join(_LATEX.get(c, c) for c in text)


def latex_table(metrics: DataFrame) -> str:
    """Leaderboard in LaTeX, best values in bold."""
    models, names, cell = _cells(metrics)
    out = [r"\begin{tabular}{rl" + "r" * len(names) + "}", " & ".join(["\\#", "Model", *[latex_escape(LABELS.get(n, n)) for n in names]]) + r" \\ \hline"]
    for k, m in enumerate(models, 1):
        shown = [(rf"\textbf{{{c.shown}}}" if c.best else c.shown) if (c := cell.get((m, n))) and c.value is not None else "--" for n in names]
        out.append(" & ".join([str(k), latex_escape(m), *shown]) + r" \\")
    return "\n".join([*out, r"\end{tabular}", ""])


def markdown_rows(df: DataFrame, title: str) -> str:
    """A small table in Markdown, as it comes."""
    out = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|---" * len(df.columns) + "|"]
    out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.collect()]
    return "\n".join(out) + "\n"


def run_id(label: str = "", now: dt.datetime | None = None) -> str:
    """Identifier of a run: time in UTC and a label."""
    stamp = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d-%H%M%S")
    return f"{stamp}-{label}" if label else stamp


def run_metadata(run: str, dataset: str, variant: str, models: list[str], sizes: dict[str, int], seconds: dict[str, float]) -> str:
    """Run metadata as JSON."""
    return json.dumps({"run_id": run, "dataset": dataset, "variant": variant, "models": models, "sizes": sizes, "seconds": seconds}, indent=2, sort_keys=True)


def index_rows(spark: SparkSession, metrics: DataFrame, run: str, created_at: str, dataset: str, variant: str, sizes: dict[str, int]) -> DataFrame:
    """One trend row per model, to be appended to the log."""
    wide = metrics.groupBy("model").pivot("metric", list(METRIC_ORDER)).agg(F.first("value"))
    known = [F.lit(x).alias(c) for c, x in (("run_id", run), ("created_at", created_at), ("dataset", dataset), ("variant", variant))]
    return wide.select(*known, "model", *[F.col(f"`{m}`").cast("double").alias(m) for m in METRIC_ORDER], F.lit(json.dumps(sizes, sort_keys=True)).alias("sizes"))


def append_index(rows: DataFrame, path: str) -> None:
    """Append to the trend log."""
    rows.write.mode("append").parquet(path)


def summary_models(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, value) out of a summary file with a list of models and their metrics."""
    s = spark.read.json(path, multiLine=True, schema="models array<struct<model:string,main_score:double,metrics:map<string,double>>>")
    m = s.select(F.explode("models").alias("m"))
    main = m.select("m.model", F.lit("main_score").alias("metric"), F.col("m.main_score").alias("value")).where("value is not null")
    return main.unionByName(m.select("m.model", F.explode("m.metrics").alias("metric", "value")))


def raw_results(spark: SparkSession, path: str) -> DataFrame:
    """(model, variant, metrics) of all result files below a folder; the folder names the model, a suffix of the task the variant."""
    from ..sources.files import numeric_metrics

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("model"), F.regexp_extract(F.element_at(parts, -1), r"_(multilingual|cross_language)\.json$", 1).alias("variant"), F.col("value").alias("json"))
    return numeric_metrics(named).select("model", F.nullif("variant", F.lit("")).alias("variant"), "metrics")
