"""Generation pipelines over a provider: ask for candidates, grade them, keep the best, package the rows.

A provider is a function from a batch of requests to responses; recorded responses make a run repeatable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import grading as G

MAX_ATTEMPTS = 3

Asker = Callable[[DataFrame, list[str]], DataFrame]


def recorded(responses: DataFrame) -> Asker:
    """Asker over a table of responses (keys..., response)."""
    return lambda requests, keys: G.offline(requests, responses, keys)


def live(provider: G.Provider) -> Asker:
    """Asker over a provider function."""
    return lambda requests, keys: G.ask(requests, provider, keys)


def with_schema(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with exactly the given columns as strings; missing ones are ''."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def parsed_pairs(responses: DataFrame, keys: list[str], n: int = G.CANDIDATES) -> DataFrame:
    """(keys..., idx, question, answer): up to ``n`` pairs of a response; unreadable responses give none."""
    kind = "struct<pairs:array<struct<question:string,answer:string>>>"
    p = responses.withColumn("_p", F.from_json(T.json_body(F.col("response")), kind)["pairs"])
    each = p.select(*keys, F.posexplode(F.slice(F.coalesce("_p", F.array().cast("array<struct<question:string,answer:string>>")), 1, n)).alias("idx", "pair"))
    return each.select(*keys, "idx", "pair.question", "pair.answer").where("trim(question) != '' and trim(answer) != ''")


def graded_pairs(documents: DataFrame, keys: list[str], mode: str, generate: Asker, faithfulness: Asker, quality: Asker, context_chars: int | None = None) -> DataFrame:
    """(keys..., idx, question, answer, grades..., total_score): candidates of each document with both grades.

    A request carries the whole text; ``context_chars`` bounds it for models that take no more.
    """
    request = documents.withColumn("prompt", F.col("text") if context_chars is None else F.substring("text", 1, context_chars))
    pairs = parsed_pairs(generate(request, keys), keys)
    graded = pairs.groupBy(*keys).agg(F.to_json(F.collect_list(F.struct("idx", "question", "answer"))).alias("prompt"))
    faith = G.normalized_grades(faithfulness(graded, keys), keys, G.FAITHFULNESS).withColumn("faith_overall", G.faithfulness_total())
    qual = G.normalized_grades(quality(graded, keys), keys, G.QUALITY[mode]).withColumn("overall", G.quality_total(mode))
    faith = faith.withColumnsRenamed({c: f"faith_{c}" for c in G.FAITHFULNESS})
    qual = qual.withColumnsRenamed({c: f"qual_{c}" for c in (*G.QUALITY[mode], "overall")})
    out = pairs.join(faith, [*keys, "idx"]).join(qual, [*keys, "idx"])
    return out.withColumn("total_score", F.col("faith_overall") + F.col("qual_overall"))


def best_pairs(graded: DataFrame, keys: list[str]) -> DataFrame:
    """The pair with the highest total of each key."""
    return G.best_per_key(graded, keys, "total_score")


def verified(requests: DataFrame, keys: list[str], generate: Asker, verify: Asker, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(keys..., attempt, response, approved): ask, verify, and ask again what failed, at most ``most`` times.

    Only failing requests go into the next round, so a round costs what is left. A verdict is JSON with
    ``approved``; an unreadable one counts as a rejection.
    """
    done, left = None, requests.select(*keys).distinct()
    for attempt in range(1, most + 1):
        asked = [*keys, "attempt"]
        answer = generate(left.withColumn("attempt", F.lit(attempt)), asked)
        verdict = verify(answer, asked).withColumnRenamed("response", "verdict")
        ok = F.coalesce(F.from_json(T.json_body(F.col("verdict")), "struct<approved:boolean>")["approved"], F.lit(False))
        got = answer.join(verdict, asked, "left").select(*asked, "response", ok.alias("approved"))
        kept = got if attempt == most else got.where("approved")
        done = kept if done is None else done.unionByName(kept)
        left = left.join(got.where("approved"), keys, "left_anti")
    return done


def mentions(question: Column, names: Column) -> Column:
    """Whether a question holds any of the names, letter case ignored."""
    low = F.lower(question)
    return F.exists(names, lambda n: (F.trim(n) != "") & F.contains(low, F.lower(n)))


def concept_questions(pairs: DataFrame) -> DataFrame:
    """Pairs whose question gives away no alias of its concept (``aliases``)."""
    return pairs.where(~F.coalesce(mentions(F.col("question"), F.col("aliases")), F.lit(False)))


def term_questions(pairs: DataFrame) -> DataFrame:
    """Pairs whose question holds the required ``term`` as it is."""
    return pairs.where(F.contains("question", "term"))


def spread_over_variants(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per variant of a group, sharing the group's query; ``groups`` is that of ``group_variants``."""
    each = groups.withColumn("v", F.explode(F.split("variants", ",")))
    return queries.join(each, ["source_id", "concept", "term"]).select("source_id", "concept", "term", "question", F.substring_index("v", ":", 1).alias("variant"), F.expr("substring(v, instr(v, ':') + 1)").alias("id"))


def spread_over_depths(queries: DataFrame, rungs: DataFrame) -> DataFrame:
    """One row per depth of a ladder, sharing the base's query: ``queries`` (base_id, language, question), ``rungs`` (base_id, depth, id)."""
    ordered = rungs.groupBy("base_id").agg(F.sort_array(F.collect_list(F.struct("depth", "id"))).alias("r"))
    return queries.join(ordered, "base_id").select("base_id", "language", "question", F.explode("r").alias("r")).select("base_id", "language", "question", "r.depth", "r.id")
