"""Sampling, planning, model-backed generation and grading.

Models are behind a provider: a function over batches that maps a request to a response. The offline
provider reads a table of responses, so every pipeline here is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FAITHFULNESS = ("grounding", "precision", "numerical_fidelity")
# Criteria of quality by mode.
QUALITY = {
    "technical": ("search_bar_realism", "specificity", "phrasing_economy", "focus", "linguistic_quality"),
    "semantic_retrieval": ("search_realism", "lexical_distance", "conceptual_framing", "retrievability", "linguistic_quality"),
}
CANDIDATES = 3

# ---------------------------------------------------------------- sampling and planning


def seeded(seed: int, *columns: str) -> Column:
    """Seeded order of rows that is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary"))


def stratified_sample(rows: DataFrame, size: int, stratum: str, key: str, seed: int) -> DataFrame:
    """About ``size`` rows in proportion to the strata, at least one of each, trimmed to ``size`` in seeded order."""
    n = rows.count()
    each = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n")).select("_s", F.greatest(F.lit(1), F.bround(F.col("_n") * size / max(n, 1)).cast("int")).alias("_want"))
    w = Window.partitionBy(stratum).orderBy(seeded(seed, key), key)
    picked = rows.withColumn("_r", F.row_number().over(w)).join(each, F.col(stratum).eqNullSafe(F.col("_s"))).where("_r <= _want").select(*rows.columns)
    return picked.orderBy(seeded(seed, key), key).limit(size)


def question_quotas(total: int, n_languages: int = 4) -> dict[int, int]:
    """Questions per strategy 1 to 4 that add up to ``total``; strategy 4 asks one per language, so its share is a multiple.

    Of all splits that give every strategy a document, the one whose shares are closest to each other,
    then the one in which strategy 4 is closest to an even share.
    """

    def split(documents: int) -> list[int]:
        share = [(total - documents * n_languages + 2 - k) // 3 for k in range(3)]
        return [*share, documents * n_languages]

    splits = [s for s in map(split, range(1, total // n_languages + 1)) if min(s) > 0]
    if not splits:
        raise ValueError(f"{total} questions can't be split over four strategies")
    return dict(enumerate(min(splits, key=lambda s: (max(s) - min(s), abs(4 * s[3] - total))), 1))


def generation_plan(publications: DataFrame, pool: int, per_mode: int, seed: int, n_languages: int = 4, strict: bool = True) -> DataFrame:
    """(publication_number, mode, strategy): a seeded pool, one half for each mode, strategies by their quotas in order.

    Raises ``ValueError`` where there are fewer publications than the pool or its halves hold fewer than the
    quotas need; with ``strict`` off the plan is short instead.
    """
    if strict:
        needed = sum(n // n_languages if k == 4 else n for k, n in question_quotas(per_mode, n_languages).items())
        have = publications.select("publication_number").distinct().count()
        if have < pool or pool // 2 < needed:
            raise ValueError(f"{have} publications, a pool of {pool} and {needed} documents a mode don't go together")
    quotas = question_quotas(per_mode, n_languages)
    w = Window.orderBy(seeded(seed, "publication_number"), "publication_number")
    ranked = publications.select("publication_number").distinct().orderBy(seeded(seed, "publication_number"), "publication_number").limit(pool).withColumn("_r", F.row_number().over(w) - 1)
    half = pool // 2
    place = F.when(F.col("_r") < half, F.col("_r")).otherwise(F.col("_r") - half)
    strategy, at = F.lit(None).cast("int"), 0
    for k, questions in quotas.items():
        n = questions // n_languages if k == 4 else questions
        strategy = F.when((place >= at) & (place < at + n), k).otherwise(strategy)
        at += n
    return ranked.select("publication_number", F.when(F.col("_r") < half, "technical").otherwise("semantic_retrieval").alias("mode"), strategy.alias("strategy")).where("strategy is not null")


def target_languages(docs: DataFrame, strategy: int, languages: tuple[str, ...], seed: int) -> DataFrame:
    """(publication_number, target): 1 any language, 2 one that is missing (any if none is), 3 one that is there (any if none is), 4 all."""
    have = docs.groupBy("publication_number").agg(F.collect_set("language").alias("have"))
    every = F.array(*map(F.lit, languages))
    if strategy == 4:
        return have.select("publication_number", F.explode(every).alias("target"))
    here = F.filter(every, lambda x: F.array_contains("have", x))
    gone = F.filter(every, lambda x: ~F.array_contains("have", x))
    choice = {1: every, 2: F.when(F.size(gone) > 0, gone).otherwise(every), 3: F.when(F.size(here) > 0, here).otherwise(every)}[strategy]
    number = F.conv(F.substring(seeded(seed, "publication_number"), 1, 7), 16, 10).cast("long")
    return have.withColumn("_c", choice).select("publication_number", F.element_at("_c", (number % F.size("_c") + 1).cast("int")).alias("target"))


def balanced_documents(docs: DataFrame, languages: tuple[str, ...], per_language: int, seed: int) -> DataFrame:
    """(publication_number, language): publications for each language, the scarcest language first, none twice.

    The loop runs over the few languages; each round is a distributed anti join and a top-n.
    """
    have = docs.select("publication_number", "language").distinct()
    counts = {r[0]: r[1] for r in have.where(F.col("language").isin(*languages)).groupBy("language").count().collect()}
    out = None
    for lang in sorted(languages, key=lambda x: (counts.get(x, 0), languages.index(x))):
        free = have.where(F.col("language") == lang)
        if out is not None:
            free = free.join(out.select("publication_number"), "publication_number", "left_anti")
        pick = free.orderBy(seeded(seed, "publication_number"), "publication_number").limit(per_language).select("publication_number", "language")
        out = pick if out is None else out.unionByName(pick)
    return out


# ---------------------------------------------------------------- grades


def normalized_grades(responses: DataFrame, keys: list[str], criteria: tuple[str, ...], n: int = CANDIDATES) -> DataFrame:
    """(keys..., idx, criteria...): grades of ``n`` candidates per key; missing or unreadable ones are 1.

    ``responses`` has the keys and ``response``, JSON (in a code fence or not) with a list ``scores``.
    """
    kind = "struct<scores:array<struct<" + ",".join(f"{c}:int" for c in criteria) + ">>>"
    parsed = responses.withColumn("_s", F.from_json(T.json_body(F.col("response")), kind)["scores"])
    each = parsed.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.select(*keys, "idx", *[F.coalesce(F.try_element_at("_s", F.col("idx") + 1)[c], F.lit(1)).alias(c) for c in criteria])


def faithfulness_total() -> Column:
    """Sum of the three faithfulness grades."""
    return sum((F.col(c) for c in FAITHFULNESS[1:]), F.col(FAITHFULNESS[0]))


def quality_total(mode: str) -> Column:
    """Sum of the five quality grades of a mode."""
    first, *rest = QUALITY[mode]
    return sum((F.col(c) for c in rest), F.col(first))


def best_per_key(rows: DataFrame, keys: list[str], total: str, idx: str = "idx") -> DataFrame:
    """The candidate with the highest total of each key, the first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(total), idx)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Flags that a translation must have, with what holds where the check didn't say; the last two only count from medium severity on.
HARD_FLAGS = {"language_ok": False, "meaning_ok": False, "technical_ok": False, "specificity_ok": False, "terminology_ok": True, "artifact_ok": True}
SOFT_FLAGS = {"grammar_ok": True, "fluency_ok": False}


def translation_approval(checks: DataFrame) -> DataFrame:
    """``checks`` with ``approved`` and ``retry``; an unknown severity counts as high."""
    every = lambda flags: F.least(*[F.coalesce(F.col(c), F.lit(v)) for c, v in flags.items()])
    mild = F.coalesce(F.lower(F.trim("severity")) == "low", F.lit(False))
    approved = every(HARD_FLAGS) & (every(SOFT_FLAGS) | mild)
    return checks.withColumn("approved", approved).withColumn("retry", ~approved)


# ---------------------------------------------------------------- provider and loops

Provider = Callable[[pd.DataFrame], pd.Series]


def ask(requests: DataFrame, provider: Provider, keys: list[str]) -> DataFrame:
    """(keys..., response): a provider called on batches of requests; partitions are the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(response=provider(b).astype(object))

    kinds = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)
    return requests.mapInPandas(run, f"{kinds}, response string")


def offline(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., response) from a table of recorded responses; null where there is none."""
    return requests.select(*keys).distinct().join(responses.select(*keys, "response"), keys, "left")


def retry_loop(requests: DataFrame, attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """(keys..., attempt, response, approved): the first approved attempt of each request, else its last one.

    ``attempts`` (keys..., attempt from 1, response, approved) are recorded; the loop of asking again what
    still fails is one window over them.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("approved"), F.when(F.col("approved"), F.col("attempt")).otherwise(-F.col("attempt")))
    got = attempts.where(F.col("attempt") <= most).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return requests.select(*keys).distinct().join(got.select(*keys, "attempt", "response", "approved"), keys)


def group_variants(rows: DataFrame) -> DataFrame:
    """(source_id, concept, term, variants): rows that share a source, concept and term, for one query each; A and E apart."""
    use = rows.where(~F.col("variant").isin("A", "E"))
    return use.groupBy("source_id", "concept", "term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("variant", "id"))), lambda s: F.concat(s["variant"], F.lit(":"), s["id"])), ",").alias("variants"))
