"""Distilled records: planning, gates, verification, routes and the numbers about them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import Tables
from .keys import first_of_keys
from .samples import heuristic_quality, sample_quality, toxicity_score


def passes(score: Column, least: float) -> Column:
    """Whether a score reaches the least; one that is missing passes."""
    return F.coalesce(score, F.lit(1.0)) >= least


def second_teacher(teachers: Column, first: Column) -> Column:
    """The first of several teachers that isn't the given one, or null."""
    return F.get(F.filter(teachers, lambda t: t != first), F.lit(0))


def joined_teachers(teachers: Column) -> Column:
    return F.array_join(teachers, "+")


def is_ensemble(difficulty: Column, task_type: Column, hard: tuple[str, ...] = ("hard",), tasks: tuple[str, ...] = ()) -> Column:
    """Whether an item is worth two teachers: a hard one, of one of the tasks if any are named."""
    some = difficulty.isin(*hard)
    return F.coalesce(some & task_type.isin(*tasks) if tasks else some, F.lit(False))


def finished(results: DataFrame, key: str = "id", output: str = "output") -> tuple[DataFrame, DataFrame]:
    """Results with an output, and the ids that are done: empty ones are neither kept nor done, so they are tried again."""
    kept = results.filter(tx.strip(F.coalesce(F.col(output), F.lit(""))) != "")
    return kept, kept.select(key).distinct()


def cache_lookup(requests: DataFrame, cache: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose hash (of ``columns``) the cache (request, response) holds, with the response; and the others."""
    keyed = requests.withColumn("request", F.sha2(F.to_json(F.struct(*columns)), 256))
    return keyed.join(cache.select("request", "response"), "request"), keyed.join(cache.select("request"), "request", "left_anti")


def sample_chain(df: DataFrame, languages: tuple[str, ...] = (), most_toxic: float = 0.5, rule: Column | None = None, toxicity: Column | None = None) -> DataFrame:
    """``df`` (seq, response, task_type, lang) with reason: quality:<rule>, duplicate, language, toxicity, or null.

    In this order. A response is a duplicate of an earlier one that passed the quality rules,
    also if that one goes for its language or toxicity later. ``rule`` and ``toxicity``: others than
    ``samples.sample_quality`` and ``toxicity_score``. Rules, which cost most, are decided once for each row; numbers and keys take part in the joins, not texts.
    """
    rule = sample_quality(F.col("response"), F.col("task_type")) if rule is None else rule
    key = F.when(F.col("_rule").isNull(), F.sha2(tx.collapse(F.coalesce("response", F.lit(""))), 256))
    toxicity = toxicity_score(F.col("response")) if toxicity is None else toxicity
    judged = df.select("seq", "response", rule.alias("_rule"))
    judged = Tables(df.sparkSession).keep(judged.select("seq", "_rule", key.alias("k"), F.when(F.col("_rule").isNull(), toxicity > most_toxic).alias("_toxic")))
    seen = first_of_keys(df.sparkSession, judged.select("seq", "k"))
    out = df.join(judged.drop("k").join(seen, "seq"), "seq")
    other = ~F.coalesce(F.col("lang").isin(*languages), F.lit(False)) if languages else F.lit(False)
    reason = F.when(F.col("_rule").isNotNull(), F.concat(F.lit("quality:"), "_rule")).when(F.col("duplicate"), "duplicate").when(other, "language").when(F.col("_toxic"), "toxicity")
    return out.select(*df.columns, reason.alias("reason"))


def verified(df: DataFrame) -> DataFrame:
    """``df`` (text, verdict of a second opinion or null, code_runs or null, factual or null) with quality and decision.

    The heuristic score and verdict; code that doesn't run, artifacts and short
    texts are rejected whatever else is said. A second opinion moves the score
    by 0.2 up (KEEP) or 0.3 down (REJECT), facts confirmed by 0.05 up; three decimals, within 0 and 1.
    """
    h = heuristic_quality(F.col("text"))
    rows = df.withColumn("_h", h)
    hard = (F.col("_h.verdict") == "REJECT") | F.coalesce(~F.col("code_runs"), F.lit(False))
    moved = F.col("_h.score") + F.when(F.col("verdict") == "KEEP", 0.2).when(F.col("verdict") == "REJECT", -0.3).otherwise(0.0) + F.when(F.coalesce("factual", F.lit(False)), 0.05).otherwise(0.0)
    score = F.bround(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)), 8), 3)
    decision = F.when(hard, "REJECT").otherwise(F.coalesce("verdict", F.col("_h.verdict")))
    return rows.withColumns({"quality": score, "decision": decision}).drop("_h")


def by_quality(df: DataFrame) -> DataFrame:
    """Best first, rows of one quality in their order."""
    return df.orderBy(F.desc("quality"), "seq")


def teacher_scores(scored: DataFrame) -> DataFrame:
    """model, category (null: all), mean (three decimals) and n of (model, category, score), in one pass."""
    out = scored.cube("model", "category").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return out.filter("_g IN (0, 1)").select("model", F.when(F.col("_g") == 0, F.col("category")).alias("category"), F.bround("mean", 3).alias("mean"), "n")


def routes(scores: DataFrame, order: list[str]) -> DataFrame:
    """category, model: the best mean of each category; of equals the first in ``order``."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = scores.filter("category IS NOT NULL").groupBy("category").agg(F.max_by("model", F.struct("mean", -rank)).alias("model"))
    return best


def filter_counts(judged: DataFrame, least_rate: float = 0.0) -> DataFrame:
    """attempted, accepted, rejected, reasons (name -> rows) of rows with a reason or null, and a warning where fewer than ``least_rate`` pass."""
    by = judged.groupBy("reason").agg(F.count("*").alias("n"))
    some = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    accepted = F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0))
    row = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"), accepted.alias("accepted"), F.map_from_entries(F.array_sort(F.collect_list(some))).alias("reasons"))
    return row.select("attempted", "accepted", (F.col("attempted") - F.col("accepted")).alias("rejected"), "reasons", (F.col("accepted") < least_rate * F.col("attempted")).alias("warned"))


def costs(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """calls, tokens_in, tokens_out and cost, prices being for a million tokens."""
    i, o = F.coalesce(F.sum("tokens_in"), F.lit(0)), F.coalesce(F.sum("tokens_out"), F.lit(0))
    return calls.agg(F.count("*").alias("calls"), i.alias("tokens_in"), o.alias("tokens_out"), ((i * price_in + o * price_out) / 1e6).alias("cost"))


def instruction(df: DataFrame) -> DataFrame:
    """The normalised projection of a sample; what is missing gets its default."""
    text = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return df.select("id", text("instruction"), text("input"), text("response"), text("task_type"), text("difficulty", "medium"), text("language", "en"), text("generator", "unknown"), number("quality_score"), number("confidence"))


PROVENANCE = ("id", "task_type", "domain", "difficulty", "teachers", "verdict", "quality", "prompt_hash", "created", "license")


def provenance(df: DataFrame) -> DataFrame:
    """A row's origin in ten fields, null where it isn't known."""
    have = set(df.columns)
    teachers = joined_teachers(F.col("teachers")) if dict(df.dtypes).get("teachers", "").startswith("array") else None
    return df.select(*[(teachers if c == "teachers" and teachers is not None else F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in PROVENANCE])


def slim(df: DataFrame) -> DataFrame:
    """text and metadata, the other columns as JSON."""
    return df.select("text", F.to_json(F.struct(*[c for c in df.columns if c != "text"])).alias("metadata"))


def assembled(df: DataFrame, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """instruction, input, response of replies (task_type, reply: JSON text), by the keys that a task's template asks for.

    ``mappings``: task -> {column: key}. A reply that isn't JSON, of an unknown task or without a response is no sample.
    """
    reply = F.try_parse_json("reply")

    def column(name: str) -> Column:
        cases = [(F.col("task_type") == task, F.try_variant_get(reply, f"$.{keys[name]}", "string")) for task, keys in mappings.items() if name in keys]
        return functools.reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("string")

    out = df.select("*", column("instruction").alias("instruction"), F.coalesce(column("input"), F.lit("")).alias("input"), column("response").alias("response"))
    return out.filter("instruction IS NOT NULL AND response IS NOT NULL")


def evaluation_items(spark: SparkSession, items: list[dict], holdout: bool = True) -> DataFrame:
    """A small set of items of one's own, marked so that no training mixture takes them."""
    rows = [(i, x["category"], x["prompt"], x.get("kind", "substr"), list(x.get("gold", ()))) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "id long, category string, prompt string, kind string, gold array<string>").withColumns({"eval_only": F.lit(holdout), "train": F.lit(not holdout)})
