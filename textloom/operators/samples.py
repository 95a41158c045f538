"""Filters and scores of synthetic samples and of distilled texts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions import lexicons as lex
from ..functions import text as tx

FENCE = "```"


def incomplete(text: Column) -> Column:
    bare = tx.strip(text)
    odd = lambda c: F.length(c) - F.length(F.replace(c, F.lit(FENCE), F.lit("")))
    unequal = lambda a, b: F.regexp_count(bare, F.lit(a)) != F.regexp_count(bare, F.lit(b))
    return (bare == "") | bare.rlike("(?d)" + lex.DANGLING) | ((odd(bare) / 3) % 2 == 1) | unequal(r"\{", r"\}") | unequal(r"\(", r"\)")


def repetition_ratio(text: Column, n: int = 4) -> Column:
    """Distinct n-grams over all; 0 for fewer than n words."""
    return counting.distinct_share(text, n)


def sample_quality(response: Column, task: Column, least: int = 30, most: int = 8000, repetition: float = 0.35) -> Column:
    bare = tx.strip(response)
    n = F.length(bare)
    short = n < F.when(task.isin("math", "qa", "reasoning"), 2).otherwise(least)
    braced = bare.rlike(r"^[{\[]") & F.try_parse_json(bare).isNull()
    return (
        F.when(short, "too_short").when(n > most, "too_long").when(incomplete(bare), "incomplete").when((repetition_ratio(response) < repetition) & (n > 120), "repeated_reasoning")
        .when(bare.rlike(lex.LEAKED_FORMAT), "hallucinated_formatting").when(braced, "broken_json")
    )


def toxicity_score(text: Column) -> Column:
    """A fifth for each hit, 1 at most, whatever the length."""
    hits = sum((tx.count(text, p) for p in lex.HARMFUL[1:]), tx.count(text, lex.HARMFUL[0]))
    named = tx.holds(F.lower(text), *lex.HARMFUL_WORDS)
    return F.when(named, F.least(F.lit(1.0), hits / 5)).when(text.isNotNull(), 0.0)


def reasoning_score(reasoning: Column, response: Column) -> Column:
    r = tx.strip(F.coalesce(reasoning, F.lit("")))
    key = F.lower(F.substring(F.coalesce(F.try_element_at(tx.words(F.coalesce(response, F.lit(""))), F.lit(1)), F.lit("")), 1, 12))
    n = F.length(r)
    point = lambda c, v: F.when(c, v).otherwise(0.0)
    found = F.when(key == "", 0.0).when(F.contains(F.lower(r), key), 0.25).when(F.contains(F.lower(r), F.substring(key, 1, 6)), 0.1).otherwise(0.0)
    score = point(r.rlike(lex.STEP_MARK), 0.25) + point(r.rlike(lex.CONNECTIVE), 0.15) + F.when(n.between(80, 6000), 0.25).when(n.between(30, 79), 0.1).otherwise(0.0) + found - point(r.rlike(lex.CONTRADICTION), 0.2)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def composite_quality(reasoning: Column, response: Column, has_input: Column) -> Column:
    n = F.length(tx.strip(F.coalesce(response, F.lit(""))))
    plain = F.least(F.lit(1.0), n / 250) * 0.85 + F.when(has_input, 0.1).otherwise(0.0) + F.when(n.between(40, 4000), 0.05).otherwise(0.0)
    scored = F.when(F.coalesce(tx.strip(reasoning), F.lit("")) != "", reasoning_score(reasoning, response)).otherwise(plain)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scored)), 4)


def confidence(logprobs: Column) -> Column:
    """exp of the mean of the log probabilities that are there; null without any."""
    some = F.filter(logprobs, lambda p: p.isNotNull())
    return F.when(F.size(some) > 0, F.exp(F.aggregate(some, F.lit(0.0), lambda a, p: a + p) / F.size(some)))


def heuristic_quality(text: Column) -> Column:
    """struct(n_words, max_word_freq, score, verdict)."""
    n = F.size(F.split(tx.strip(text), rf"{lex.WS}+", -1)) - (tx.strip(text) == "").cast("int")
    share = counting.most_frequent_share(text, r"\w+")
    artifact = F.exists(F.array(*[F.lit(p) for p in lex.TEACHER_PHRASES]), lambda p: F.contains(F.lower(text), p))
    short, repetitive = n < 30, (share > 0.06) & (n > 100)
    point = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 0.5 + F.least(F.lit(0.25), n / 4000) + point(~(artifact | short | repetitive), 0.1) - point(artifact, 0.3) - point(short, 0.2) - point(repetitive, 0.15)
    verdict = F.when(artifact | short, "REJECT").when(repetitive, "REVIEW").otherwise("KEEP")
    return F.struct(n.alias("n_words"), share.alias("max_word_freq"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), verdict.alias("verdict"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts with single spaces, joined by line breaks; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(tx.collapse(p), F.lit("")) for p in parts]), 256)


def extract_code(text: Column) -> Column:
    """All fenced python blocks, a blank line between them; else the first bare block; else null."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```python[ \t]*\n(.*?)```"), F.lit(1))
    bare = F.regexp_extract(text, r"(?s)```[ \t]*\n(.*?)```", 1)
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).when(bare != "", bare)


def extract_json(text: Column) -> Column:
    """The variant between the first { and the last }, or null."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def extract_number(text: Column) -> Column:
    """The last number of a text, commas taken out."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def verdict(reply: Column) -> Column:
    """struct(verdict, reason) of a verifier's reply."""
    given = F.upper(F.try_variant_get(extract_json(reply), "$.verdict", "string"))
    known = F.when(given.isin("KEEP", "REVIEW", "REJECT"), given).otherwise("REVIEW")
    pair = lambda v, why: F.struct(v.alias("verdict"), F.lit(why).cast("string").alias("reason"))
    return F.when(reply.isNull(), pair(F.lit("REVIEW"), "no_verifier_response")).when(extract_json(reply).isNull(), pair(F.lit("REVIEW"), "unparseable_verifier")).otherwise(pair(known, None))


def gold_score(kind: Column, response: Column, gold: Column) -> Column:
    low = F.lower(response)
    number, want = extract_number(response), F.try_element_at(gold, F.lit(1)).try_cast("double")
    all_in = F.forall(gold, lambda g: F.contains(response, g)).cast("double")
    any_in = F.exists(gold, lambda g: F.contains(response, g)).cast("double")
    share = F.size(F.filter(gold, lambda g: F.contains(low, F.lower(g)))) / F.greatest(F.size(gold), F.lit(1))
    close = (F.abs(number - want) <= 1e-3 * F.greatest(F.lit(1.0), F.abs(want))).cast("double")
    return F.coalesce(F.when(kind == "num", close).when(kind == "substr", all_in).when(kind == "any_substr", any_in).when(kind == "all_substr_ci", share).when(kind == "length_40", (F.length(tx.strip(response)) >= 40).cast("double")).when(kind == "json_check", extract_json(response).isNotNull().cast("double")), F.lit(0.0))


#: Scores of a sample (response, reasoning, logprobs): functions that give a number or null. Others can be added.
SCORERS = {
    "confidence_score": lambda: confidence(F.col("logprobs")),
    "reasoning_score": lambda: reasoning_score(F.col("reasoning"), F.col("response")),
}


def scored(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """``df`` with scores (a column for each of ``SCORERS``) and keep: no score is under its least; one that is null passes."""
    out = df.withColumns({name: score() for name, score in SCORERS.items()})
    keep = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(name) >= bound, F.lit(True)) for name, bound in least.items()], F.lit(True))
    return out.withColumn("keep", keep)
