"""Benchmark rows as (context, choices, label); prompts; small record transforms."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def item(context: Column, choices: Column, label: Column) -> Column:
    """A struct, or null where the label names none of the choices."""
    label = label.try_cast("int")
    fits = (label >= 0) & (label < F.size(choices))
    return F.when(fits, F.struct(context.alias("context"), choices.alias("choices"), label.alias("label")))


def completion(activity: Column, start: Column, begun: Column, endings: Column, label: Column) -> Column:
    return item(tx.strip(F.concat(activity, F.lit(": "), start, F.lit(" "), begun)), endings, label)


def question(text: Column, choices: Column, letter: Column) -> Column:
    """Labelled by the letters A to E."""
    return item(F.concat(F.lit("Question: "), text, F.lit("\nAnswer:")), choices, F.instr(F.lit("ABCDE"), F.when(F.length(letter) == 1, letter).otherwise("-")) - 1)


def yes_no(text: Column, passage: Column, answer: Column) -> Column:
    context = F.concat(F.lit("Passage: "), F.coalesce(passage, F.lit("")), F.lit("\nQuestion: "), text, F.lit("\nAnswer:"))
    return item(context, F.array(F.lit(" True"), F.lit(" False")), F.when(answer, 0).otherwise(1))


def two_solutions(goal: Column, one: Column, two: Column, label: Column) -> Column:
    return item(F.concat(F.lit("Question: "), goal, F.lit("\nSolution:")), F.array(one, two), label)


def last_word(text: Column) -> Column:
    """One choice alone, so that accuracy on it is always 1; a text of one word gives none."""
    parts = F.regexp_extract(text, r"(?s)^(.*) ([^ ]*)\z", 1), F.regexp_extract(text, r"(?s)^(.*) ([^ ]*)\z", 2)
    return F.when(F.contains(text, F.lit(" ")), item(F.concat(parts[0], F.lit(" ")), F.array(F.concat(F.lit(" "), parts[1])), F.lit(0)))


def blank(sentence: Column, one: Column, two: Column, answer: Column) -> Column:
    return item(F.replace(sentence, F.lit("_"), F.lit("")), F.array(F.concat(F.lit(" "), one), F.concat(F.lit(" "), two)), F.when(answer == "1", 0).otherwise(1))


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A template with its {placeholders} filled; unknown ones stay."""
    parts = [F.coalesce(fields[p[1:-1]].cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in fields else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")


def word_by_word(sentence: Column, lexicon: dict[str, str]) -> Column:
    """Words looked up without case and the . and , around them; what follows a word stays."""
    known = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair]) if lexicon else F.create_map().cast("map<string,string>")

    def one(w: Column) -> Column:
        bare = F.regexp_replace(w, r"^[.,]+|[.,]+\z", "")
        return F.concat(F.coalesce(F.try_element_at(known, F.lower(bare)), bare), F.substring(w, F.length(bare) + 1, F.length(w)))

    return F.array_join(F.transform(tx.words(sentence), one), " ")


def redacted(config: object) -> object:
    """A configuration with the values of keys that may be secret hidden, at any depth."""
    if isinstance(config, dict):
        return {k: "***REDACTED***" if re.search("key|token|secret|password", str(k).lower()) else redacted(v) for k, v in config.items()}
    return [redacted(v) for v in config] if isinstance(config, list) else config


def reproducibility(config: dict, seed: int, statistics: DataFrame) -> str:
    """JSON of versions, configuration, seed and a one-row frame of statistics."""
    import platform

    import pyspark

    return json.dumps({"python": platform.python_version(), "spark": pyspark.__version__, "seed": seed, "config": redacted(config), "statistics": json.loads(statistics.toJSON().first())}, sort_keys=True)


def latest_checkpoint(df: DataFrame) -> DataFrame:
    """The name with the greatest number after its underscore."""
    return df.agg(F.max_by("name", F.regexp_extract("name", r"_(\d+)", 1).try_cast("long")).alias("name"))


def training_summary(log: DataFrame) -> DataFrame:
    """Steps, tokens per second and iteration times over a log of (step, seconds, tokens)."""
    elapsed = F.sum("seconds")
    return log.agg(F.max("step").alias("total_steps"), F.sum("tokens").alias("tokens_processed"), F.bround(F.sum("tokens") / F.greatest(elapsed, F.lit(1.0)), 1).alias("avg_tokens_per_sec"), F.bround(F.avg("seconds"), 4).alias("avg_iteration_time"), F.min("seconds").alias("min_iteration_time"), F.max("seconds").alias("max_iteration_time"))


def length_statistics(lengths: DataFrame, n: int, sample: int = 1000) -> DataFrame:
    """Average, least, median (the upper one) and most of every k-th row's length, at most about ``sample`` of them."""
    taken = lengths.filter(F.col("seq") % max(1, n // sample) == 0)
    ordered = F.array_sort(F.collect_list("length"))
    return taken.agg(F.avg("length").alias("avg"), F.min("length").alias("least"), F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")).alias("median"), F.max("length").alias("most"))


def random_windows(ids: DataFrame, width: int, per_row: int, seed: int) -> DataFrame:
    """seq, window, ids: ``per_row`` runs of ``width`` tokens of each row that is long enough, places drawn by hash."""
    rows = ids.filter(F.size("ids") >= width).select("seq", "ids", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("window"))
    start = F.pmod(F.xxhash64(F.lit(seed), "seq", "window"), F.size("ids") - width + 1).cast("int") + 1
    return rows.select("seq", "window", F.slice("ids", start, F.lit(width)).alias("ids"))


def previous(df: DataFrame, column: str, *scope: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*scope).orderBy("seq"))
