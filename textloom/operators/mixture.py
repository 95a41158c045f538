"""Mixtures of sources, shuffles, shards, samples and corpus statistics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from .dedup import quota


def union(frames: dict[str, DataFrame], quotas: dict[str, int] | None = None) -> DataFrame:
    """source, seq, text of all frames, each up to its quota in its own order."""
    parts = []
    for rank, (name, df) in enumerate(frames.items()):
        df = df.select(F.lit(name).alias("source"), F.lit(rank).alias("source_rank"), "seq", "text")
        n = (quotas or {}).get(name)
        parts.append(df if n is None else df.orderBy("seq").limit(n))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shuffle_key(seed: int, *columns: str) -> Column:
    """A hash that orders rows at random, the same way in each run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def numbered(df: DataFrame, cells: int = 256, seed: int = 42, *columns: str) -> DataFrame:
    """``df`` with pos (0, 1, ...) in shuffled order, in two phases: counts per hash cell, then places within each.

    The cells are leading digits of the hash: no task sorts everything.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, *columns)).withColumn("_cell", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") * cells / 65536).cast("int"))
    sizes = keyed.groupBy("_cell").agg(F.count("*").alias("_n"))
    base = sizes.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_base"))  # at most ``cells`` rows
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_key", *columns)) - 1
    return keyed.withColumn("_place", place).join(F.broadcast(base), "_cell").withColumn("pos", F.col("_base") + F.col("_place")).drop("_key", "_cell", "_place", "_base")


def shards(numbered_df: DataFrame, n: int) -> DataFrame:
    """shard, of size max(1, n // 10) each; so there are ten where ten divides n, else more."""
    return numbered_df.withColumn("shard", F.floor(F.col("pos") / max(1, n // 10)).cast("int"))


def source_statistics(df: DataFrame) -> DataFrame:
    """Documents, characters, estimated tokens by source and in all (source null), by grouping sets in one pass."""
    n = F.length("text")
    return df.rollup("source").agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.sum(F.greatest(F.lit(1), F.floor(n / 4))).alias("tokens"), F.bround(F.avg(n), 1).alias("avg_chars"), F.grouping("source").cast("int").alias("all_sources"))


def corpus_metadata(df: DataFrame) -> DataFrame:
    n, w = F.sum(F.length("text")), F.sum(F.size(tx.words(F.col("text"))))
    return df.agg(F.count("*").alias("docs"), n.alias("chars"), w.alias("words"), F.floor(n / 4).alias("tokens"), F.bround(n / F.count("*"), 0).cast("long").alias("avg_chars"), F.bround(w / F.count("*"), 0).cast("long").alias("avg_words"))


def context_bucket(tokens: Column) -> Column:
    return functools.reduce(lambda c, n: c.when(tokens <= n, str(n)), lex.CONTEXT_LENGTHS[1:], F.when(tokens <= lex.CONTEXT_LENGTHS[0], str(lex.CONTEXT_LENGTHS[0]))).otherwise(f">{lex.CONTEXT_LENGTHS[-1]}")


def by_dimension(df: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, docs, tokens for each of several dimensions in one pass (grouping sets)."""
    return df.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("_g")).select(
        functools.reduce(lambda c, i: c.when(F.col("_g") == (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)), F.lit(dimensions[i])), range(1, len(dimensions)), F.when(F.col("_g") == (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1)), F.lit(dimensions[0]))).alias("dimension"),
        F.coalesce(*[F.col(d).cast("string") for d in dimensions]).alias("value"), "docs", "tokens",
    )


def build_stats(df: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, docs, mean_quality of the kept rows (reason is null) of (quality, reason, ...), in all and by each dimension; of the others docs by reason.

    One pass: each row counts in a group for each dimension, and tasks add up before anything is shuffled.
    """
    group = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
    own = F.array(group("total", F.lit("all")), *[group(d, F.col(d)) for d in dimensions])
    rows = df.select("quality", F.col("reason").isNull().alias("kept"), F.explode(F.when(F.col("reason").isNull(), own).otherwise(F.array(group("reason", F.col("reason"))))).alias("g"))
    return rows.groupBy("g.dimension", "g.value").agg(F.count("*").alias("docs"), F.avg(F.when(F.col("kept"), F.col("quality"))).alias("mean_quality"))


def bottom_k(df: DataFrame, k: int, seed: int, *columns: str) -> DataFrame:
    """A sample of k rows: those with the least hashes."""
    return df.withColumn("_key", shuffle_key(seed, *columns)).orderBy("_key", *columns).limit(k).drop("_key")


def split_train_validation(numbered_df: DataFrame, n: int, fraction: float) -> DataFrame:
    return numbered_df.withColumn("split", F.when(F.col("pos") < int(n * fraction), "val").otherwise("train"))


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return plan.join(done, key, "left_anti")


def routed(items: DataFrame, by_task: DataFrame, by_domain: DataFrame, default: str) -> DataFrame:
    """teacher: the task's override, else the domain's route, else the default. Both routes are configuration."""
    routes = items.join(F.broadcast(by_task.withColumnRenamed("teacher", "_t")), "task_type", "left").join(F.broadcast(by_domain.withColumnRenamed("teacher", "_d")), "domain", "left")
    return routes.withColumn("teacher", F.coalesce("_t", "_d", F.lit(default))).drop("_t", "_d")


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The name in whose share of [0, 1) u falls."""
    total, upto, chosen = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        upto += weights[name] / total
        chosen = (F.when if chosen is None else chosen.when)(u < upto, name)
    return chosen.otherwise(names[-1]) if chosen is not None else F.lit(names[-1])

