"""First-seen rows by a key that any share of the rows may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Tables, by_size


def first_of_keys(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """seq and duplicate for (seq, k): an earlier row has the key; rows with a null key are none's duplicates.

    The first of each key comes from an aggregation. It joins back by the size of
    the key, so that one that half the rows share lands in no single task.
    """
    tables = Tables(spark)
    rows = tables.keep(keyed.select("seq", "k"))
    groups = tables.keep(rows.filter("k IS NOT NULL").groupBy("k").agg(F.min("seq").alias("first"), F.count("*").alias("n")))
    known = by_size(rows, groups, "k", "n").select("seq", (F.col("seq") != F.col("first")).alias("duplicate"))
    return known.unionByName(rows.filter("k IS NULL").select("seq", F.lit(False).alias("duplicate")))


def scoped(key: Column, *scope: str) -> Column:
    """One key of a key and its scope; null counts as a value of a scope, not of a key."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in scope]
    return F.when(key.isNotNull(), F.sha2(F.to_json(F.array(*parts, key.cast("string"))), 256)) if scope else key


def first_by_key(df: DataFrame, key: Column, *scope: str) -> DataFrame:
    """``df`` with ``duplicate``: an earlier row (by seq, which is unique) of the same scope has the key.

    Only seq and the key take part in finding it (see ``first_of_keys``).
    """
    found = first_of_keys(df.sparkSession, df.select("seq", scoped(key, *scope).alias("k")))
    return df.join(found, "seq").select(*df.columns, "duplicate")
