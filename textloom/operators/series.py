"""Running numbers over long series: cells of the order first, then the rows within them, so that no task has a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Tables

#: Rows that a window over neighbours takes at a time.
BLOCK_ROWS = 10_000


def in_cells(df: DataFrame, *order: str) -> DataFrame:
    """``df`` (series, ...) written with _cell: partitions of equal size by range of (series, order), however dense a series is.

    ``order`` must tell the rows of a series apart, or ties may fall to either of two cells.
    """
    spread = df.repartitionByRange("series", *order).withColumn("_cell", F.spark_partition_id())
    return Tables(df.sparkSession).keep(spread)


def _before(*parts: str):
    return Window.partitionBy(*parts[:2]).orderBy(*parts[2:]).rowsBetween(Window.unboundedPreceding, -1)


def running(cells: DataFrame, value: Column, name: str, how, *order: str, first=None) -> DataFrame:
    """``name``: ``how`` (F.sum, F.min, F.max) of ``value`` over the earlier rows of the series; ``first`` where there are none.

    What comes before a cell is an aggregation of cells, of which a series has few.
    """
    combine = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}[how]
    rows = cells.withColumn("_value", value)
    per = Window.partitionBy("series").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("series", "_cell").agg(how("_value").alias("_all")).select("series", "_cell", how("_all").over(per).alias("_base"))
    within = how("_value").over(_before("series", "_cell", *order))
    sums = sums.select(F.col("series").alias("_series"), F.col("_cell").alias("_part"), "_base")
    # Rows without a series are one series.
    out = rows.withColumn("_own", within).join(sums, F.col("series").eqNullSafe(F.col("_series")) & (F.col("_cell") == F.col("_part"))).drop("_series", "_part")
    found = combine(F.col("_base"), F.col("_own"))
    return out.withColumn(name, found if first is None else F.coalesce(found, F.lit(first))).drop("_value", "_own", "_base")


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with _at: the place in its series, from 0."""
    return running(in_cells(df, *order), F.lit(1), "_at", F.sum, *order).withColumn("_at", F.col("_at").cast("long"))


def with_neighbours(rows: DataFrame, before: int) -> DataFrame:
    """Placed rows in blocks (_block) of ``BLOCK_ROWS``, each with the ``before`` rows that come before it (_own is false there)."""
    size = max(BLOCK_ROWS, before)
    block = F.floor(F.col("_at") / size)
    near = (F.col("_at") % size) >= size - before
    both = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_step", F.explode(both)).withColumn("_block", block + F.col("_step")).withColumn("_own", F.col("_step") == 0).drop("_step")
