"""Evaluation and experiment analytics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Tables
from .series import in_cells, placed, running, with_neighbours


def multiple_choice(choices: DataFrame) -> DataFrame:
    """accuracy, mean_loss, perplexity of (example, choice, loss, label): the least loss is chosen, the first of equals."""
    per = choices.groupBy("example").agg(F.min(F.struct("loss", "choice")).alias("best"), F.max("label").alias("label"), F.max(F.when(F.col("choice") == F.col("label"), F.col("loss"))).alias("gold"))
    return per.agg(F.avg((F.col("best.choice") == F.col("label")).cast("double")).alias("accuracy"), F.avg("gold").alias("mean_loss"), F.exp(F.least(F.avg("gold"), F.lit(20.0))).alias("perplexity"))


def weighted_perplexity(windows: DataFrame) -> DataFrame:
    loss = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    return windows.agg(loss.alias("mean_loss"), F.exp(F.least(loss, F.lit(20.0))).alias("perplexity"))


def calibration_bins(scored: DataFrame, n_bins: int = 20) -> DataFrame:
    """bin, n, confidence, accuracy: bins of n // n_bins rows by confidence; the last takes the remainder."""
    total = scored.count()
    size = max(1, total // n_bins)
    # Ranks in two phases: confidence cells first, so that no task sorts everything.
    # Many rows may have one confidence; seq, which orders those, makes cells of them.
    most = max(1, (scored.agg(F.max("seq")).first()[0] or 0) // 256 + 1)
    cells = scored.withColumn("_cell", F.floor(F.col("confidence") * 64))
    whole = F.col("confidence") == 1.0
    cells = cells.withColumn("_sub", F.when(whole, F.floor(F.col("seq") / most)).otherwise(-1))
    base = cells.groupBy("_cell", "_sub").agg(F.count("*").alias("_n")).select("_cell", "_sub", (F.sum("_n").over(Window.orderBy("_cell", "_sub")) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_cell", "_sub").orderBy("confidence", "seq")) - 1
    ranked = cells.withColumn("_place", place).join(F.broadcast(base), ["_cell", "_sub"])
    ranked = ranked.withColumn("bin", F.least(F.floor((F.col("_base") + F.col("_place")) / size), F.lit(n_bins - 1)))
    return ranked.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


#: Values that are added up at a time in a mean over a window.
ADDED = 16


def frame_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, total: np.ndarray | float = 0.0) -> np.ndarray:
    """``total`` and the sums of values[begin:end], in this order: single ones up to a multiple of ``ADDED``, sums of ``ADDED`` (by the same rule), single ones.

    So a sum is rounded in one way wherever its rows lie, and as DuckDB rounds it: a value that is exactly
    the threshold times the mean is then over it or not as the SQL says.
    """
    first, last = -(-begin // ADDED), end // ADDED
    total = total + np.zeros(len(begin))

    def single(start, stop):
        nonlocal total
        for i in range(ADDED - 1):
            at = start + i
            total = np.where(at < stop, total + values[np.minimum(at, len(values) - 1)], total)

    left = np.minimum(first * ADDED, end)
    single(begin, left)
    if (first < last).any():
        whole = values[: len(values) // ADDED * ADDED].reshape(-1, ADDED)
        sums = np.zeros(len(whole))
        for i in range(ADDED):
            sums = sums + whole[:, i]
        total = frame_sums(sums, first, np.maximum(first, last), total)
    single(np.maximum(left, last * ADDED), end)
    return total


def loss_spikes(series: DataFrame, window: int = 100, threshold: float = 2.0) -> DataFrame:
    """spike: the value is over ``threshold`` times the mean of its last ``window`` values; false until there are as many. Rows of one step come in any order."""
    rows = with_neighbours(placed(series, "step"), window - 1)
    columns, aligned = series.columns, ADDED
    while aligned <= window:
        aligned *= ADDED

    def found(block: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        column = block.column("value").combine_chunks().cast(pa.float64())
        none = column.is_null().to_numpy(zero_copy_only=False)
        ahead = block.column("_at")[0].as_py() % aligned
        values = np.concatenate([np.zeros(ahead), np.where(none, 0.0, column.to_numpy(zero_copy_only=False))])
        end = np.arange(ahead, len(values)) + 1
        begin = np.maximum(end - window, ahead)
        counts = np.concatenate([np.zeros(ahead + 1, np.int64), np.cumsum(~none)])
        n = counts[end] - counts[begin]
        mean = frame_sums(values, begin, end) / np.maximum(n, 1)
        full = end - begin == window
        spike = full & (values[ahead:] > threshold * mean)
        made = block.select(columns).append_column("mean", pa.array(mean, mask=n == 0)).append_column("spike", pa.array(spike, mask=full & none))
        return made.filter(block.column("_own"))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in series.dtypes) + ", mean double, spike boolean"
    return rows.groupBy("series", "_block").applyInArrow(found, schema)


def early_stopping(series: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """bad: evaluations since the last improvement, which is a value under the best by more than ``min_delta``; stop: it has reached ``patience``.

    Without a delta the best is a running minimum, made in two phases. With one it depends on the way there, and each series
    streams through one task, in order and in constant memory. Steps differ in a series.
    """
    if not min_delta:
        best = running(placed(series, "step"), F.col("value"), "_best", F.min, "step")
        better = best.withColumn("better", F.coalesce(F.col("value") < F.col("_best"), F.lit(True)))
        last = running(better, F.when(F.col("better"), F.col("_at")), "_last", F.max, "step")
        bad = F.when(F.col("better"), 0).otherwise(F.col("_at") - F.col("_last")).cast("int")
        return last.withColumn("bad", bad).withColumn("stop", F.col("bad") >= patience).select(*series.columns, "better", "bad", "stop")
    at = {name: i for i, name in enumerate(series.columns)}

    def fold(batches):
        here, best, bad = object(), float("inf"), 0
        for b in batches:
            out, better = [], []
            for name, value in zip(b.column(at["series"]).to_pylist(), b.column(at["value"]).to_pylist()):
                if name != here:
                    here, best, bad = name, float("inf"), 0
                improved = value is not None and value < best - min_delta
                best, bad = (value, 0) if improved else (best, bad + 1)
                out.append(bad)
                better.append(improved)
            more = [pa.array(better, pa.bool_()), pa.array(out, pa.int32()), pa.array([n >= patience for n in out], pa.bool_())]
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "better", "bad", "stop"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in series.dtypes) + ", better boolean, bad int, stop boolean"
    return series.repartition("series").sortWithinPartitions("series", "step").mapInArrow(fold, schema)


def growth(series: DataFrame) -> DataFrame:
    """rate: change of value per second since the row before, elapsed time counted as a second at least."""
    order = Window.partitionBy("series", "_block").orderBy("ts", "seq")
    elapsed = F.greatest(F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(order), F.lit(1.0))
    rows = with_neighbours(placed(series, "ts", "seq"), 1).withColumn("rate", (F.col("value") - F.lag("value").over(order)) / elapsed)
    return rows.filter("_own").select(*series.columns, "rate")


def rolling_count(events: DataFrame, seconds: int) -> DataFrame:
    """n_recent: events of the series in the ``seconds`` up to and with each.

    Events up to each moment less those before the moment ``seconds`` earlier: both are running sums over the
    moments of a series, so neither a busy series nor a busy minute is in one task.
    """
    timed = events.withColumn("_t", F.unix_micros("ts"))
    moments = timed.groupBy("series", "_t").agg(F.count("*").alias("_n"))
    asked = moments.select("series", (F.col("_t") - seconds * 1_000_000).alias("_t"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_kind"))
    both = in_cells(asked.unionByName(moments.withColumn("_kind", F.lit(1))), "_t", "_kind")
    sums = Tables(events.sparkSession).keep(running(both, F.col("_n"), "_before", F.sum, "_t", "_kind"))
    upto = sums.filter("_kind = 1").select("series", "_t", (F.col("_before") + F.col("_n")).alias("_upto"))
    low = sums.filter("_kind = 0").select("series", (F.col("_t") + seconds * 1_000_000).alias("_t"), F.col("_before").alias("_low"))
    found = upto.join(low, ["series", "_t"]).select("series", "_t", (F.col("_upto") - F.col("_low")).alias("n_recent"))
    return timed.join(found, ["series", "_t"]).select(*events.columns, "n_recent")


def comparison(results: DataFrame, labels: list[str]) -> DataFrame:
    """benchmark, metric and a column for each label."""
    return results.groupBy("benchmark", "metric").pivot("label", labels).agg(F.first("value"))


def improvement(results: DataFrame, base: str, other: str) -> DataFrame:
    """Percent by which ``other`` is better than ``base``; less is better for perplexities and losses."""
    a = results.filter(F.col("label") == base).select("benchmark", "metric", F.col("value").alias("base"))
    b = results.filter(F.col("label") == other).select("benchmark", "metric", F.col("value").alias("other"))
    sign = F.when(F.col("metric").isin("perplexity", "loss"), -1.0).otherwise(1.0)
    return a.join(b, ["benchmark", "metric"]).withColumn("improvement", sign * 100 * F.try_divide(F.col("other") - F.col("base"), F.abs("base")))


def leaderboard(rows: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """The rows with their rank; what isn't a number comes last in either direction. A board is small by nature."""
    value = F.col(metric).try_cast("double")
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(order, "name")))


def upsert(board: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    return board.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def health(metrics: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """warnings: the messages of the limits that a row passes."""
    return metrics.withColumn("warnings", F.filter(F.array(*[F.when(F.col(c) > most, F.lit(message)) for c, (most, message) in limits.items()]), lambda x: x.isNotNull()))
