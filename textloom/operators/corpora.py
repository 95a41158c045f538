"""Putting corpora together: configurations, quotas, caches, merges, and reports that add up."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable
from typing import Any, TypeVar

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, SparkRuntimeException, UnknownException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixture import bottom_k, numbered

C = TypeVar("C")


# Configuration


def configured(kind: type[C], values: dict[str, Any]) -> C:
    """A (nested) dataclass from a mapping, as YAML gives it; keys that it doesn't know are dropped."""
    given = {}
    for field in dataclasses.fields(kind):
        if field.name in values:
            value = values[field.name]
            inner = field.default_factory if field.default_factory is not dataclasses.MISSING and dataclasses.is_dataclass(field.default_factory) else None
            given[field.name] = configured(inner, value) if inner and isinstance(value, dict) else value
    return kind(**given)


def config_hash(*parts: object) -> str:
    """Twelve hexadecimal digits that name a configuration."""
    import hashlib

    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12]


def resolved(catalog: DataFrame, overrides: DataFrame, names: list[str]) -> DataFrame:
    """The named rows of a catalog (name, ...) in that order, with what ``overrides`` (name and some columns) says instead.

    Both are configuration. A name that the catalog lacks is an error.
    """
    known = {r.name for r in catalog.select("name").collect()}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"not in the catalog: {', '.join(unknown)}")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    changed = [c for c in catalog.columns if c != "name" and c in overrides.columns]
    o = overrides.select("name", *[F.col(c).alias(f"_{c}") for c in changed])
    rows = catalog.withColumn("place", place).filter("place > 0").join(F.broadcast(o), "name", "left")
    return rows.select("place", *[F.coalesce(f"_{c}", c).alias(c) if c in changed else c for c in catalog.columns])


# Sources


def unreadable(e: Exception) -> bool:
    """Whether an error says that a source can't be read: one of files, networks or Spark's readers. Mistakes in a reader's own code aren't such, a column that isn't there included."""
    if isinstance(e, AnalysisException):
        return not (e.getCondition() or "").startswith("UNRESOLVED")
    return isinstance(e, OSError | Py4JError | SparkRuntimeException | UnknownException)


def shared_quota(parts: dict[str, Callable[[], DataFrame]], quota: int, skipped: dict[str, Exception] | None = None) -> DataFrame:
    """config, seq and the other columns of several configurations of one source, ``quota`` rows in all, in order.

    A configuration that can't be read is left out, and ``skipped`` gets its name and error. Rows are numbered in two phases: by what each cell holds, then within.
    """
    frames = []
    for rank, (name, read) in enumerate(parts.items()):
        try:
            frames.append(read().select(F.lit(rank).alias("_rank"), F.lit(name).alias("config"), "*"))
        except Exception as e:
            if not unreadable(e):
                raise
            if skipped is not None:
                skipped[name] = e
    if not frames:
        raise ValueError("no configuration can be read")
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return first_rows(both, quota, "_rank", "seq").drop("_rank")


def first_rows(df: DataFrame, n: int, group: str, order: str, cell_rows: int = 20_000) -> DataFrame:
    """The first n rows by (group, order), order being numbers, without a task that sorts or holds n rows."""
    from pyspark.sql import Window

    cell = F.floor(F.col(order) / cell_rows)
    cells = df.groupBy(group, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    base = cells.withColumn("_base", F.sum("_n").over(Window.orderBy(group, "_cell")) - F.col("_n")).filter(F.col("_base") < n).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(order))
    return df.withColumn("_cell", cell).join(base, [group, "_cell"]).withColumn("_place", F.col("_base") + place).filter(F.col("_place") <= n).drop("_cell", "_base", "_place")


def cached(spark: SparkSession, path: str, read: Callable[[], DataFrame], fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """What ``path`` holds; if that is nothing, the source's rows, or else the fallback's, which are then written there."""

    def held() -> DataFrame | None:
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no such folder, or no files in it
                raise
            return None
        return None if df.isEmpty() else df

    found = held()
    if found is None:
        source_or(read, fallback).write.mode("overwrite").parquet(path)
        found = held()
    return found if found is not None else spark.read.parquet(path)


def source_or(read: Callable[[], DataFrame], fallback: Callable[[], DataFrame] | None) -> DataFrame:
    """The source's rows; the fallback's if it can't be read or has none."""
    try:
        df = read()
        if fallback is None or not df.isEmpty():
            return df
    except Exception as e:
        if fallback is None or not unreadable(e):
            raise
    return fallback()


# Merges


def with_anchor(corpus: DataFrame, anchor: DataFrame, label: str) -> DataFrame:
    """An anchor corpus (seq, text), under a source name of its own, after the corpus (source, seq, text, pos): not shuffled in."""
    first = corpus.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_first"))
    placed = numbered_in_order(anchor).join(F.broadcast(first))
    return corpus.select("source", "seq", "text", "pos").unionByName(placed.select(F.lit(label).alias("source"), "seq", "text", (F.col("_first") + F.col("place")).alias("pos")))


def numbered_in_order(df: DataFrame) -> DataFrame:
    """``df`` (seq, ...) with place 0, 1, ... by seq."""
    from .tokens import offsets

    return offsets(df.withColumn("_one", F.lit(1)), "_one").withColumnRenamed("start", "place").drop("_one")


def merged_and_reshuffled(corpus: DataFrame, more: DataFrame, seed: int = 42) -> DataFrame:
    """Both corpora (source, seq, text) in one new order. Cells of about 20,000 rows are what a task sorts."""
    both = corpus.select("source", "seq", "text").unionByName(more.select("source", "seq", "text"))
    return numbered(both, cells_for(both), seed, "source", "seq")


def cells_for(df: DataFrame, rows: int = 20_000) -> int:
    return min(1 << 16, max(1, -(-df.count() // rows)))


def rewritten(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A Parquet corpus replaced by what ``change`` makes of it: written beside it, then put in its place.

    The old one stays under another name until the new one is there, so a run that is cut short loses neither.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    path = path.rstrip("/")
    store = at(path).getFileSystem(conf)
    new, old = f"{path}.new", f"{path}.old"
    if not store.exists(at(path)) and store.exists(at(old)):  # cut short between the two renames
        store.rename(at(old), at(path))
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(new)
    store.delete(at(old), True)
    store.rename(at(path), at(old))
    store.rename(at(new), at(path))
    store.delete(at(old), True)
    return spark.read.parquet(path)


def reservoir(df: DataFrame, k: int, seed: int, *columns: str) -> DataFrame:
    """An even sample of k rows in one pass, the same in each run: each task keeps its k least hashes."""
    return bottom_k(df, k, seed, *columns)


# Numbers


def by_source(rows: DataFrame, kept: Column) -> DataFrame:
    """source, got, kept, seconds (from first to last ``ts``) of (source, ts)."""
    seconds = F.max(F.col("ts").cast("double")) - F.min(F.col("ts").cast("double"))
    return rows.groupBy("source").agg(F.count("*").alias("got"), F.count_if(kept).alias("kept"), seconds.alias("seconds"))


def merged_statistics(parts: DataFrame) -> DataFrame:
    """One row: the sums of all counters of partial rows. Sums of sums, so parts may be merged in any grouping."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c, kind in parts.dtypes if kind in ("int", "bigint", "double")])


def merged_reports(reports: DataFrame) -> DataFrame:
    """total, kept, removed, removed_pct, reasons (most frequent first) of reports (total, kept, reasons: map of counts)."""
    counts = reports.select(F.explode("reasons").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason"))), lambda x: F.struct(x["reason"].alias("reason"), (-x["m"]).alias("n")))
    total, kept = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kept"), F.lit(0))
    sums = reports.agg(total.alias("total"), kept.alias("kept"))
    pct = F.bround(100 * (F.col("total") - F.col("kept")) / F.greatest(F.col("total"), F.lit(1)), 2)
    return sums.join(F.broadcast(counts.agg(ordered.alias("reasons")))).select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"), pct.alias("removed_pct"), "reasons")


def validation(batches: DataFrame) -> DataFrame:
    """loss, accuracy and perplexity of (loss, n_valid, n_correct), each batch weighing as many tokens as it judges."""
    n = F.sum("n_valid")
    loss = F.try_divide(F.sum(F.col("loss") * F.col("n_valid")), n)
    return batches.agg(loss.alias("loss"), F.try_divide(F.sum("n_correct"), n).alias("accuracy"), F.exp(F.least(loss, F.lit(20.0))).alias("perplexity"))


def humanized(size: int) -> str:
    """Bytes in the largest unit of which there is one."""
    amount = float(size)
    for unit in ("B", "KB", "MB", "GB"):
        if amount < 1024:
            return f"{amount:.1f} {unit}"
        amount /= 1024
    return f"{amount:.1f} TB"


def folder_size(spark: SparkSession, path: str) -> int:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()


def report_text(report: DataFrame) -> str:
    """The one row of ``merged_reports`` for people to read."""
    r = report.first()
    lines = [f"documents  {r.total:>12,}", f"kept       {r.kept:>12,}", f"removed    {r.removed:>12,}  ({r.removed_pct:.2f} %)"]
    return "\n".join([*lines, *(f"  {x.reason:<40} {x.n:>12,}" for x in r.reasons)])


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (``most`` rows at most: a report's own limit)."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    table = [rows.columns, ["-"] * len(rows.columns), *([show(v) for v in r] for r in rows.limit(most).collect())]
    return "\n".join(f"| {' | '.join(r)} |" for r in table)
