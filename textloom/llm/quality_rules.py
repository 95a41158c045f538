"""Rules on text statistics, and robust multivariate outliers among what passes them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, WordHashes, hashed_words, pick, raw_bytes, window_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))  # continuation bytes are no code points of their own
SHINGLE = 5
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

#: Coordinates of the statistic vector, and the least standard deviation each is given: most documents
#: have no symbols and no repetition at all, and a spread of 0 would make any a cause for rejection, even
#: one line that comes twice.
VECTOR = {
    "x0": ("ln(1 + n_words)", 0.3),
    "x1": ("ln(greatest(word_chars, 1) / n_words)", 0.15),
    "x2": ("sqrt(n_symbols / n_words)", 0.1),
    "x3": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.15),
    "x4": ("sqrt(n_repeat_words / n_words)", 0.15),
}
DIM = len(VECTOR)


def count_text(text: bytes, table: WordHashes) -> tuple:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    n = len(words)
    repeated = 0
    if n > SHINGLE:
        h = window_hashes(hashed_words(words, table), SHINGLE)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            twice = np.zeros(len(h), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(n + 1, dtype=np.int32)
            starts = np.flatnonzero(twice)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + SHINGLE, -1)
            repeated = int((np.cumsum(step)[:n] > 0).sum())
    return n, len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def text_statistics(docs: DataFrame) -> DataFrame:
    """A row of STATS for each document; null text has no words."""

    def count(batches):
        table = WordHashes()
        for b in batches:
            rows = [count_text(t or b"", table) for t in raw_bytes(b.column(3))]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *columns], names=[x.split()[0] for x in STATS.split(", ")])

    return pick(docs, doc_id="long", lang="string", source="string", text="string").mapInArrow(count, STATS)


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _distance(params_prefix: str = "p") -> F.Column:
    """Squared Mahalanobis distance from the columns m (centre) and w (upper triangle of the inverse)."""
    total, k = F.lit(0.0), 0
    for i in range(DIM):
        for j in range(i, DIM):
            term = (F.col(f"x{i}") - F.col("m")[i]) * (F.col(f"x{j}") - F.col("m")[j]) * F.col("w")[k]
            total, k = total + (term if i == j else 2.0 * term), k + 1
    return total


def _solve(scale: float):
    """Moments of each group and start -> centre, inverse covariance and log determinant, for as many as there are."""
    floors = np.array([floor for _, floor in VECTOR.values()])

    def solve(frames):
        for f in frames:
            centres, inverses, sizes = [], [], []
            for row in f.itertuples(index=False):
                mean = np.array([getattr(row, f"s{i}") for i in range(DIM)]) / row.n
                cov = np.empty((DIM, DIM))
                for i in range(DIM):
                    for j in range(i, DIM):
                        cov[i, j] = cov[j, i] = getattr(row, f"s{i}{j}") / row.n - mean[i] * mean[j]
                cov = cov * scale + np.diag(floors**2)
                inverse = np.linalg.inv(cov)
                sizes.append(np.linalg.slogdet(cov)[1])
                centres.append(mean.tolist())
                inverses.append([inverse[i, j] for i in range(DIM) for j in range(i, DIM)])
            yield pd.DataFrame({"g": f["g"], "k": f["k"], "m": centres, "w": inverses, "size": sizes})

    return solve


def few(df: DataFrame) -> DataFrame:
    """A table of a row per group, to be broadcast if its rows are as few as they should be."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _estimate(scratch: Scratch, near: DataFrame, share: float) -> DataFrame:
    """g, k, m, w, size from the rows nearest; for normal data their covariance is too small by the factor ``scale``."""
    names = list(VECTOR)
    scale = share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)
    moments = near.groupBy("g", "k").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}{j}") for i in range(DIM) for j in range(i, DIM)])
    return scratch.keep(moments.mapInPandas(_solve(scale), "g string, k int, m array<double>, w array<double>, size double"))


def mcd_estimates(scratch: Scratch, x: DataFrame, support: float, least_rows: int, first_steps: int = 2, most_steps: int = 20, least_fall: float = 1e-4) -> DataFrame:
    """g, k (start), m (centre), w (inverse covariance), size (log determinant) for each group of written rows ``x`` (g, x0 ...).

    Four starts: the coordinate-wise median with the median deviations, or with
    the least deviations, and the first and the third quartile with the median deviations from them. A concentration
    step takes the ``support`` share of a group's rows that lie nearest and
    estimates anew, by one aggregation for those rows' bound and one for the moments,
    over all rows. After ``first_steps`` the start with the lowest determinant goes
    on for each group, until no group's falls by ``least_fall`` (in the logarithm) any more;
    ``most_steps`` bounds the time, steps being few as a rule. Of a group's estimates the one with the lowest
    determinant is given.
    """
    names = list(VECTOR)
    floors = [floor for _, floor in VECTOR.values()]
    quartile = lambda p: F.array(*[F.percentile_approx(c, p) for c in names])
    middle = x.groupBy("g").agg(F.count("*").alias("n"), *[quartile(p).alias(f"m{i}") for i, p in enumerate((0.5, 0.25, 0.75))]).filter(F.col("n") >= least_rows)
    start = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(m).alias("m")) for k, m in enumerate(("m0", "m0", "m1", "m2"))]))
    starts = scratch.keep(middle.select("g", start.alias("start")).select("g", "start.*"))
    spread = x.join(few(starts), "g").groupBy("g", "k", "m").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col("m")[i]), 0.5).alias(f"d{i}") for i, c in enumerate(names)])
    deviation = lambda i: F.when(F.col("k") == 1, 0.0).otherwise(F.col(f"d{i}") * 1.4826)
    diagonal = [(1 / (F.pow(deviation(i), 2) + floors[i] ** 2)) if i == j else F.lit(0.0) for i in range(DIM) for j in range(i, DIM)]
    params = scratch.keep(spread.select("g", "k", "m", F.array(*diagonal).alias("w")))

    def step(params: DataFrame) -> DataFrame:
        d = x.join(few(params.select("g", "k", "m", "w")), "g").withColumn("d2", _distance())
        bound = scratch.keep(d.groupBy("g", "k").agg(F.percentile_approx("d2", support).alias("bound")))
        return _estimate(scratch, d.join(few(bound), ["g", "k"]).filter("d2 <= bound"), support)

    def least(params: DataFrame) -> DataFrame:
        return scratch.keep(params.groupBy("g").agg(F.min(F.struct("size", "k", "m", "w")).alias("b")).select("g", "b.k", "b.m", "b.w", "b.size"))

    for _ in range(first_steps):
        params = step(params)
    best = least(params)
    for _ in range(most_steps):
        better = least(best.unionByName(step(best)))
        fell = better.join(best.select("g", F.col("size").alias("was")), "g").agg(F.max(F.col("was") - F.col("size"))).first()[0]
        best = better
        if fell is None or fell < least_fall:
            break
    return best


def robust_outliers(spark: SparkSession, stats: DataFrame, support: float = 0.53, quantile: float = 0.99999, least_rows: int = 100, reweighted: float = 0.975, **steps) -> DataFrame:
    """``stats`` with d2 (null where no estimate was made) and outlier.

    Minimum-covariance-determinant estimates for each language and source (see
    ``mcd_estimates``); all rows within an estimate's ``reweighted`` quantile make the last one. ``support`` is
    at least (n + dimensions + 1) / 2n from 100 rows on, so nearly half a
    group's rows may be junk.
    Groups of under ``least_rows`` rows are pooled by language, and what is
    then still small in one rest; where even that is smaller, nothing is an outlier.
    """
    scratch = Scratch(spark)
    x = stats
    for name, (sql, _) in VECTOR.items():
        x = x.withColumn(name, F.expr(sql))
    by_pair = x.groupBy("lang", "source").agg(F.count("*").alias("n_pair"))
    by_pair = by_pair.withColumn("small", F.col("n_pair") < least_rows)
    pool = by_pair.filter("small").groupBy("lang").agg(F.sum("n_pair").alias("n_pool")).withColumnRenamed("lang", "pool_lang")
    named = by_pair.join(pool, by_pair["lang"].eqNullSafe(pool["pool_lang"]), "left")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    named = named.select(
        F.col("lang").alias("_l"),
        F.col("source").alias("_s"),
        F.when(~F.col("small"), F.to_json(F.struct(text("lang").alias("l"), text("source").alias("s")))).when(F.col("n_pool") >= least_rows, F.to_json(F.struct(text("lang").alias("l")))).otherwise("rest").alias("g"),
    )
    named = scratch.keep(named)
    x = scratch.keep(x.join(few(named), x["lang"].eqNullSafe(F.col("_l")) & x["source"].eqNullSafe(F.col("_s"))).drop("_l", "_s"))
    best = mcd_estimates(scratch, x, support, least_rows, **steps)
    within = x.join(few(best.drop("size")), "g").withColumn("d2", _distance()).filter(F.col("d2") <= chi2_quantile(reweighted, DIM))
    params = _estimate(scratch, within, reweighted).drop("k", "size")
    out = x.join(few(params), "g", "left").withColumn("d2", _distance())
    return out.withColumn("outlier", F.coalesce(F.col("d2") > chi2_quantile(quantile, DIM), F.lit(False)))


def quality_rules(spark: SparkSession, docs: DataFrame, least_words: int = 10, most_repeated: int = 20, **outliers) -> DataFrame:
    """Statistics, base_failed and kept for each row of ``docs``.

    Base rules: fewer than ``least_words`` words, or over ``most_repeated``
    percent of the words in repeated 5-word windows. The estimates and their
    verdict are for what passes those. Null and empty texts have no words and
    fail; null languages and sources are groups like any other; rows may
    repeat and each counts. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    stats = scratch.keep(text_statistics(docs).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))))
    passed = robust_outliers(spark, stats.filter("not base_failed"), **outliers)
    columns = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = passed.select(*columns, (~F.col("outlier")).alias("kept"), "d2")
    failed = stats.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    return judged.unionByName(failed)
