"""How sources differ from their language and from each other, by exact integer arithmetic on term counts."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BROADCAST_ROWS, Scratch, lean, pick, raw_bytes

#: A term is a run of ASCII letters and of bytes beyond ASCII; here all else becomes a space, and A-Z lower case.
TERMS = bytes(ASCII_LOWER[c] if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
#: Entries of the tables that a counting task holds before it hands them on.
HELD = 500_000
#: Buckets of counts to an octave.
BUCKETS = 4
#: The first wave of the term search takes k rows at least; the growth from wave to wave.
GROWTH = 8
#: Parts of a language where its groups are too many to be broadcast.
SALT = 64


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); and a row with a null term for each group seen."""

    def count(batches):
        held: dict[tuple, tuple] = {}
        names = ["lang", "source", "term", "n", "d"]

        def rows():
            """A batch for each group: its terms, and one without a term."""
            for (lang, source), (n, d) in held.items():
                size = len(n) + 1
                terms, docs = pa.array([*n, None], pa.binary()), pa.array([*map(d.__getitem__, n), 0], pa.int64())
                columns = [pa.repeat(pa.scalar(x, pa.binary()), size) for x in (lang, source)]
                yield pa.record_batch([*columns, terms, pa.array([*n.values(), 0], pa.int64()), docs], names=names)
            held.clear()

        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for text, lang, source in zip(*[raw_bytes(part.column(k)) for k in range(3)]):
                    group = held.get((lang, source))
                    if group is None:
                        group = held[lang, source] = (collections.Counter(), collections.Counter())
                    terms, before = (text or b"").translate(TERMS).split(), len(group[0])
                    group[0].update(terms)
                    group[1].update(set(terms))
                    size += len(group[0]) - before
                    if size >= HELD:
                        yield from rows()
                        size = 0
        yield from rows()

    kinds = "lang binary, source binary, term binary, n long, d long"
    found = docs.mapInArrow(lean(count), kinds)
    return found.select(*[F.col(c).cast("string") for c in ("lang", "source", "term")], "n", "d")


def smoothed(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for counts of any size; null where there are no terms."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 2)
    below = total.cast("decimal(20,0)") + 2 * terms.cast("decimal(18,0)")
    return 1 + F.call_function("div", above, F.nullif(below, F.lit(0)))


def difference(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q))"""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


class Divergence:
    """Counts of the kept terms of each group (lang, source), and what divides the groups.

    Texts are read once. Tasks count terms by group and hand on partial counts, so a
    hot source or term has a few rows from each task. The counts of a term in the
    groups of its language are its postings: one list, no longer than the language's sources
    are many. (The result has a row for each pair of sources of a language, so it is the longer one.)
    Groups are sent to rows by broadcast up to a checked number, by a merge join beyond it.

    Null texts, languages and sources are ''. Null and repeated ids don't matter; each row is a document
    of its own. Very long texts are counted by one task each. Ties go by the item's UTF-8 bytes. A
    language without kept terms has pairs of value 0 and no terms. An empty table gives no rows.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, least_docs: int = 10):
        self.spark, self.scratch = spark, Scratch(spark)
        keep = self.scratch.keep
        rows = pick(docs, text="string", lang="string", source="string")
        rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])
        counted = keep(count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
        lists = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("own"))
        self.kept = keep(lists.filter(F.col("d") >= least_docs).drop("d"))
        self.posts = self.kept.select("lang", "term", "n_lang", F.inline("own"))
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
        own = self.posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counted.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        groups = groups.withColumn("p0", smoothed(F.lit(0), "total", "v"))
        self.groups = keep(groups)
        self.few = self.groups.count() <= BROADCAST_ROWS
        scored = self._with_groups(self.posts, self.groups, ["lang", "source"]).withColumn("p", smoothed("n", "total", "v"))
        scored = scored.withColumn("bucket", F.floor(BUCKETS * F.log2("n")).cast("int"))
        self.scored = keep(scored.select("lang", "source", "term", "n", "bucket", "p", "p0", smoothed("n_lang", "total_lang", "v").alias("q")))

    def _with_groups(self, rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(F.broadcast(groups) if self.few else groups.hint("merge"), keys)

    def _with_each_of_the_language(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Each row with each group of its language."""
        if self.few:
            return rows.join(F.broadcast(groups), "lang")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)))
        groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        return rows.join(groups.hint("merge"), ["lang", "salt"]).drop("salt")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value, rank.

        Most terms don't occur in most sources. With f(0, 0) for each kept term as a start, a source's
        terms add what they differ by from it against a source that lacks them (by counts, of which there are few), and postings
        add, for two sources that both have a term, what then still differs.
        """
        others = self.groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        start = self._with_each_of_the_language(self.groups.select("lang", "source", "p0", "v"), others).filter("source != item")
        start = start.select("lang", "source", "item", F.coalesce(F.col("v") * difference("p0", "q0"), F.lit(0)).alias("value"))
        counts = self.scored.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
        alone = self._with_each_of_the_language(counts, others).filter("source != item")
        alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (difference("p", "q0") - difference("p0", "q0"))).alias("value"))
        both = self.scored.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("own")).filter("size(own) > 1")
        both = both.select("lang", "own").mapInArrow(lean(posted_pairs), "lang string, source string, item string, value long")
        halves = alone.unionByName(both)
        turned = halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        found = start.unionByName(halves).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    def terms(self, k: int = 10) -> DataFrame:
        """lang, source, item (a term), value, rank up to ``k``: the terms by which a source is furthest above its language.

        f grows with p and falls with q while p > q. So the greatest count of a bucket of counts and
        the least lang probability in it bound the bucket's values. Buckets are taken from the highest bound
        down, in growing waves; a group is done when the bounds of all that it hasn't seen are
        strictly below its k-th value.
        """
        buckets = self.scored.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("rows"))
        best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.filter("p > q").withColumn("bound", difference("p", "q"))
        buckets = self.scratch.keep(buckets.withColumn("before", F.coalesce(F.sum("rows").over(best_first), F.lit(0))).select("lang", "source", "bucket", "bound", "before"))
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        found, low, high = None, 0, k
        while True:
            left = buckets.filter(F.col("before") >= low)
            if found is not None:
                kth = found.groupBy("lang", "source").agg(F.min(F.when(F.col("rank") == k, F.col("value"))).alias("kth"))
                left = left.join(kth, ["lang", "source"], "left").filter("kth IS NULL OR bound >= kth").drop("kth")
            if left.isEmpty():
                break
            wave = left.filter(F.col("before") < high).select("lang", "source", "bucket")
            seen = self._with_groups(self.scored, wave, ["lang", "source", "bucket"]).filter("p > q").select("lang", "source", "term", difference("p", "q").alias("value"))
            seen = seen if found is None else seen.unionByName(found.drop("rank"))
            found = self.scratch.keep(seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
            low, high = high, high * GROWTH
        if found is None:
            return self.groups.limit(0).select("lang", "source", F.col("source").alias("item"), F.col("total").alias("value"), F.lit(0).alias("rank"))
        return found.withColumnRenamed("term", "item")


def posted_pairs(batches):
    """Of postings, the sum over terms for each two sources that share them."""

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    for batch in batches:
        lists = batch.column(1)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        term = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        own = lists.flatten()
        source, p, p0 = own.field("source").dictionary_encode(), own.field("p").to_numpy(), own.field("p0").to_numpy()
        lang = batch.column(0).dictionary_encode()
        many = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64)[term] * many + source.indices.to_numpy()
        alls = len(lang.dictionary) * many
        keys, sums, size = [], [], 0

        def merged():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            value = np.zeros(len(key), dtype=np.int64)
            np.add.at(value, at, np.concatenate(sums))
            return [key], [value]

        for lag in range(1, int(lists.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))):
            i = np.flatnonzero(term[lag:] == term[:-lag])
            j = i + lag
            key = np.minimum(group[i], group[j]) * alls + np.maximum(group[i], group[j])
            keys.append(key)
            sums.append(f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j]))
            size += len(key)
            if size > 2_000_000:
                keys, sums = merged()
                size = len(keys[0])
        if keys:
            (key,), (value,) = merged()
            a, b = key // alls, key % alls
            names, langs = source.dictionary, lang.dictionary
            yield pa.record_batch([langs.take(pa.array(a // many)), names.take(pa.array(a % many)), names.take(pa.array(b % many)), pa.array(value)], names=["lang", "source", "item", "value"])


def source_divergence(spark: SparkSession, docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see ``Divergence``."""
    found = Divergence(spark, docs, least_docs)
    parts = [rows.withColumn("part", F.lit(part)) for part, rows in (("pair", found.pairs()), ("term", found.terms(k)))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
