"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import ASCII_LOWER, Scratch, Whole, by_hot_and_cold, delete, pick, raw_bytes, shared_dir


@F.arrow_udf(BinaryType())
def text_digest(texts: pa.Array) -> pa.Array:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return pa.array([hashlib.sha256((t or b"").translate(ASCII_LOWER)).digest() for t in raw_bytes(texts)], pa.binary())


#: Ids of dropped rows that are broadcast to where the texts lie; beyond this number the texts are shuffled instead.
DROP_BY_BROADCAST = 1_000_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a number for each row."""
    return pick(docs, doc_id="long", text="string").select("doc_id", text_digest("text").alias("digest"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest: digest, keep_id, batch.

    ``append`` deduplicates a batch of documents against the table and within
    itself and adds what is new. New digests are shuffled once, to the
    buckets of the table, and meet it in a sort-merge anti-join for which the
    table itself is not shuffled.

    * Null and empty texts are equal, and are deduplicated like any other.
    * Within a batch the largest ``doc_id`` of a group of equal texts stays
      (null ids come last); of rows that repeat one id, one stays. A text
      that an earlier batch brought goes, whatever its id.
    * Digests bear the name of the batch that brought them. So a batch may be
      repeated, after a failure at any point or without one: it adds what is still
      missing and gives the decisions that it gave, or would have given. Batches of
      one index come one after another.
    * Each batch adds a file to each bucket. A bucket of several files is sorted again
      when read; ``compact`` makes one of them.
    * An empty batch adds nothing and gives no rows.
    * The files lie in ``folder``, by default in the folder that the cluster shares, and never in one of the driver's own.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, folder: str | None = None):
        self.spark, self.table, self.fresh = spark, table, f"{table}__compact"
        self.folder = folder or f"{shared_dir(spark)}/textloom-index"
        if self._exists(self.fresh):  # a compaction was cut short
            if self._exists(table):
                self._remove(self.fresh)
            else:
                spark.sql(f"ALTER TABLE {self.fresh} RENAME TO {table}")
        if self._exists(table):
            self.buckets = next(int(r.data_type) for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Num Buckets")
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._create(table)

    def _exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def _create(self, table: str) -> None:
        path = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _remove(self, table: str) -> None:
        """The table and its files, which a table with a place of its own leaves behind."""
        path = next(r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Location")
        self.spark.sql(f"DROP TABLE {table}")
        delete(self.spark, path)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, entries: DataFrame, table: str) -> None:
        # One task for each bucket: one file for each.
        entries.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The anti-join of digests against the table."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Digests of ``rows`` (doc_id, digest, row) that the table lacks, in the name of ``batch``."""
        scratch = Scratch(self.spark)
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        new = scratch.keep(self.unseen(groups).withColumn("batch", F.lit(batch)))  # what is read isn't what is written to
        self._write(new, self.table)
        scratch.drop(new)

    def decide(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, digest, keep_id, group_size, kept for written ``rows`` whose digests are in the table.

        Kept is one row of each digest that ``batch`` brought (None: any batch).
        """
        scratch = Scratch(self.spark)
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row"))["row"].alias("best"), F.count("*").alias("group_size"))
        found = self.read().hint("merge").join(groups, "digest")
        best = F.col("best") if batch is None else F.when(F.col("batch") == batch, F.col("best"))
        won = scratch.keep(found.select("digest", "keep_id", "group_size", best.alias("best")))
        out = by_hot_and_cold(rows, won, "digest", "group_size")
        out = scratch.keep(out.select("doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("best"), F.lit(False)).alias("kept")))
        scratch.drop(won)
        return out

    def append(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, digest, keep_id, group_size (rows of the batch with this text), kept.

        ``batch`` names the batch, so that it can be repeated; without a name it is a new one.
        """
        batch = batch or uuid.uuid4().hex
        scratch = Scratch(self.spark)
        rows = scratch.keep(digests(docs))
        self.add(rows, batch)
        out = self.decide(rows, batch)
        scratch.drop(rows)
        return out

    def compact(self) -> None:
        """One sorted file for each bucket. If it is cut short, the index is as it was, or as it is then."""
        self._create(self.fresh)
        # As an expression: of the bucketed column itself the shuffle would be left out, and then the bucketed scan too.
        self._write(self.read().withColumn("digest", F.substring("digest", 1, 32)), self.fresh)
        self._remove(self.table)
        self.spark.sql(f"ALTER TABLE {self.fresh} RENAME TO {self.table}")
        self.spark.catalog.refreshTable(self.table)

    def drop(self) -> None:
        if self._exists(self.table):
            self._remove(self.table)


def exact_dedup(spark: SparkSession, docs: DataFrame, batches: int = 2) -> DataFrame:
    """Decisions for all rows of ``docs`` by an index of their own: doc_id, digest, keep_id, group_size, kept.

    The rows go to the index in ``batches`` of about equal size, the largest ids
    first and null ids last: so what a later batch brings meets the digests of
    earlier ones in the anti-join, and the row that stays is that of the largest id.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(digests(docs))
    cuts = rows.approxQuantile("doc_id", [k / batches for k in range(batches - 1, 0, -1)], 0.01)
    part = F.lit(batches - 1)
    for k in range(len(cuts) - 1, -1, -1):
        part = F.when(F.col("doc_id") > int(cuts[k]), k).otherwise(part)
    index = DigestIndex(spark, f"textloom_digests_{uuid.uuid4().hex}")
    try:
        for k in range(batches):
            index.add(rows.filter(part == k), str(k))
        return index.decide(rows)
    finally:
        index.drop()
        scratch.drop(rows)


def keep_one_of_each_text(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are found again by their id: those that go are few as a rule, and then
    their ids go to the texts, not the texts to the ids. Ids that several rows bear are
    rarer still: only those rows' texts are digested once more to tell them apart.
    Null and empty texts are one text; an empty table gives no rows.
    """
    found = exact_dedup(spark, docs)
    often = found.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id")
    out = found.filter("not kept").select(F.col("doc_id").alias("_id")).unionByName(often).distinct()
    whole = Whole(docs, doc_id="long", text="string")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    few = out.limit(DROP_BY_BROADCAST + 1).count() <= DROP_BY_BROADCAST
    once = whole.rows.join(F.broadcast(out) if few else out.hint("merge"), same, "left_anti")
    if often.isEmpty():
        return whole.back(once)
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept_digest"))
    rest = whole.rows.join(often, same, "left_semi").withColumn("_digest", text_digest("text"))
    rest = rest.join(kept, same & (F.col("_digest") == F.col("_kept_digest")), "left_semi").dropDuplicates(["_digest"])
    return whole.back(once.unionByName(rest.drop("_digest")))
