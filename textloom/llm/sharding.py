"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, Whole, pick

#: Children of a node of the tree by which the matrix is drawn, as a power of two.
FAN_OUT_BITS = 6
#: Rows of a shard that one window orders.
CELL_ROWS = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls, taken without return, are of the ``good`` ones.

    By inversion over the probabilities around the mode; the ratio of neighbours gives
    them at any size. What lies outside of the window is below the resolution of a double.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    width = 40 + int(12 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))))
    low, high = max(low, mode - width), min(high, mode + width)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def split(rng: np.random.Generator, counts: list[int], sizes: list[int]) -> list[list[int]]:
    """``counts`` balls of each colour dealt at random to urns of ``sizes``, which hold all of them."""
    left, out = list(counts), []
    for size in sizes[:-1]:
        rest, drawn = sum(left), []
        for have in left:
            rest -= have
            drawn.append(hypergeometric(rng, have, rest, size))
            size -= drawn[-1]
        left = [have - x for have, x in zip(left, drawn)]
        out.append(drawn)
    return [*out, left]


class Sharding:
    """Every row in one of ``shards`` shards, all arrangements alike likely, shard sizes at most one apart.

    1. The rows, as they lie in the input's partitions, are written with a random place in
       their partition (the local permutation). A task holds 24 bytes for each row of its partition.
    2. The communication matrix says how many rows each partition sends to each shard. Its law is multivariate
       hypergeometric, with the partitions' and the shards' sizes as sums. It is drawn from the
       root of a tree over the partitions downwards: a node deals its counts to its 64 children at most. Nodes of
       a level are drawn side by side, and no task sees more than one node's children.
    3. The places are cut by the matrix's row: the first so many go to shard 0, and so on (the exchange).
    4. In its shard, a row gets its slot by a random order (the second permutation), in cells of
       about ``CELL_ROWS`` rows: cells are counted, then their rows are numbered.

    Random numbers come from ``seed``, partition and place. The first step is written, so a lost executor changes
    nothing; another run over the same partitions gives the same. The first ``n % shards``
    shards have the row more.

    Null texts have no bytes (size 8) and the checksum of an empty text. Nulls in other columns, ties, repeated ids and
    repeated rows don't matter: each row is dealt for itself. Very long texts count as one row. An
    empty table gives no rows.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, shards: int = 24, seed: int = 1):
        self.spark, self.shards, self.seed = spark, shards, seed
        self.scratch = Scratch(spark)
        self.rows = self.scratch.keep(self._placed(pick(docs, doc_id="long", text="string")))

    def _placed(self, docs: DataFrame) -> DataFrame:
        """row, part, place, doc_id, size, text_crc32."""
        seed = self.seed
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        )

        def permute(batches):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            batches = [b for b in batches if b.num_rows]
            places = np.random.default_rng([seed, 1, part]).permutation(sum(b.num_rows for b in batches))
            start = 0
            for b in batches:
                own = pa.array(places[start : start + b.num_rows], pa.int64())
                start += b.num_rows
                yield pa.record_batch([pa.array(np.full(b.num_rows, part), pa.int64()), own, *b.columns], names=["part", "place", *b.schema.names])

        return rows.mapInArrow(permute, "part long, place long, row long, doc_id long, size long, text_crc32 long")

    def sizes(self) -> list[int]:
        n = self.rows.count()
        return [n // self.shards + (s < n % self.shards) for s in range(self.shards)]

    def matrix(self) -> DataFrame:
        """part, counts (for each shard, how many rows the partition sends it)."""
        seed, schema = self.seed, "node long, counts array<long>"
        parts = self.scratch.keep(self.rows.groupBy("part").agg(F.count("*").alias("n")))
        most = parts.agg(F.max("part")).first()[0] or 0
        levels = -(-most.bit_length() // FAN_OUT_BITS)
        nodes = self.spark.createDataFrame([(0, self.sizes())], schema)

        def draw(level):
            def of_node(children):
                children = children.sort_values("node")
                rng = np.random.default_rng([seed, 2, level, int(children["parent"].iloc[0])])
                return children.assign(counts=split(rng, [int(c) for c in children["counts"].iloc[0]], [int(n) for n in children["n"]]))[["node", "counts"]]

            return of_node

        for level in reversed(range(levels)):
            sizes = parts.groupBy(F.shiftright("part", FAN_OUT_BITS * level).alias("node")).agg(F.sum("n").alias("n"))
            children = sizes.withColumn("parent", F.shiftright("node", FAN_OUT_BITS)).join(nodes.select(F.col("node").alias("parent"), "counts"), "parent")
            nodes = children.groupBy("parent").applyInPandas(draw(level), schema)
        return self.scratch.keep(nodes.select(F.col("node").alias("part"), "counts"))

    def assigned(self) -> DataFrame:
        """row, doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
        ends = "transform(sequence(1, size(counts)), i -> aggregate(slice(counts, 1, i), 0L, (sum, x) -> sum + x))"
        matrix = self.matrix().select("part", F.expr(ends).alias("ends"))
        matrix = F.broadcast(matrix) if matrix.count() <= BROADCAST_ROWS else matrix.hint("merge")
        cells = max(1, -(-self.sizes()[0] // CELL_ROWS))
        order = F.xxhash64(F.lit(self.seed), F.lit("slot"), "part", "place")
        rows = self.rows.join(matrix, "part").withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("place")))).withColumn("order", order)
        rows = self.scratch.keep(rows.select("row", "doc_id", "size", "text_crc32", "shard", "order", F.pmod("order", F.lit(cells)).alias("cell")))
        before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counted = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        counted = counted.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        slot = F.col("base") + F.row_number().over(Window.partitionBy("shard", "cell").orderBy("order", "row")) - 1
        return rows.join(counted.hint("merge"), ["shard", "cell"]).select("row", "doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """doc_id, size (bytes of the text and 8), text_crc32, shard, slot: see ``Sharding``."""
    return Sharding(spark, docs, shards, seed).assigned().drop("row")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 24, seed: int = 1) -> None:
    """The whole rows as Parquet, a folder ``shard=N`` for each shard, with file after file in the order of ``slot``.

    Rows are written to the shared folder first, so that those dealt and those written are the same.
    Names are made distinct, as files need it: a column named like an earlier one but for case, or like ``shard``
    or ``slot``, gets its position as a suffix.
    """
    scratch, whole = Scratch(spark), Whole(docs, doc_id="long")
    rows = scratch.keep(whole.rows.select(*whole.slots, F.monotonically_increasing_id().alias("row")))
    tagged = rows.select(F.col("row").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    dealt = Sharding(spark, tagged, shards, seed).assigned().select(F.col("doc_id").alias("row"), "shard", "slot")
    files = F.floor(F.col("slot") / CELL_ROWS)
    out = rows.join(dealt.hint("merge"), "row").withColumn("file", files).repartition("shard", "file").sortWithinPartitions("shard", "slot")
    taken, columns = {"shard", "slot"}, []
    for i, (slot, name) in enumerate(zip(whole.slots, whole.names)):
        columns.append(F.col(slot).alias(f"{name}_{i}" if name.lower() in taken else name))
        taken.add(name.lower())
    out.select(*columns, "shard", "slot").write.partitionBy("shard").parquet(path)
