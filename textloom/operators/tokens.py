"""Token arrays: chunks of one stream, next-fit packs, padded batches."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.counting import few

#: Words whose ids a task remembers, at most.
KNOWN_WORDS = 500_000


class WordIds(dict):
    """The id of a word, the first 16 bits of its MD5, worked out once while it is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:2], "big")
        return found


def word_ids(text: Column) -> Column:
    """Ids of the words of a text; null for no text."""

    @F.arrow_udf(ArrayType(LongType()))
    def ids(texts: pa.Array) -> pa.Array:
        known = WordIds()
        found = [pa.array([None if t is None else list(map(known.__getitem__, t.split())) for t in part], pa.list_(pa.int64())) for (part,) in few(texts)]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int64()))

    return ids(text)


def offsets(df: DataFrame, length: str, cell_rows: int = 20_000, *cells: str) -> DataFrame:
    """``df`` (seq, ...) with start: the sum of ``length`` over all earlier rows, by cells of the order (two phases).

    ``cells``: names under which a row's cell, the start of the cell and its sum come too.
    """
    cell = F.floor(F.col("seq") / cell_rows)
    sizes = df.groupBy(cell.alias("_cell")).agg(F.sum(length).alias("_n"))
    base = sizes.select("_cell", "_n", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_base"))  # a row per cell
    within = F.sum(length).over(Window.partitionBy("_cell").orderBy("seq")) - F.col(length)
    placed = df.withColumn("_cell", cell).withColumn("_in", within).join(base, "_cell").withColumn("start", F.col("_base") + F.col("_in"))
    return placed.withColumnsRenamed(dict(zip(("_cell", "_base", "_n"), cells))).drop("_cell", "_in", "_base", "_n")


def chunks(tokens: DataFrame, size: int, cell_rows: int = 5_000) -> DataFrame:
    """chunk, ids, labels: the stream of (seq, ids) cut by ``size``; labels are one token ahead; the last token only labels.

    A chunk and the token after it come from slices of the documents that it meets: a row for each of those, not for each token. Documents
    are shuffled once, to the cells of ``offsets``; a chunk that lies in one cell is made there, and only slices of those on the
    borders of cells are shuffled again.
    """
    placed = offsets(tokens.withColumn("n", F.size("ids")), "n", cell_rows, "cell", "cell_start", "cell_n").filter("n > 0")
    first, last = F.greatest(F.ceil(F.col("start") / size) - 1, F.lit(0)), F.floor((F.col("start") + F.col("n") - 1) / size)
    each = placed.select("ids", "start", "n", "cell", "cell_start", "cell_n", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("start"), F.col("chunk") * size)
    end = F.least(F.col("start") + F.col("n"), (F.col("chunk") + 1) * size + 1)
    part = F.slice("ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
    slices = each.select("cell", "chunk", F.struct(begin.alias("p"), part.alias("part")).alias("part"), (
        (F.col("chunk") * size >= F.col("cell_start")) & ((F.col("chunk") + 1) * size + 1 <= F.col("cell_start") + F.col("cell_n"))).alias("inside"))
    gathered = F.array_sort(F.collect_list("part")).alias("parts")
    # A cell's rows are in one task already, so the first grouping shuffles nothing.
    whole = slices.filter("inside").groupBy("cell", "chunk").agg(gathered).select("chunk", "parts")
    whole = whole.unionByName(slices.filter("not inside").groupBy("chunk").agg(gathered))
    ids = F.flatten(F.transform("parts", lambda x: x["part"]))
    # Only the last chunk can lack a token.
    return whole.withColumn("all", ids).filter(F.size("all") == size + 1).select("chunk", F.slice("all", 1, size).alias("ids"), F.slice("all", 2, size).alias("labels"))


def tail_blocks(tokens: DataFrame, fraction: float, size: int) -> DataFrame:
    """block, ids: the last ``fraction`` of the tokens of (seq, ids), cut into blocks of ``size`` that don't overlap; a short last one is left out.

    Where the tail begins follows from the lengths alone; ids are read of the documents in it only.
    """
    lengths = offsets(tokens.select("seq", F.size("ids").alias("n")), "n").filter("n > 0")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    begin = int(total * (1 - fraction))
    inside = lengths.filter(F.col("start") + F.col("n") > begin)
    own = tokens.join(inside, "seq").select(F.greatest(F.col("start") - begin, F.lit(0)).alias("start"), F.expr(f"slice(ids, int(greatest({begin} - start, 0)) + 1, size(ids))").alias("ids"))
    placed = own.withColumn("n", F.size("ids"))
    each = placed.select("ids", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * size)
    part = F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    whole = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(low.alias("p"), part.alias("part")))).alias("parts"))
    return whole.select("block", F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids")).filter(F.size("ids") == size)


def next_fit(lengths: DataFrame, size: int, scope: str | None = None) -> DataFrame:
    """seq, pack, segment, start for documents of at most ``size`` tokens, packed next-fit in order.

    The assignment is sequential by nature. It needs ids and lengths only, streamed through one
    task per scope (a shard) in constant memory; arrays join back by seq.
    """

    def assign(batches):
        here = object()
        pack = segment = filled = 0
        for b in batches:
            out = []
            for part, seq, n in zip(b.column("scope").to_pylist(), b.column("seq").to_pylist(), b.column("n").to_pylist()):
                if part != here:
                    here, pack, segment, filled = part, 0, 0, 0
                if filled + n > size:
                    pack, segment, filled = pack + 1, 0, 0
                out.append((part, seq, pack, segment, filled))
                segment, filled = segment + 1, filled + n
            columns = zip(*out) if out else [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["scope", "seq", "pack", "segment", "start"])

    part = F.lit(0).cast("long") if scope is None else F.col(scope).cast("long")
    rows = lengths.select(part.alias("scope"), "seq", F.col("n").cast("long").alias("n")).filter(F.col("n") <= size)
    return rows.repartition("scope").sortWithinPartitions("scope", "seq").mapInArrow(assign, "scope long, seq long, pack long, segment long, start long")


def packed(tokens: DataFrame, assigned: DataFrame) -> DataFrame:
    """pack, ids, labels (-100 where a later segment begins), segment_ids, position_ids."""
    joined = tokens.join(assigned, "seq").groupBy("scope", "pack").agg(F.array_sort(F.collect_list(F.struct("segment", "ids"))).alias("parts"))
    flat = lambda f: F.flatten(F.transform("parts", f))
    return joined.select(
        "scope", "pack", flat(lambda p: p["ids"]).alias("ids"),
        flat(lambda p: F.transform(p["ids"], lambda x, i: F.when((i == 0) & (p["segment"] > 0), -100).otherwise(x))).alias("labels"),
        flat(lambda p: F.array_repeat(p["segment"], F.size(p["ids"]))).alias("segment_ids"), flat(lambda p: F.transform(p["ids"], lambda x, i: i)).alias("position_ids"),
    )


def padded(ids: Column, width: Column, pad: int = 0) -> Column:
    cut = F.slice(ids, F.lit(1), F.greatest(width, F.lit(0)))
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("long"), F.greatest(width - F.size(cut), F.lit(0))))


def collate(tokens: DataFrame, batch: int, cap: int) -> DataFrame:
    """seq, input_ids, labels, mask: batches of ``batch`` rows by seq, padded to the longest of the batch or ``cap``."""
    numbered = offsets(tokens.withColumn("one", F.lit(1)), "one").withColumn("batch", F.floor(F.col("start") / batch))
    width = F.least(F.max(F.size("ids")).over(Window.partitionBy("batch")), F.lit(cap))
    out = numbered.withColumn("width", width)
    ids = F.col("ids").cast("array<long>")
    return out.select("seq", "batch", padded(ids, F.col("width"), 0).alias("input_ids"), padded(ids, F.col("width"), -100).alias("labels"), padded(F.transform(ids, lambda x: F.lit(1).cast("long")), F.col("width"), 0).alias("mask"))
