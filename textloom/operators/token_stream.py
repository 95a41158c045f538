"""A corpus as one stream of token ids: encoding, binary parts with a manifest, reading back, packs and batches."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counting import few_batches
from ..sources.token_source import TokenStream, qualified, read_manifest


def encode(df: DataFrame, tokenizer_file: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """seq, ids of (seq, text) by a tokenizer file, with ids put before and after (null: none). Null text is empty."""

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        head, tail = ([] if x is None else [x] for x in (first, last))
        for b in few_batches(batches):
            ids = [head + tokenizer.encode(t or "", add_special_tokens=False).ids + tail for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["seq", "ids"])

    return df.select(F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text")).mapInArrow(run, "seq long, ids array<int>")


def decode(df: DataFrame, tokenizer_file: str, without: tuple[int, ...] = ()) -> DataFrame:
    """seq, text of (seq, ids); ids in ``without`` (those put before and after) are left out."""

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        for b in few_batches(batches):
            texts = [tokenizer.decode([i for i in ids or () if i not in without], skip_special_tokens=False) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["seq", "text"])

    return df.select(F.col("seq").cast("long").alias("seq"), "ids").mapInArrow(run, "seq long, text string")


def write_stream(tokens: DataFrame, path: str, vocabulary: int, last: int | None = None, overwrite: bool = False) -> dict:
    """(seq, ids) in order of seq as a token stream (``sources.token_source``); gives its manifest. A null array is an empty document."""
    spark = tokens.sparkSession
    spark.dataSource.register(TokenStream)
    uri = qualified(spark, path)
    ordered = in_order(tokens.select("seq", "ids"))
    write = ordered.write.format("token_stream").mode("overwrite" if overwrite else "append").option("vocabulary", vocabulary)
    (write if last is None else write.option("end", last)).save(uri)
    return read_manifest(uri)


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` by seq (null first): each partition holds a run of the order.

    The borders are quantiles of seq alone. A sort would sample whole rows for them, and so work out every row twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = rows.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    part = functools.reduce(lambda n, b: n + F.coalesce((F.col("seq") >= b).cast("int"), F.lit(0)), borders, F.lit(0))
    return rows.repartitionById(parts, part).sortWithinPartitions("seq")


def read_stream(spark: SparkSession, path: str, block: int = 1024) -> DataFrame:
    """start, ids: a stream in blocks of ``block`` tokens; the last one may be short.

    The element type is the manifest's. A stream with a token outside the vocabulary is refused.
    """
    spark.dataSource.register(TokenStream)
    return spark.read.format("token_stream").option("block", block).load(qualified(spark, path))


def tokenizer_statistics(tokens: DataFrame, unknown: int, vocabulary: int, lines: int = 10_000) -> DataFrame:
    """avg_tokens, chars_per_token, unknown_rate, coverage over the first ``lines`` rows (a report's own limit) of (seq, text, ids)."""
    # Only ids of rows are ordered: a task that gets the first rows of each partition gets no texts.
    first = tokens.select("seq").orderBy("seq").limit(lines)
    rows = tokens.join(F.broadcast(first), "seq", "left_semi")
    n = F.sum(F.size("ids"))
    unknowns = F.sum(F.size(F.filter("ids", lambda i: i == unknown)))
    used = rows.select(F.explode("ids").alias("id")).agg((F.count_distinct("id") / vocabulary).alias("coverage"))  # ids are never gathered in a row
    sums = rows.agg((n / F.count("*")).alias("avg_tokens"), F.try_divide(F.sum(F.length("text")), n).alias("chars_per_token"), F.try_divide(unknowns, n).alias("unknown_rate"))
    return sums.join(F.broadcast(used))


def full_packs(packs: DataFrame, size: int, least_last: int = 100) -> DataFrame:
    """Packs (scope, pack, ids, segment_ids, position_ids) padded to ``size`` with id 0, segment -1, position 0; labels are the ids.

    The last pack of a scope stays only if it has more than ``least_last`` tokens.
    """
    last = packs.groupBy("scope").agg(F.max("pack").alias("last"))
    kept = packs.join(last, "scope").filter((F.col("pack") < F.col("last")) | (F.size("ids") > least_last))
    ids = padded_to(F.col("ids"), size, 0)
    return kept.select("scope", "pack", ids.alias("ids"), ids.alias("labels"), padded_to(F.col("segment_ids"), size, -1).alias("segment_ids"), padded_to(F.col("position_ids"), size, 0).alias("position_ids"))


def padded_to(values: Column, size: int, pad: int) -> Column:
    values = values.cast("array<long>")
    return F.concat(values, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def collate_packed(packs: DataFrame, size: int) -> DataFrame:
    """A batch for each pack: ids padded with 0, labels with -100, segments with -1, positions with 0, up to ``size``."""
    return packs.select("scope", "pack", padded_to(F.col("ids"), size, 0).alias("ids"), padded_to(F.col("labels"), size, -100).alias("labels"), padded_to(F.col("segment_ids"), size, -1).alias("segment_ids"), padded_to(F.col("position_ids"), size, 0).alias("position_ids"))
