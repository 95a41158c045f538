"""Where each line of text files lies, so that single lines can be read without reading what comes before them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_source import opened


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), offset and length in bytes (without the line end) of the lines of one or more files.

    Files are read in splits, side by side. A split knows the bytes of its own lines only: sums over the splits
    of a file say where each one's first line begins. Lines end at \\n; a \\r before it belongs to the line. An empty last line is none.
    Compressed files have no offsets that could be read at, and are refused.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    rows = lines.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("i"), F.octet_length("value").cast("long").alias("length"))
    rows = rows.withColumn("file", F.when(F.col("file").rlike(r"\.(gz|bz2|zst|xz|lz4|snappy|deflate)$"), F.raise_error(F.concat(F.lit("compressed: "), F.col("file")))).otherwise(F.col("file")))
    before = lambda *parts: Window.partitionBy(*parts[:-1]).orderBy(parts[-1]).rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum(F.col("length") + 1).alias("bytes"))
    splits = splits.select("file", "split", *[F.coalesce(F.sum(c).over(before("file", "split")), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")])
    own = before("file", "split", "i")
    rows = rows.join(splits, ["file", "split"])
    line = F.col("n_before") + F.count("*").over(own)
    offset = F.col("bytes_before") + F.coalesce(F.sum(F.col("length") + 1).over(own), F.lit(0))
    return rows.select("file", line.alias("line"), offset.alias("offset"), "length")


def read_lines(wanted: DataFrame) -> DataFrame:
    """``wanted`` (file, line, offset, length: rows of an index) with value: each task reads the ranges of its lines, in the order of the files."""

    def run(batches):
        name, f = None, None
        for b in batches:
            values = []
            for file, offset, length in zip(*[b.column(c).to_pylist() for c in ("file", "offset", "length")]):
                if file != name:
                    if f:
                        f.close()
                    store, root = opened(file)
                    name, f = file, store.open_input_file(root)
                f.seek(offset)
                values.append(f.read(length))
            yield pa.record_batch([b.column("file"), b.column("line"), b.column("offset"), b.column("length"), pa.array(values, pa.binary())], names=["file", "line", "offset", "length", "value"])
        if f:
            f.close()

    rows = wanted.select("file", "line", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, "file string, line long, offset long, length long, value binary").withColumn("value", F.col("value").cast("string"))
