"""Sources: each gives seq (place in the input), text and the rest as meta."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and seq of the lines of one or more text files; seq grows with file and place in it, with gaps."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on any bad line."""
    return spark.read.schema(schema).json(path, mode="FAILFAST").withColumn("seq", F.monotonically_increasing_id())


def skipping_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines are left out without a word."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").withColumn("seq", F.monotonically_increasing_id())


def tolerant_jsonl(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """seq, doc (variant), text, reason: json_decode_error, no_text_field or null. Blank lines don't count."""
    lines = numbered_lines(spark, path).filter(tx.strip(F.col("value")) != "")
    doc = F.try_parse_json("value")
    text = F.coalesce(F.try_variant_get("doc", f"$.{text_key}", "string"), F.try_variant_get("doc", "$.content", "string"))
    rows = lines.select("seq", doc.alias("doc")).withColumn("text", text)
    return rows.withColumn("reason", F.when(F.col("doc").isNull(), "json_decode_error").when(F.coalesce("text", F.lit("")) == "", "no_text_field"))


def detected_text(doc: Column) -> Column:
    """The first of text, content and body that is a string (an empty one wins, too), else the contents of messages."""
    string = lambda key: F.when(F.schema_of_variant(F.variant_get(doc, f"$.{key}", "variant")) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))
    messages = F.try_variant_get(doc, "$.messages", "array<struct<content string>>")
    joined = F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda c: c.isNotNull()), "\n")
    return F.coalesce(string("text"), string("content"), string("body"), joined)


def joined_text(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """text: the string columns that aren't empty, with a space between, in the order of ``keys`` or of the schema."""
    strings = [n for n, t in df.dtypes if t == "string"]
    return df.withColumn("text", F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in (keys or strings) if n in strings]))


def textbook_text(chapters: Column) -> Column:
    """The paragraphs of all sections of all chapters, a blank line between; any level may be null."""
    sections = F.flatten(F.transform(F.coalesce(chapters, F.array().cast("array<struct<sections:array<struct<paragraph:string>>>>")), lambda c: F.coalesce(c["sections"], F.array().cast("array<struct<paragraph:string>>"))))
    return F.array_join(F.transform(sections, lambda s: F.coalesce(s["paragraph"], F.lit(""))), "\n\n")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't blank, as text."""
    return numbered_lines(spark, path).select("seq", tx.strip(F.col("value")).alias("text")).filter("text <> ''")


def capped(df: DataFrame, n: int, keep: Column | None = None, cap_raw: bool = False) -> DataFrame:
    """The first n rows by seq: of those that ``keep`` lets through, or (``cap_raw``) before it looks at them."""
    if keep is None:
        return df.orderBy("seq").limit(n)
    return df.orderBy("seq").limit(n).filter(keep) if cap_raw else df.filter(keep).orderBy("seq").limit(n)


def all_of(*frames: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, as strings or by a schema; what doesn't fit the schema is null."""
    read = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", "true")
    return (read.schema(schema) if schema else read).csv(path)


def latest_version(names: list[str]) -> str:
    """sample-10BT if it is there; the latest CC-MAIN-year-week; the latest eight-digit date of English; else the last name."""
    import re

    if "sample-10BT" in names:
        return "sample-10BT"
    for pattern in (r"CC-MAIN-(\d{4})-(\d{2})", r"(\d{8})\.en"):
        found = [(tuple(map(int, m.groups())), n) for n in names if (m := re.search(pattern, n))]
        if found:
            return max(found)[1]
    return sorted(names)[-1]


def event_series(spark: SparkSession, path: str) -> DataFrame:
    """step, tag, value of a log of JSON lines: one row per number; what doesn't parse is left out."""
    doc = spark.read.text(path).select(F.try_parse_json("value").alias("doc")).filter("doc IS NOT NULL")
    pairs = doc.select(F.try_variant_get("doc", "$.step", "long").alias("step"), F.explode(F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))).alias("e"))
    return pairs.select("step", F.col("e.key").alias("tag"), F.try_variant_get("e.value", "$", "double").alias("value")).filter("tag <> 'step' AND value IS NOT NULL")


def markdown_sections(text: Column) -> Column:
    """Array of (title, body) for the ### sections of a text."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n### "), F.lit(2), F.lit(2**31 - 1))
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("\n"), F.lit(1)).alias("title"), F.regexp_replace(p, r"^[^\n]*\n?", "").alias("body")))
