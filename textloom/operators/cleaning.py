"""The cleaning chain of a corpus: normalised text, content filters, quality bounds, then duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import Tables
from .dedup import first_by_key, minhash_dedup
from .filters import chain
from .normalize import corpus_text, dedup_text
from .quality import metrics, quality_filter

#: All content filters, in the order in which they are configured.
ORDER = ("nsfw", "gambling", "seo_spam", "html_code", "repeated_content", "language_quality", "ocr_garbage", "document_length", "unicode_quality", "language")


def clean_documents(spark: SparkSession, df: DataFrame) -> DataFrame:
    """seq and reason (null: kept) of each row of ``df`` (seq, text): empty, filter:rule, quality:rule or dedup:rule.

    Each stage sees what the one before left. All read the normalised text,
    which is one line. An exact copy of a text that goes as a MinHash hit is
    still an exact copy; only first ones enter the buckets.
    """
    tables = Tables(spark)
    text = F.coalesce("text", F.lit(""))
    named = lambda stage, rule: F.when(rule.isNotNull(), F.concat(stage, F.lit(":"), rule))
    verdict: Column = F.when(F.col("_empty"), "empty").otherwise(named(F.col("stage"), F.col("rule")))
    filtered = chain(df.select("seq", (tx.strip(text) == "").alias("_empty"), corpus_text(text).alias("text")), list(ORDER))
    filtered = tables.keep(filtered.select("seq", "text", verdict.alias("reason")))
    judged = quality_filter(metrics(filtered.filter("reason IS NULL").drop("reason"), compression=True))
    judged = tables.keep(judged.select("seq", "text", named(F.lit("quality"), F.col("quality_rule")).alias("reason")))
    exact = tables.keep(first_by_key(judged.filter("reason IS NULL").drop("reason"), F.sha2(dedup_text(F.col("text")), 256)))
    near = minhash_dedup(spark, exact.filter("not duplicate").drop("duplicate"))
    gone = [x.filter("reason IS NOT NULL").select("seq", "reason") for x in (filtered, judged)]
    copies = exact.filter("duplicate").select("seq", F.lit("dedup:exact_duplicate").alias("reason"))
    return gone[0].unionByName(gone[1]).unionByName(copies).unionByName(near.select("seq", F.when(~F.col("kept"), "dedup:minhash_lsh").alias("reason")))
