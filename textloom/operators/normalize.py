"""Normalizers and the preprocessing chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from .keys import first_by_key

CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ALL_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9f}]"


def strip_html(text: Column) -> Column:
    for pattern in (lex.TAG, lex.NAMED_ENTITY, lex.HTTP_URL):
        text = F.regexp_replace(text, pattern, " ")
    return text


def normalize_unicode(text: Column) -> Column:
    return F.regexp_replace(tx.nfkc(text), CONTROLS, "")


def corpus_text(text: Column) -> Column:
    """Tags and entities off, white space collapsed, then controls off."""
    text = F.regexp_replace(F.regexp_replace(text, lex.TAG, " "), lex.ENTITY, " ")
    return F.regexp_replace(tx.collapse(text), ALL_CONTROLS, "")


def dedup_text(text: Column) -> Column:
    return tx.collapse(F.lower(text))


def ascii_dedup_text(text: Column) -> Column:
    """Anything but a-z, 0-9 and white space counts as white space."""
    kept = lex.WS[1:-1]
    return tx.collapse(F.regexp_replace(F.lower(text), f"[^a-z0-9{kept}]", " "))


def without_artifacts(text: Column) -> Column:
    """A teacher model's set phrases and speaker prefixes off; ends in one line break."""
    for pattern in lex.ARTIFACT_LINES:
        text = F.regexp_replace(text, "(?d)" + pattern, "")
    text = F.regexp_replace(text, rf"^(?:(?:(?i:assistant|user|system){lex.WS}*:[^\n]*|[\x09\x0b-\x0d\x1c-\x20\x{{85}}\x{{a0}}]*)(?:\n|\z))+", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(text, rf"{lex.WS}+\z", ""), F.lit("\n"))


def preprocess(df: DataFrame, min_length: int = 0, max_length: int | None = None, truncate: bool = False, languages: list[str] | None = None, html: bool = True, unicode: bool = True, deduplicate: bool = True) -> DataFrame:
    """``df`` (seq, text, lang, source) with clean and reason (null: kept).

    The order is empty (raw text), HTML, NFKC, white space, length, duplicates
    within a source (first by seq, among rows that come so far), language. A
    text is known as seen before its language is judged. No row is removed, so
    counts and rejects come from the same frame.
    """
    clean = F.coalesce("text", F.lit(""))
    clean = strip_html(clean) if html else clean
    clean = normalize_unicode(clean) if unicode else clean
    df = df.withColumn("clean", tx.collapse(clean))
    n = F.length("clean")
    reason = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(n < min_length, "too_short")
    if max_length is not None:
        reason = reason if truncate else reason.when(n > max_length, "too_long")
    df = df.withColumn("reason", reason)
    if max_length is not None and truncate:
        df = df.withColumn("clean", F.substring("clean", 1, max_length))
    if deduplicate:
        # Rows that go already have no key: they are no one's duplicates and meet nowhere.
        key = F.when(F.col("reason").isNull(), F.sha2("clean", 256))
        df = first_by_key(df, key, "source").withColumn("reason", F.coalesce("reason", F.when(F.col("duplicate"), "duplicate"))).drop("duplicate")
    if languages:
        df = df.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(F.col("lang").isin(languages), F.lit(False)), "language")))
    return df


def preprocess_report(clean: DataFrame) -> DataFrame:
    """One row of counters over a preprocessed frame."""
    kept = F.col("reason").isNull()
    by = {f"removed_{r}": F.count_if(F.col("reason") == r) for r in ("empty", "too_short", "duplicate", "language")}
    length = F.when(kept, F.length("clean"))
    return clean.agg(
        F.count("*").alias("n_total"), F.count_if(kept).alias("n_kept"), *[c.alias(n) for n, c in by.items()],
        F.coalesce(F.sum(length), F.lit(0)).alias("total_chars"), F.coalesce(F.sum(F.floor(length / 4)), F.lit(0)).alias("estimated_tokens"),
        F.bround(F.count_if(kept) / F.greatest(F.count("*"), F.lit(1)), 4).alias("retention_rate"),
    )
