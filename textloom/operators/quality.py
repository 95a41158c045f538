"""Quality metrics of a text and the filter on their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from .filters import measured, measures

METRICS = ("url_ratio", "digit_ratio", "symbol_ratio", "duplicate_line_ratio", "average_word_length", "max_repeated_token_frequency", "character_entropy", "word_entropy", "type_token_ratio", "sentence_count", "average_sentence_length", "paragraph_count", "char_count", "word_count")
#: With the one that SQL can't say.
ALL_METRICS = (*METRICS, "compression_ratio")

#: Metric, least and most; the first that is broken decides.
BOUNDS = (
    ("url_ratio", None, 0.15), ("digit_ratio", None, 0.5), ("symbol_ratio", None, 0.3), ("duplicate_line_ratio", None, 0.5), ("average_word_length", 2.0, 15.0),
    ("max_repeated_token_frequency", None, 0.15), ("character_entropy", 3.0, 8.0), ("compression_ratio", 0.2, 0.9), ("type_token_ratio", 0.1, 1.0),
)


def metrics(df: DataFrame, compression: bool = False) -> DataFrame:
    """``df`` with a column for each metric; compression is the one that needs Python."""
    T, L, C, N = measures()
    df = measured(df).withColumn("_lines", F.split(tx.strip(T), "\n"))
    most = F.greatest(L, F.lit(1))
    urls = F.when(tx.holds(T, "://", "www."), F.length(T) - F.length(F.regexp_replace(T, lex.PLAIN_URL, ""))).otherwise(0)
    some = lambda c: F.when(N > 0, c / N).otherwise(0.0)
    columns: dict[str, Column] = {
        "url_ratio": urls / most,
        "digit_ratio": tx.n_chars_of(T, r"\p{Nd}\x{b2}\x{b3}\x{b9}") / most,
        "symbol_ratio": F.length(F.regexp_replace(T, rf"[\p{{L}}\p{{N}}{lex.WS[1:-1]}]+", "")) / most,
        "duplicate_line_ratio": F.when(F.size("_lines") < 2, 0.0).otherwise(1 - F.size(F.array_distinct("_lines")) / F.size("_lines")),
        "average_word_length": some(C["word_letters"]),
        "max_repeated_token_frequency": some(C["most_word"]),
        "character_entropy": C["char_entropy"],
        "word_entropy": C["word_entropy"],
        "type_token_ratio": some(C["n_distinct"]),
        "sentence_count": C["n_sentences"],
        "average_sentence_length": F.when(C["n_spoken"] > 0, C["spoken_words"] / C["n_spoken"]).otherwise(0.0),
        "paragraph_count": C["n_paragraphs"],
        "char_count": L,
        "word_count": N,
    }
    if compression:
        columns["compression_ratio"] = tx.zlib_ratio(T)
    return df.withColumns(columns).drop("_lines", "_l", "_c")


def quality_filter(measured_df: DataFrame, min_words: int = 10, min_sentences: int = 1) -> DataFrame:
    """``quality_rule``: the first bound that a row of ``metrics`` breaks, or null."""
    rule = F.when(F.length(tx.strip(F.col("text"))) < 20, "too_short").when(F.col("word_count") < min_words, "word_count").when(F.col("sentence_count") < min_sentences, "sentence_count")
    for name, least, most in BOUNDS:
        if name in measured_df.columns:
            rule = rule if least is None else rule.when(F.col(name) < least, f"{name}<min")
            rule = rule if most is None else rule.when(F.col(name) > most, f"{name}>max")
    return measured_df.withColumn("quality_rule", rule)


def summary(measured_df: DataFrame) -> DataFrame:
    """metric, mean, least, most over all rows, in one aggregation."""
    names = [n for n in ALL_METRICS if n in measured_df.columns]
    value = lambda n: F.col(n).cast("double")
    row = measured_df.agg(*[F.struct(F.lit(n).alias("metric"), F.avg(value(n)).alias("mean"), F.min(value(n)).alias("least"), F.max(value(n)).alias("most")).alias(n) for n in names])
    return row.select(F.explode(F.array(*names)).alias("m")).select("m.*")
