"""Content filters: Column builders that name the rule a text breaks, or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions import lexicons as lex
from ..functions import text as tx


#: One of these is part of any address that ``lex.URL`` matches.
URL_PARTS = ("://", "www.", "@")


def measures() -> tuple[Column, Column, Column, Column]:
    """Text, length, counts (see ``counting``) and number of words: the columns of ``measured``."""
    return F.col("text"), F.col("_l"), F.col("_c"), F.col("_c.n_words")


def measured(df: DataFrame) -> DataFrame:
    """The columns that most filters need, computed once: length, and counts of words, characters, lines and sentences."""
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    return df.withColumn("_l", F.length("text")).withColumn("_c", counting.text_counts(F.col("text")))


def nsfw() -> Column:
    T, L, _, N = measures()
    sexual, service = tx.runs(T, lex.SEXUAL), tx.runs(T, lex.SERVICE)
    return F.when((L < 20) | (N == 0), None).when((sexual + 2 * service) / N > 0.03, "nsfw_density").when((N < 100) & (sexual + service > 3), "nsfw_count")


def gambling() -> Column:
    T, L, _, N = measures()
    return F.when((L < 20) | (N == 0), None).when(tx.runs(T, lex.GAMBLING) / N > 0.02, "gambling_density")


def seo_spam() -> Column:
    T, L, C, N = measures()
    return (
        F.when((L < 30) | (N < 5), None).when(tx.count(T, lex.URL, *URL_PARTS) / N > 0.1, "url_density").when(C["most_long_word"] / N > 0.08, "keyword_stuffing")
        .when(tx.runs(T, lex.LINK_FARM) > 3, "link_farm").when((N > 10) & (C["n_capitals"] / N > 0.3), "caps_ratio")
    )


def html_code() -> Column:
    T, L, _, N = measures()
    blob = T.rlike(rf"(?s)^{lex.WS}*[{{\[].*[}}\]]{lex.WS}*\z") & (F.length(tx.strip(T)) > 100)
    long_line = F.exists(F.split(T, "\n"), lambda x: (F.length(x) > 500) & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) < 10))
    return (
        F.when(L < 10, None).when(T.rlike("^(?:" + lex.XML_DECLARATION + ")"), "xml_declaration")
        .when(blob, "json_blob").when(tx.found(T, lex.BASE64), "base64_blob")
        .when((N > 0) & (tx.runs(T, lex.TAG) / N > 0.3), "html_density").when(tx.runs(T, lex.BLOCK) > 5, "css_blocks")
        .when(tx.runs(T, lex.SCRIPT) > 3, "script_blocks").when(long_line, "minified")
    )


def repeated_content() -> Column:
    T, L, C, _ = measures()
    return (
        F.when(L < 10, None).when(T.rlike(r"([^\n])\1{5,}"), "repeated_char").when(T.rlike(r"(?iuU)\b(\w+)(\s+\1){3,}\b"), "repeated_word")
        .when((C["n_lines"] > 3) & (C["most_line"] / C["n_lines"] > 0.3), "repeated_line")
    )


def language_quality() -> Column:
    T, L, C, N = measures()
    punct = tx.n_chars_of(T, r".,!?;:()\-\[\]{}\"'")
    return (
        F.when(L < 20, None).when(tx.n_chars_of(T, r"\p{L}") / L < 0.5, "low_alpha_ratio").when((N > 0) & (tx.count(T, lex.URL, *URL_PARTS) / N > 0.15), "high_url_density")
        .when(punct / L > 0.4, "high_punct_ratio").when(C["char_entropy"] < 3.0, "low_entropy").when(tx.runs(T, r"[^\x00-\x7F]{10,}") > 5, "ocr_garbage").when(tx.holds(T, "Ã") & T.rlike(lex.MOJIBAKE), "mojibake")
    )


def ocr_garbage() -> Column:
    T, L, _, N = measures()
    # No match ends after a line end, so a line's beginning is a white space that is there to be matched, but for the first line's.
    return F.when((L < 20) | (N == 0), None).when(tx.runs(F.concat(F.lit(" "), T), "(?m)" + lex.OCR.replace("^|", "")) / N > 0.05, "ocr_density")


def document_length(least: int = 50, most: int = 100_000, split_long: bool = True) -> Column:
    _, L, _, _ = measures()
    rule = F.when(L == 0, "empty_document").when(L < least, "too_short")
    return rule if split_long else rule.when(L > most, "too_long")


def unicode_quality() -> Column:
    T, _, _, _ = measures()
    return F.when(tx.found(T, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9f}]"), "control_chars").when(tx.holds(T, "\ufffd"), "replacement_chars").when(tx.runs(T, r"[\x{10000}-\x{10FFFF}]") > 10, "non_bmp")


def language() -> Column:
    T, L, C, N = measures()
    return F.when((L < 50) | (N < 10), None).when(C["n_known"] / N < 0.15, "non_english").when(tx.n_chars_of(T, "a-zA-Z") / L < 0.5, "non_latin")


def code_quality() -> Column:
    T, _, _, _ = measures()
    lines = F.split(T, "\n")
    mean = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.length(x)) / F.size(lines)
    return F.when(F.length(tx.strip(T)) < 50, "too_short").when(mean > 200, "minified").when(F.lower(T).rlike("auto-generated|autogenerated|do not edit|generated by"), "generated")


FILTERS: dict[str, Callable[[], Column]] = {
    "nsfw": nsfw, "gambling": gambling, "seo_spam": seo_spam, "html_code": html_code, "repeated_content": repeated_content, "language_quality": language_quality,
    "ocr_garbage": ocr_garbage, "document_length": document_length, "unicode_quality": unicode_quality, "language": language,
}


def register_filter(name: str, rule: Callable[[], Column]) -> None:
    """A filter is a builder of a Column over text, _l (its length) and _c (its counts) that is null for what stays."""
    FILTERS[name] = rule


def apply_filter(df: DataFrame, name: str) -> DataFrame:
    if name not in FILTERS:
        raise ValueError(f"no filter {name!r}")
    return measured(df).withColumn("rule", FILTERS[name]())


def chain(df: DataFrame, names: list[str]) -> DataFrame:
    """``stage`` and ``rule`` of the first filter that a text breaks; later ones aren't evaluated for it."""
    df = measured(df).withColumn("_hit", F.coalesce(*[F.concat(F.lit(f"{n}:"), FILTERS[n]()) for n in names]))
    return df.withColumns({"stage": F.split_part("_hit", F.lit(":"), F.lit(1)), "rule": F.split_part("_hit", F.lit(":"), F.lit(2))}).drop("_hit", "_l", "_c")
