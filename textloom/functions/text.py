"""Text functions as Column builders; all but NFKC, the zlib ratio and the automata (``runs``, ``found``) stay in the JVM."""

from __future__ import annotations

import functools
import unicodedata
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType

from . import lexicons as lex
from .counting import few


def strip(text: Column) -> Column:
    """White space off at both ends. Texts without any there, most of them, aren't searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(lex.WS), F.regexp_replace(text, rf"^{lex.WS}+|{lex.WS}+\z", "")).otherwise(text)


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{lex.WS}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"{lex.WS}+"), lambda w: w != "")


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those within groups and classes left alone."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def by_first_letter(pattern: str) -> str:
    """The same pattern, alternatives with one first letter in one group; matches are the same, in the same order.

    An engine that tries alternatives one after another then tries a few at each place.
    """
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    parts = alternatives(body)
    if len(parts) < 4 or not all(x[:1].isalpha() and x[:1].isascii() and x[1:2] not in tuple("?*+{") for x in parts):
        return pattern
    groups: dict[str, list[str]] = {}
    for x in parts:
        groups.setdefault(x[0].lower() if flags else x[0], []).append(x[1:])
    return f"{flags}(?=[{''.join(groups)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


def count(text: Column, pattern: str, *needs: str) -> Column:
    """Matches of a pattern; line ends are \\n alone. Texts that hold none of ``needs``, one of which any match holds, aren't searched."""
    found = F.regexp_count(text, F.lit("(?d)" + by_first_letter(pattern)))
    return F.when(holds(text, *needs), found).otherwise(0) if needs else found


def runs(text: Column, pattern: str) -> Column:
    """Matches of a pattern in one pass of an automaton over each Arrow batch, whatever the number of its alternatives; null for no text.

    What is left after a match is searched as a text of its own, so the pattern must not ask for what lies before a match
    (no ``^``, no ``\\b`` at its start).
    """

    @F.arrow_udf(IntegerType())
    def counted(texts: pa.Array) -> pa.Array:
        return pc.count_substring_regex(texts, pattern).cast(pa.int32())

    return counted(text)


def found(text: Column, pattern: str) -> Column:
    """True if a pattern matches anywhere, in one pass of an automaton over each Arrow batch; null for no text."""

    @F.arrow_udf(BooleanType())
    def matched(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return matched(text)


def holds(text: Column, *parts: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def n_chars_of(text: Column, chars: str) -> Column:
    """Characters of the class ``chars`` (as it stands between brackets)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def let(value: Column, f) -> Column:
    """f of the value, which is computed once however often f (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingles(tokens: Column, k: int, short=None) -> Column:
    """Distinct runs of k tokens; of fewer tokens, the tokens if ``short`` is None, else ``short``."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.array_distinct(F.when(F.size(t) >= k, runs).otherwise(t if short is None else short))

    return let(tokens, of)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def jaccard_or(a: Column, b: Column, both_empty: float | None, one_empty: float | None = 0.0) -> Column:
    """Jaccard with a value of its own where both sets or one of them are empty: 1 and 0, 0 and 0, or null (the pair doesn't count)."""
    value = lambda x: F.lit(x).cast("double")
    n, m = F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), value(both_empty)).when((n == 0) | (m == 0), value(one_empty)).otherwise(jaccard(a, b))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def nfkc(text: Column) -> Column:
    """NFKC; ASCII text is its own and never leaves the JVM."""

    @F.arrow_udf(StringType())
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for (part,) in few(texts) for t in part], pa.string())

    return F.when(text.rlike(r"^[\x00-\x7F]*\z"), text).otherwise(normal(text))


def zlib_ratio(text: Column) -> Column:
    """Compressed over plain UTF-8 bytes; 1 under 100 characters."""

    @F.arrow_udf(DoubleType())
    def ratio(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(zlib.compress(t.encode())) / max(1, len(t.encode())) for (part,) in few(texts) for t in part], pa.float64())

    return F.when(F.length(text) < 100, F.lit(1.0)).otherwise(ratio(text))
