"""Counts over the words, characters, lines and sentences of a text, all in one pass over an Arrow batch.

As JVM expressions these would be lambdas over arrays of a text's words or
characters, which Spark interprets element by element.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import lexicons as lex

INTS = (
    "n_words", "word_letters", "most_word", "n_distinct", "most_long_word", "n_known", "n_capitals",
    "n_lines", "most_line", "n_sentences", "n_spoken", "spoken_words", "n_paragraphs",
)
DOUBLES = ("char_entropy", "word_entropy")
COUNTS = StructType([StructField(n, IntegerType()) for n in INTS] + [StructField(n, DoubleType()) for n in DOUBLES])
ENGLISH = frozenset(lex.ENGLISH)
SENTENCE = re.compile("[.!?]+")


#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 256


def few(*columns: pa.Array, rows: int = ROWS):
    """Columns of an Arrow batch as Python lists, a few rows at a time: a batch may hold 10,000 long texts."""
    for start in range(0, len(columns[0]), rows):
        yield tuple(c.slice(start, rows).to_pylist() for c in columns)


def few_batches(batches, rows: int = ROWS):
    """Arrow batches cut into such of a few rows."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def entropy(counts: Counter) -> float:
    """Shannon entropy in bits."""
    n = counts.total()
    return math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n if n else 0.0


def counted(text: str) -> tuple:
    """The values of ``INTS`` and ``DOUBLES`` for one text."""
    words = text.split()
    folded = Counter(map(str.lower, words))
    most = lambda values: max(values, default=0)
    if len(text.lower()) == len(text):
        long = (c for w, c in folded.items() if len(w) > 3)
    else:  # lower-casing changed some word's length
        long = Counter(w.lower() for w in words if len(w) > 3).values()
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    sentences = SENTENCE.split(text.strip())
    spoken = [n for n in (len(s.split()) for s in sentences) if n]
    return (
        len(words),
        sum(map(len, words)),
        most(folded.values()),
        len(folded),
        most(long),
        sum(c for w, c in folded.items() if w.strip(".,!?;:()") in ENGLISH),
        sum(len(w) > 1 and w.isupper() for w in words),
        len(lines),
        most(Counter(lines).values()),
        len(sentences),
        len(spoken),
        sum(spoken),
        sum(not p.isspace() and p != "" for p in text.split("\n\n")),
        entropy(Counter(text)),
        entropy(folded),
    )


def text_counts(text: Column) -> Column:
    """A struct of ``COUNTS``; null counts as empty."""

    @F.arrow_udf(COUNTS)
    def count(texts: pa.Array) -> pa.Array:
        rows = [counted(t or "") for (part,) in few(texts) for t in part]
        kinds = [pa.int32()] * len(INTS) + [pa.float64()] * len(DOUBLES)
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*INTS, *DOUBLES])

    return count(text)


def most_frequent_share(text: Column, pattern: str) -> Column:
    """The most frequent match's part of all matches of a pattern in the lower-cased text; 0 without any."""

    @F.arrow_udf(DoubleType())
    def share(texts: pa.Array) -> pa.Array:
        find = re.compile(pattern).findall
        found = (Counter(find((t or "").lower())) for (part,) in few(texts) for t in part)
        return pa.array([max(c.values()) / c.total() if c else 0.0 for c in found], pa.float64())

    return share(text)


def distinct_share(text: Column, n: int) -> Column:
    """Distinct runs of n words over all runs; 0 for fewer words, null for no text."""

    def of(words: list[str]) -> float:
        runs = len(words) - n + 1
        return len(set(zip(*(words[i:] for i in range(n))))) / runs if runs > 0 else 0.0

    @F.arrow_udf(DoubleType())
    def share(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(t.split()) for (part,) in few(texts) for t in part], pa.float64())

    return share(text)
