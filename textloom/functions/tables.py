"""Table functions for SQL: ``register(spark)``, then ``SELECT * FROM next_fit(TABLE(t) PARTITION BY shard ORDER BY (seq), 1024)``."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.documents import split_text


@udtf(returnType="seq long, pack long, segment long, start long")
class NextFit:
    """Documents (seq, n) of a partition, in its order, in packs of at most ``size`` tokens; longer documents are left out.

    The state is the open pack's number and filling, so a partition of any length takes the same memory.
    """

    def __init__(self):
        self.pack = self.segment = self.filled = 0

    def eval(self, row: Row, size: int):
        if row["n"] is None or row["n"] > size:
            return
        if self.filled + row["n"] > size:
            self.pack, self.segment, self.filled = self.pack + 1, 0, 0
        yield row["seq"], self.pack, self.segment, self.filled
        self.segment, self.filled = self.segment + 1, self.filled + row["n"]


@udtf(returnType="part int, piece string")
class SplitDocument:
    """The parts of a text of at most ``most`` characters: runs of paragraphs, or of sentences where a paragraph is too long. Null is empty."""

    def eval(self, text: str, most: int):
        yield from enumerate(split_text(text or "", most))


def register(spark: SparkSession) -> None:
    spark.udtf.register("next_fit", NextFit)
    spark.udtf.register("split_document", SplitDocument)
