"""The cleaning operators on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, normalize


def clean_stream(stream: DataFrame, names: list[str]) -> DataFrame:
    """A stream of texts with stage and rule, the same as in batch: all is decided within the row."""
    return filters.chain(stream.withColumn("text", normalize.corpus_text(F.coalesce("text", F.lit("")))), names)


def first_seen(stream: DataFrame, event_time: str | None = None, within: str = "1 day") -> DataFrame:
    """Rows whose normalized text was not seen before.

    With an event time, a text is remembered for ``within`` and the state stays
    bounded; without one it is remembered for good.
    """
    keyed = stream.withColumn("_key", F.sha2(normalize.dedup_text(F.col("text")), 256))
    if event_time is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counters(stream: DataFrame, name: str = "cleaning") -> DataFrame:
    """The stream, observed: progress events carry how many rows there were and how many stay."""
    return stream.observe(name, F.count("*").alias("processed"), F.count_if(F.col("rule").isNull()).alias("kept"))


def resume_into(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Appends rows with keys that ``path`` doesn't hold yet; a batch that is run again adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(path).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = batch.select(key).limit(0)
        batch.dropDuplicates([key]).join(done, key, "left_anti").write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
