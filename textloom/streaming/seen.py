"""Duplicates in a stream with the row that they repeat, and counters that outlive a restart."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators import normalize

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start within it keep their state in RocksDB, on disk and in the checkpoint; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


#: Groups that the hashes are dealt to; each is one value in the state.
BUCKETS = 1024
HASH = 32


class FirstOfKeys(StatefulProcessor):
    """For each key of a bucket the seq of the first row that had it, and the time of its last row if texts are forgotten.

    The state is asked once for a bucket and batch, not for each key: a call costs more than thousands of keys in a dictionary. A bucket's value has
    40 bytes (48 with times) for each of its keys and is written anew when a batch has a new key for it.
    """

    def __init__(self, remember_ms: int | None):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = "keys binary, firsts binary, lasts binary"
        self.known = handle.getValueState("known", kind, self.remember_ms) if self.remember_ms else handle.getValueState("known", kind)

    def handleInputRows(self, key, rows, timerValues):
        parts = [(part["k"].tolist(), part["seq"].to_numpy(np.int64)) for part in rows]  # hashes and numbers only, of one batch
        keys, seqs = [k for part, _ in parts for k in part], np.concatenate([part for _, part in parts])
        first, last, now = {}, {}, timerValues.getCurrentProcessingTimeInMs() if self.remember_ms else 0
        known = self.known.get()
        if known is not None:
            held = [known[0][i : i + HASH] for i in range(0, len(known[0]), HASH)]
            first = dict(zip(held, np.frombuffer(known[1], np.int64).tolist()))
            if self.remember_ms:
                last = {k: t for k, t in zip(held, np.frombuffer(known[2], np.int64).tolist()) if t + self.remember_ms > now}
                first = {k: first[k] for k in last}
        before, own = len(first), {}
        for k, seq in zip(keys, seqs.tolist()):
            if k not in first:
                own[k] = min(seq, own.get(k, seq))
        first |= own
        if self.remember_ms:
            last |= dict.fromkeys(keys, now)
        if self.remember_ms or len(first) > before:
            packed = lambda numbers: np.fromiter(numbers, np.int64, len(first)).tobytes()
            self.known.update((b"".join(first), packed(first.values()), packed(last[k] for k in first) if self.remember_ms else b""))
        found = np.fromiter((first[k] for k in keys), np.int64, len(keys))
        yield pd.DataFrame({"seq": seqs, "first": found, "duplicate": seqs != found})

    def close(self) -> None:
        pass


def first_seen_with_reason(stream: DataFrame, remember_ms: int | None = None) -> DataFrame:
    """seq, first, duplicate for each row (seq, text) of a stream: no row vanishes, and a duplicate says what it repeats.

    Texts are equal when their normalised forms are; null counts as empty. Among rows of one batch the least seq is the first, and rows
    of earlier batches come before it. A text is remembered for good, or for ``remember_ms`` after its last row,
    which bounds the state. Only the hash and the number go to the state; texts don't leave their tasks.
    Start the query within ``keyed_state``.
    """
    keyed = stream.select(F.unhex(F.sha2(normalize.dedup_text(F.coalesce("text", F.lit(""))), 256)).alias("k"), F.col("seq").cast("long").alias("seq"))
    mode = "ProcessingTime" if remember_ms else "None"
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(FirstOfKeys(remember_ms), "seq long, first long, duplicate boolean", outputMode="Append", timeMode=mode)


class Progress(StreamingQueryListener):
    """Calls back with the counters that a stream observes, and adds them up by batch.

    ``totals`` counts a batch once, however often it ran: what a batch reports again replaces what it had reported. A
    listener of a resumed query goes on from ``batches`` of the one before.
    """

    def __init__(self, name: str, callback: Callable[[int, dict], None] | None = None, batches: dict[int, dict] | None = None):
        self.name, self.callback, self.batches = name, callback, dict(batches or {})
        self.ended, self.error = False, None

    def onQueryStarted(self, event) -> None:
        self.ended, self.error = False, None

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[event.progress.batchId] = row.asDict()
            if self.callback:
                self.callback(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended, self.error = True, event.exception

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in self.batches.values():
            for name, n in counts.items():
                out[name] = out.get(name, 0) + (n or 0)
        return out
