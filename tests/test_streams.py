"""Streams against the same operators over a table."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import dedup, keys, normalize
from textloom.streaming import clean, near, seen

SCHEMA = "seq long, text string, lang string"


def rows(n, seed=4):
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(500)}" for _ in range(30)] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            words[draw.randrange(30)] = f"other{draw.randrange(9)}"
        out.append((i, " ".join(words) if i % 9 else draw.choice(["", "  ", None, "two words"]), draw.choice(["en", None])))
    return out


def parts(spark, path, all_rows, n):
    """The rows as n files, that come one for each batch."""
    size = -(-len(all_rows) // n)
    for i in range(n):
        spark.createDataFrame(all_rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@pytest.mark.parametrize("window", [7, 1000])
def test_near_duplicates_of_a_stream(spark, tmp_path, window):
    """Batches give what the table gives; the state holds no more than the window; a batch run again changes nothing."""
    mine = rows(60)
    stream = parts(spark, tmp_path, mine, 6)
    op = near.NearDuplicates(spark, f"file://{tmp_path}/out", window=window)
    op.start(stream, f"{tmp_path}/checkpoint").awaitTermination()
    found = {r.seq: r.kept for r in op.decided(SCHEMA + ", kept boolean").collect()}
    wanted = {r.seq: r.kept for r in dedup.sliding_near_dedup(spark, spark.createDataFrame(mine, SCHEMA), window=window).collect()}
    assert found == wanted
    assert op.state.batches() == [4, 5] and 0 < op.state.read(5, near.STATE).count() <= window
    assert tuple(op.totals().first()) == (60, sum(wanted.values()))
    op.decide(spark.createDataFrame(mine[50:], SCHEMA), 5)  # as after a failure
    assert {r.seq: r.kept for r in op.decided(SCHEMA + ", kept boolean").collect()} == wanted
    assert tuple(op.totals().first()) == (60, sum(wanted.values()))
    op.decide(spark.createDataFrame([], SCHEMA), 6)
    assert tuple(op.totals().first()) == (60, sum(wanted.values())) and op.state.read(6, near.STATE).count() == op.state.read(5, near.STATE).count()


def test_duplicates_say_what_they_repeat(spark, tmp_path):
    mine = rows(90, 5)
    stream = parts(spark, tmp_path, mine, 3)
    with seen.keyed_state(spark):
        query = seen.first_seen_with_reason(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    found = {r.seq: (r.first, r.duplicate) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    df = spark.createDataFrame(mine, SCHEMA).withColumn("norm", normalize.dedup_text(F.coalesce("text", F.lit(""))))
    table = keys.first_by_key(df, F.sha2("norm", 256))
    assert {s: d for s, (_, d) in found.items()} == {r.seq: r.duplicate for r in table.collect()}
    norm = {r.seq: r.norm for r in df.collect()}
    first = {}
    for s in sorted(norm):
        first.setdefault(norm[s], s)
    assert all(f == first[norm[s]] for s, (f, _) in found.items())


def test_counters_of_a_resumed_stream(spark, tmp_path):
    mine = rows(40)
    stream = parts(spark, tmp_path, mine, 4)
    calls = []

    def run(listener, fail_at=None):
        def write(batch, number):
            batch.count()
            if number == fail_at:
                raise RuntimeError("lost")

        spark.streams.addListener(listener)
        counted = clean.counters(stream.withColumn("rule", F.when(F.length("text") < 10, "short")))
        query = counted.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(write).start()
        try:
            query.awaitTermination()
        except Exception:
            assert fail_at is not None
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
        spark.streams.removeListener(listener)

    first = seen.Progress("cleaning", lambda batch, counts: calls.append(batch))
    run(first, fail_at=2)
    assert first.error and first.totals()["processed"] == 20
    second = seen.Progress("cleaning", lambda batch, counts: calls.append(batch), first.batches)
    run(second)
    kept = sum(not (r[1] is not None and len(r[1]) < 10) for r in mine)
    assert second.totals() == {"processed": 40, "kept": kept} and sorted(calls) == [0, 1, 2, 3]


def test_the_state_is_asked_once_for_many_keys(spark, tmp_path, monkeypatch):
    """Keys of one bucket are one value of the state, over batches and with copies; before, each key was one and made calls of its own."""
    monkeypatch.setattr(seen, "BUCKETS", 3)
    mine = [(i, f"text {i % 50 if i % 7 else 'hot'}", "en") for i in range(120)]
    stream = parts(spark, tmp_path, mine, 3)
    with seen.keyed_state(spark):
        query = seen.first_seen_with_reason(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    first = {}
    wanted = {(i, first.setdefault(t, i), first[t] != i) for i, t, _ in mine}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("seq", "first", "duplicate").collect()} == wanted
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_forgotten_texts_are_first_again():
    """A key is forgotten when its time is over, though others of its bucket still come."""
    import pandas as pd

    held = []

    class State:
        def get(self):
            return held[-1] if held else None

        def update(self, value):
            held.append(value)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    op = seen.FirstOfKeys(100)
    op.known = State()
    a, b = b"a" * 32, b"b" * 32

    def run(ms, *rows):
        part = pd.DataFrame(rows, columns=["k", "seq"])
        return [tuple(r) for out in op.handleInputRows((0,), iter([part]), Now(ms)) for r in out.itertuples(index=False)]

    assert run(0, (a, 5), (a, 3), (b, 4)) == [(5, 3, True), (3, 3, False), (4, 4, False)]
    assert run(60, (b, 7)) == [(7, 4, True)]
    assert run(120, (a, 9), (b, 8)) == [(9, 9, False), (8, 4, True)]
