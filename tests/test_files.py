"""Files as rows and small sinks, against the files themselves."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import samples, tokens
from textloom.sources import files, readers, writers


def test_files_are_seen_by_their_ends(spark, tmp_path):
    contents = {"a": b"x" * 3_000_000, "b": b"small", "c": b" " * 200 + b"y" * 5000, "d": b"z" * 5000 + b"\n" * 150, "f": b"\xff\x00" * 4000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    found = {os.path.basename(r.file): r for r in files.files_seen(spark, f"file://{tmp_path}/*", 1000).collect()}
    assert {n: r.bytes for n, r in found.items()} == {n: len(d) for n, d in contents.items()}
    assert {n: r.sha256 for n, r in found.items()} == {n: hashlib.sha256(d[: files.HASHED]).hexdigest() for n, d in contents.items()}
    assert {n: r.problem for n, r in found.items()} == {"a": None, "b": "too_small", "c": "blank_ends", "d": "blank_ends", "f": None}
    assert sorted(os.path.basename(r.file) for r in files.whole_files(spark, f"file://{tmp_path}/*", 1000).collect()) == ["a", "f"]
    seen = files.files_seen(spark, f"file://{tmp_path}/*", 1000)
    (tmp_path / "b").unlink()  # after it was listed
    try:
        assert {r.problem for r in seen.collect() if r.file.endswith("/b")} <= {"missing"}
    finally:
        assert "content" not in spark.read.format("binaryFile").load(f"file://{tmp_path}/*").selectExpr("path", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_metric_log_and_merged_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'lo"ss', 0.5), (2, "a,b", None)], "step long, metric string, value double")
    for _ in range(2):
        writers.metric_log(rows, f"{tmp_path}/log")
    back = readers.csv_rows(spark, f"{tmp_path}/log", "step long, metric string, value double")
    assert sorted(map(tuple, back.na.fill(-1.0).collect())) == sorted(map(tuple, rows.union(rows).na.fill(-1.0).collect()))
    assert readers.csv_rows(spark, f"{tmp_path}/log").dtypes == [("step", "string"), ("metric", "string"), ("value", "string")]
    writers.by_column_and_merged(spark.createDataFrame([("en", "a"), ("de", "b"), ("en", "c")], "lang string, text string"), "lang", f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/merged").count() == 3 and sorted(os.listdir(f"{tmp_path}/out/by"))[-2:] == ["lang=de", "lang=en"]


def test_conventions_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    for how, wanted in (((1.0, 0.0), [1.0, 0.0, 1 / 3]), ((0.0, 0.0), [0.0, 0.0, 1 / 3]), ((None, None), [None, None, 1 / 3])):
        assert [r.s for r in df.select(tx.jaccard_or(F.col("a"), F.col("b"), *how).alias("s")).collect()] == pytest.approx(wanted)


def test_scores_that_are_missing_pass(spark):
    df = spark.createDataFrame([("r", "Because r.", [-0.1, None]), ("r", None, None)], "response string, reasoning string, logprobs array<double>")
    found = samples.scored(df, {"confidence_score": 0.95}).collect()
    assert [r.keep for r in found] == [False, True] and found[1].confidence_score is None and found[1].reasoning_score == 0.0


@pytest.mark.parametrize("fraction, size", [(0.3, 4), (1.0, 7), (0.05, 50)])
def test_tail_blocks(spark, fraction, size):
    rows = [(i * 3, list(range(i % 9))) for i in range(40)] + [(500, None)]
    flat = [x for _, ids in rows for x in ids or []]
    tail = flat[int(len(flat) * (1 - fraction)) :]
    found = tokens.tail_blocks(spark.createDataFrame(rows, "seq long, ids array<int>"), fraction, size).orderBy("block").collect()
    assert [r.ids for r in found] == [tail[i : i + size] for i in range(0, len(tail) - size + 1, size)]


def test_mistakes_of_a_reader_are_not_hidden(spark, tmp_path):
    """What can't be read is left out and named; an error in the reader's own code comes through."""
    from textloom.operators import corpora

    rows = spark.range(3).selectExpr("id AS seq")
    skipped = {}
    found = corpora.shared_quota({"a": lambda: spark.read.parquet(f"{tmp_path}/nowhere"), "b": lambda: rows}, 9, skipped)
    assert found.count() == 3 and list(skipped) == ["a"]

    def mistaken():
        return rows.nothing_like_this()  # noqa

    def typed():
        return rows + 1

    for wrong in (typed,):
        with pytest.raises(TypeError):
            corpora.shared_quota({"a": wrong, "b": lambda: rows}, 9)
        with pytest.raises(TypeError):
            corpora.source_or(wrong, lambda: rows)
    with pytest.raises(Exception, match="UNRESOLVED"):
        corpora.source_or(lambda: rows.select("nowhere"), lambda: rows)
    with pytest.raises(AttributeError):
        corpora.source_or(mistaken, lambda: rows)
    (tmp_path / "broken.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet"):
        corpora.cached(spark, f"{tmp_path}/broken.parquet", lambda: rows)
