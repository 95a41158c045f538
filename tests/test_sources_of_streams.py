"""The token data source, line indexes and table functions."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import tables as udtfs
from textloom.operators import documents, token_stream, tokens
from textloom.plans import queries as plans
from textloom.sources import line_index, token_source


@pytest.fixture
def source(spark):
    spark.dataSource.register(token_source.TokenStream)
    return lambda df, uri, mode="append", **options: df.write.format("token_stream").mode(mode).options(vocabulary=100, **options).save(uri)


def blocks(spark, uri, **options):
    return sorted((r.start, r.ids) for r in spark.read.format("token_stream").options(**options).load(uri).collect())


@pytest.mark.parametrize("block, run", [(4, 8), (7, 1), (1000, 1000)])
def test_blocks_over_files_and_partitions(spark, source, tmp_path, block, run):
    uri = f"file://{tmp_path}/s"
    rows = [(i, [i % 90] * (i % 6)) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "seq long, ids array<int>").repartitionByRange(5, "seq").sortWithinPartitions("seq")
    source(df, uri, end=99)
    flat = [x for _, ids in rows for x in [*(ids or []), 99]]
    found = blocks(spark, uri, block=block, partitionTokens=run)
    assert [s for s, _ in found] == list(range(0, len(flat), block)) and [x for _, ids in found for x in ids] == flat
    assert all(len(ids) == block for _, ids in found[:-1])


def test_only_what_was_committed_is_a_stream(spark, source, tmp_path):
    """A job that fails leaves no stream; a stream isn't written twice by chance; overwriting replaces it whole."""
    good = spark.createDataFrame([(1, [1, 2]), (2, [3])], "seq long, ids array<int>").repartition(2)
    bad = good.union(spark.createDataFrame([(3, [200])], good.schema))
    uri = f"file://{tmp_path}/s"
    with pytest.raises(Exception, match="outside the vocabulary"):
        source(bad, uri)
    assert not os.path.exists(f"{tmp_path}/s/metadata.json")
    with pytest.raises(Exception, match="metadata.json|No such file"):
        blocks(spark, uri)
    source(good.coalesce(1), uri)
    first, old = blocks(spark, uri), {p["file"] for p in token_source.read_manifest(uri)["parts"]}
    with pytest.raises(Exception, match="holds a stream already"):
        source(good, uri)
    assert blocks(spark, uri) == first
    with pytest.raises(Exception, match="outside the vocabulary"):
        source(bad, uri, "overwrite")
    assert blocks(spark, uri) == first
    source(good.filter("seq = 2"), uri, "overwrite")
    files = {os.path.basename(p) for p in glob.glob(f"{tmp_path}/s/part-*")}
    assert blocks(spark, uri) == [(0, [3])] and {p["file"] for p in token_source.read_manifest(uri)["parts"]} <= files and not old & files
    source(good.limit(0), f"file://{tmp_path}/none")
    assert blocks(spark, f"file://{tmp_path}/none") == []


def test_paths_without_a_file_system(spark, source, tmp_path):
    """Workers don't guess: a bare path is refused, and qualified() makes it one of the session's file system."""
    good = spark.createDataFrame([(1, [1, 2])], "seq long, ids array<int>")
    with pytest.raises(Exception, match="names no file system"):
        source(good, "/tmp/bare")
    assert token_source.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    token_stream.write_stream(good, str(tmp_path / "t"), 100)
    assert token_stream.read_stream(spark, str(tmp_path / "t")).first().ids == [1, 2]


def test_damaged_streams_are_refused(spark, source, tmp_path):
    good = spark.createDataFrame([(1, [1, 2, 3])], "seq long, ids array<int>").coalesce(1)
    uri = f"file://{tmp_path}/s"
    source(good, uri)
    manifest = json.load(open(f"{tmp_path}/s/metadata.json"))
    json.dump(manifest | {"vocabulary": 3}, open(f"{tmp_path}/s/metadata.json", "w"))
    with pytest.raises(Exception, match="outside the vocabulary"):
        blocks(spark, uri)
    manifest["parts"][0]["tokens"] = manifest["tokens"] = 9
    json.dump(manifest, open(f"{tmp_path}/s/metadata.json", "w"))
    with pytest.raises(Exception, match="shorter than"):
        blocks(spark, uri)


def test_lines_are_where_the_index_says(spark, tmp_path):
    draw = random.Random(1)
    for name in "ab":
        with open(f"{tmp_path}/{name}.txt", "wb") as f:
            for i in range(3000):
                f.write(draw.choice(["", "x", "naïve 😀 ", "long " * 50, "carriage\r"]).encode() + b"%d\n" % i)
            f.write(b"the end" if name == "a" else b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        index = line_index.line_index(spark, f"file://{tmp_path}/*.txt").cache()
        found = {(os.path.basename(r.file), r.line): r for r in index.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in "ab":
        data = open(f"{tmp_path}/{name}.txt", "rb").read()
        lines = data.split(b"\n")[: 3001 if name == "a" else 3000]
        assert sum(f == f"{name}.txt" for f, _ in found) == len(lines)
        assert all(data[r.offset : r.offset + r.length] == lines[i] for i in range(len(lines)) if (r := found[f"{name}.txt", i]))
    some = index.sample(0.3, seed=2)
    for r in line_index.read_lines(some).collect():
        data = open(f"{tmp_path}/{os.path.basename(r.file)}", "rb").read()
        assert r.value.encode() == data[r.offset : r.offset + r.length]


def test_table_functions_equal_the_operators(spark, sf_dir):
    udtfs.register(spark)
    found = plans.QUERIES["table_split_documents"](spark, sf_dir)
    wanted = documents.split_documents(plans.docs(spark, sf_dir), 2000)
    assert sorted(map(tuple, found.select("seq", "part", "text").collect())) == sorted(map(tuple, wanted.collect()))
    lengths = spark.createDataFrame([(i, i // 20, 3 + i * 7 % 11) for i in range(60)] + [(60, 2, None)], "seq long, shard long, n long")
    mine = spark.sql("SELECT * FROM next_fit(TABLE({l}) PARTITION BY shard ORDER BY (seq), 12)", l=lengths)
    theirs = tokens.next_fit(lengths.filter("n IS NOT NULL"), 12, "shard").select(*mine.columns)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))


def test_the_sample_chain_over_all_rows(spark, sf_dir):
    """Reason by reason as a loop over the rows finds it, with the rules of a row alone taken from their own operators."""
    from textloom.functions import text as tx
    from textloom.operators import samples

    df = plans.docs(spark, sf_dir).select("seq", "text", "lang", tx.collapse(F.coalesce("text", F.lit(""))).alias("key"))
    rows = df.select("*", samples.sample_quality(F.col("text"), F.lit("chat")).alias("rule"), samples.toxicity_score(F.col("text")).alias("toxic")).orderBy("seq").collect()
    seen, wanted = set(), {}
    for r in rows:
        if r.rule:
            wanted[r.seq] = f"quality:{r.rule}"
        elif r.key in seen:
            wanted[r.seq] = "duplicate"
        else:
            wanted[r.seq] = "language" if r.lang not in ("en", "de") else "toxicity" if r.toxic > 0.5 else "keep"
        if not r.rule:
            seen.add(r.key)
    assert {r.doc_id: r.reason for r in plans.QUERIES["sample_chain_full"](spark, sf_dir).collect()} == wanted
    assert len(set(wanted.values())) > 3
