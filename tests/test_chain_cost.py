"""Filters over odd texts against SQL, and how often the chain evaluates them."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from textloom.functions import text as tx
from textloom.operators import dedup, filters, token_stream, tokens
from textloom.plans import queries

PIECES = ["1", "l", "I", "|", "}", "{ ", "\n", " ", "\t", "\r\n", "â€?", "Ã©", "word", "ſex", "poKer", "ſlots", "<b>", "{a}", "var x", "=> {", "café", "\x07", "�", "A" * 85, "\U0001f600", "click here", "[", "]", " "]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    draw = random.Random(7)
    texts = ["".join(draw.choice(PIECES) + draw.choice(["", " ", " "]) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    texts += ["", "1 l 1 I 1 l " * 4, "1\nl\n1\nI\n" * 8, "l 1\n\n1 l\r\n" * 8, "ſex " * 12 + "other words", " [" + "x " * 80 + "] \n", "{" + "y" * 120 + "}"]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["filter_nsfw", "filter_gambling", "filter_seo_spam", "filter_html_code", "filter_ocr_garbage", "filter_unicode_quality", "clean_chain"])
def test_filters_of_odd_texts(spark, odd, same_rows, name):
    path, con = odd
    same_rows(queries.QUERIES[name](spark, path), con, queries.ORACLE[name])


def test_rules_are_evaluated_once_for_reasons(spark, odd):
    """Each automaton's result is used in one place of the plan: no filter on the reason repeats the rules."""
    plan = queries.QUERIES["removal_reasons_top50"](spark, odd[0])._jdf.queryExecution().executedPlan().toString()
    assert "nsfw_density" in plan and plan.count("WHEN") == queries.QUERIES["clean_chain"](spark, odd[0])._jdf.queryExecution().executedPlan().toString().count("WHEN")


def test_alternatives_are_no_loop_of_the_jvm(spark):
    rows = spark.createDataFrame([("a",)], "text string")
    plan = filters.chain(rows, list(queries.CHAIN))._jdf.queryExecution().optimizedPlan().toString()
    assert "casino" not in plan and "escort" not in plan


def test_strip_looks_at_the_ends(spark):
    texts = ["", " ", " a b　", "a", "\x1c\n a", "a \x85", "a b", None]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.strip(tx.F.col("text")).alias("t"))
    assert [r.t for r in found.collect()] == [None if t is None else t.strip() for t in texts]


def test_word_ids_are_those_of_the_sql(spark, odd, same_rows, monkeypatch):
    """Also when a task forgets words, and for texts of no words."""
    path, con = odd
    same_rows(queries.QUERIES["truncate_tokens"](spark, path), con, queries.ORACLE["truncate_tokens"])
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 2)
    known = tokens.WordIds()
    assert [known[w] for w in "a b c a b c é".split()] == [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in "a b c a b c é".split()] and len(known) <= 2
    assert "md5" not in queries._ids(spark, path)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cell_rows", [1, 2, 7, 1000])
def test_chunks_over_borders_of_cells(spark, cell_rows):
    """Long, short, empty and null documents; and ids are shuffled once, but for borders."""
    draw = random.Random(3)
    lists = [None if i % 11 == 3 else list(range(i * 1000, i * 1000 + draw.choice([0, 1, 2, 5, 30]))) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(lists)), "seq long, ids array<long>").repartition(3)
    flat = [x for ids in lists for x in ids or ()]
    found = {r.chunk: (r.ids, r.labels) for r in tokens.chunks(rows, 8, cell_rows).collect()}
    assert found == {i: (flat[i * 8 : i * 8 + 8], flat[i * 8 + 1 : i * 8 + 9]) for i in range((len(flat) - 1) // 8)}


def test_order_of_a_stream_needs_no_ids(spark):
    """Runs of the order by partition; where they end is found without the ids, which a sort would work out twice."""
    made = spark.sparkContext.accumulator(0)

    @tx.F.udf("array<long>")
    def costly(i):
        made.add(1)
        return [i or 0]

    seqs = [None, *range(50, 0, -1), 2**60]
    rows = spark.createDataFrame([(i,) for i in seqs], "seq long").repartition(3).withColumn("ids", costly("seq"))
    parts = token_stream.in_order(rows).rdd.glom().map(lambda part: [r.seq for r in part]).collect()
    assert [x for part in parts for x in part] == [None, *range(1, 51), 2**60]
    assert made.value == len(seqs) and sum(map(bool, parts)) > 1


def test_modulo_without_division():
    v = np.array([0, 1, dedup.PRIME - 1, dedup.PRIME, dedup.PRIME + 1, 2 * dedup.PRIME, 2**64 - 1, 2**63, (dedup.PRIME - 1) ** 2 + dedup.PRIME - 1], dtype=np.uint64)
    assert (dedup.modulo_prime(v.copy()) == v % np.uint64(dedup.PRIME)).all()
