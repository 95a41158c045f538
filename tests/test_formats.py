"""Benchmark formats, prompts and small record transforms."""

import json

from pyspark.sql import functions as F

from textloom.operators import formats


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_items(spark):
    c = F.col
    df = one(spark, a="Act", b="They", d="run", e=["x", "y"], n="1", bad="7", letter="B", yes=True, s="a _ b", text="one two three", word="one")
    row = df.select(
        formats.completion(c("a"), c("b"), c("d"), c("e"), c("n")).alias("h"), formats.completion(c("a"), c("b"), c("d"), c("e"), c("bad")).alias("none"),
        formats.question(c("s"), c("e"), c("letter")).alias("q"), formats.question(c("s"), c("e"), F.lit("E")).alias("q_none"), formats.yes_no(c("s"), F.lit(None).cast("string"), c("yes")).alias("y"),
        formats.two_solutions(c("a"), c("b"), c("d"), c("n")).alias("p"), formats.last_word(c("text")).alias("l"), formats.last_word(c("word")).alias("l_none"), formats.blank(c("s"), c("a"), c("b"), F.lit("2")).alias("w"),
    ).first()
    assert row.h.context == "Act: They run" and row.h.label == 1 and row.none is None
    assert row.q.label == 1 and row.q_none is None and row.y.context == "Passage: \nQuestion: a _ b\nAnswer:" and row.y.label == 0
    assert row.p.choices == ["They", "run"] and (row.l.context, row.l.choices) == ("one two ", [" three"]) and row.l_none is None
    assert row.w.context == "a  b" and row.w.label == 1


def test_prompts_and_words(spark):
    df = one(spark, topic="sets", n=3)
    assert df.select(formats.rendered("{n} notes on {topic}, {other}", {"topic": F.col("topic"), "n": F.col("n")})).first()[0] == "3 notes on sets, {other}"
    assert one(spark, t="The Cat, sees. dogs").select(formats.word_by_word(F.col("t"), {"cat": "Katze", "the": "die"})).first()[0] == "die Katze, sees. dogs"


def test_records(spark):
    assert formats.redacted({"api_key": 1, "a": [{"Password": "x", "b": 2}]}) == {"api_key": "***REDACTED***", "a": [{"Password": "***REDACTED***", "b": 2}]}
    assert json.loads(formats.reproducibility({"token": "x"}, 7, one(spark, n=3)))["statistics"] == {"n": 3}
    names = spark.createDataFrame([("step_9",), ("step_10",), ("last",)], ["name"])
    assert formats.latest_checkpoint(names).first().name == "step_10"
    log = spark.createDataFrame([(1, 0.5, 100), (2, 1.5, 100)], "step long, seconds double, tokens long")
    assert formats.training_summary(log).first().avg_tokens_per_sec == 100.0
    lengths = spark.createDataFrame([(i, i) for i in range(10)], "seq long, length long")
    assert formats.length_statistics(lengths, 10).first().median == 5
    windows = formats.random_windows(spark.createDataFrame([(0, list(range(20))), (1, [1])], "seq long, ids array<long>"), 5, 3, 1).collect()
    assert len(windows) == 3 and all(w.ids == list(range(w.ids[0], w.ids[0] + 5)) for w in windows)
