"""Quotations of a part of a message."""

import pytest

pytest.importorskip("textloom.llm")


def test_excerpts_and_interleaved_answers_are_linked(spark):
    from textloom.llm.quotations import link_quotations

    rows = [
        (1, 0, "First part.\n\nSecond part.\n\nThird part."),
        (1, 1, "line a\nline b\nline c\nline d"),
        (1, 2, "> First part.\n>\n> Second part.\nanswer one\nanswer two\n> Third part.\nanswer three"),
        (1, 3, "> LINE b\n> line  c\nok"),
        (1, 4, "> answer one\n> answer two\nyes"),
        (1, 5, "> line a\n> line c\nnot adjacent"),
        (2, 0, "> line c\n> line d\nelsewhere"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.n_linked, r.parent_conv_id, r.parent_turn) for r in link_quotations(spark, df).collect()}
    assert found == {(1, 0): (0, None, None), (1, 1): (0, 1, 0), (1, 2): (2, 1, 0), (1, 3): (1, 1, 1), (1, 4): (1, 1, 2), (1, 5): (0, 1, 4), (2, 0): (1, 1, 1)}


def test_lines_broken_anew_are_linked(spark):
    from textloom.llm.quotations import link_quotations

    rows = [
        (1, 0, "The quick brown fox jumps\nover the lazy dog and then\nit sleeps all day."),
        (1, 1, "unrelated words here"),
        (1, 2, "> brown fox jumps over\n> the lazy dog\nindeed"),
        (1, 3, "> fox jumps\nfewer than four words aren't looked for within a text"),
        (1, 4, "> row fox jumps over the\nwhole words only"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {r.turn: (r.n_linked, r.parent_turn) for r in link_quotations(spark, df).collect()}
    assert found == {0: (0, None), 1: (0, 0), 2: (1, 0), 3: (0, 2), 4: (0, 3)}


def test_one_passage_quoted_by_nearly_all(spark):
    """30,000 messages quote one passage, half of them in one conversation, and all reply to one message."""
    from textloom.llm.quotations import link_quotations

    said = spark.createDataFrame([(0, 0, "u", "a passage that everyone quotes\nand more")], "conv_id long, turn long, role string, text string")
    quoting = "concat('> A passage that\\n> everyone quotes\\n', id)"
    many = spark.range(1, 30_001).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id END conv_id", "id turn", "'u' role", f"{quoting} text")
    found = link_quotations(spark, said.unionByName(many.withColumn("text", many["text"])))
    rows = found.groupBy("n_linked", "parent_conv_id", "parent_turn", "thread_conv_id", "thread_turn", "depth").count().collect()
    assert {tuple(r) for r in rows} == {(0, None, None, 0, 0, 0, 1), (1, 0, 0, 0, 0, 1, 30_000)}
