"""Generated samples: code is run, answers are worked out again."""

import json

import pytest

from textloom.operators import tasks


@pytest.mark.filterwarnings("ignore")
def test_code_gives_what_is_expected(spark):
    rows = tasks.code_samples(spark, 600, 3).collect()
    assert {r.family for r in rows} == set(tasks.CODE) and len(tasks.CODE) == 17
    for r in rows:
        scope: dict = {}
        exec(r.code, scope)
        assert str(eval(r.call, scope)) == r.expected, (r.family, r.call)
    assert rows == tasks.code_samples(spark, 600, 3).repartition(3).orderBy("id").collect()


def test_debugging_changes_the_code(spark):
    rows = tasks.debugging_samples(spark, 400, 3).collect()
    assert len({r.mistake for r in rows}) == len(tasks.MISTAKES)
    for r in rows:
        broken = r.prompt.split("```python\n")[1].removesuffix("\n```")
        assert r.mistake and broken != r.response.removeprefix("```python\n").removesuffix("\n```")


def test_reasoning_and_instructions(spark):
    by = {}
    for r in tasks.reasoning_samples(spark, 400, 3).collect() + tasks.instruction_samples(spark, 400, 3).collect():
        by.setdefault(r.family, []).append(r)
    assert set(by) == set(tasks.REASONING) | set(tasks.INSTRUCTION)
    wanted = {
        "sequence": lambda r: str(r.a + 4 * r.small),
        "ages": lambda r: str(r.a + r.small + 10),
        "distance": lambda r: f"{r.a * r.small} km",
        "comparison": lambda r: str(abs(r.a - r.b)) if r.a != r.b else "same",
        "sharing": lambda r: f"gets {r.b // r.small}, and {r.b % r.small}",
        "capitals": lambda r: r.sentence.upper(),
        "sort": lambda r: " ".join(sorted(r.sentence.split())),
        "first": lambda r: " ".join(w[0] for w in r.sentence.split()),
        "list": lambda r: "\n".join(f"{i}. {w}" for i, w in enumerate(r.sentence.split(), 1)),
        "json": lambda r: json.dumps({"word": r.word, "number": r.a}, separators=(",", ":")),
        "syllogism": lambda r: r.word,
    }
    for family, rows in by.items():
        assert all(wanted[family](r) in r.response for r in rows), family
    assert all(r.prompt and "%" not in r.prompt for rows in by.values() for r in rows)


def test_passages_phrases_and_tools(spark):
    passages = tasks.passage_samples(spark, 300, 3).collect()
    assert len({r.task_type for r in passages}) == 5
    assert all(r.response in r.passage for r in passages if r.task_type != "summarization")
    pairs = {(p[i], p[j]) for p in tasks.PHRASES for i in range(4) for j in range(4) if i != j}
    for r in tasks.translation_samples(spark, 200, 3).collect():
        assert r.source_language != r.target_language and (r.prompt.split(": ", 1)[1], r.response) in pairs
    tools = tasks.tool_samples(spark, 400, 3).collect()
    assert {r.tool for r in tools} == set(tasks.TOOLS) and len(tasks.TOOLS) == 9
    for r in tools:
        call = json.loads(r.response)
        assert call["tool"] == r.tool and set(call["arguments"]) == set(tasks.TOOLS[r.tool][1]) and all(str(v) in r.prompt for v in call["arguments"].values())


def test_sql_tasks_run(spark, sf_dir):
    tables = {t["table"]: spark.read.parquet(f"{sf_dir}/{t['table']}.parquet") for t in tasks.SCHEMAS}
    made = tasks.sql_tasks()
    assert len(made) == len(tasks.SHAPES) * len(tasks.SCHEMAS)
    for t in made[:: 3]:
        assert tasks.run_task(spark, t["statement"], tables).limit(5).collect() is not None
    assert {r.response for r in tasks.sql_task_samples(spark, 50, 3).collect()} <= {t["statement"] for t in made}
