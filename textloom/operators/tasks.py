"""Sample generators beyond arithmetic: code, its debugging, reasoning, instructions, passages, phrases, tool calls, SQL tasks.

All are one range, whose rows draw their parameters by hashes of seed and id; so a
sample is the same in whatever number of partitions it is made. Answers are
expressions over the parameters; the tests work them out again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import collatz_steps, difficulty, digit_sum, draw, fibonacci, greatest_common_divisor, is_prime, sum_to

WORDS = ("amber", "basket", "candle", "dragon", "engine", "forest", "garden", "hollow", "island", "jungle", "kettle", "level", "mirror", "noon", "orbit", "planet")
VOWELS = "aeiou"


def pick(options: Column | tuple, at: Column) -> Column:
    """The option that a number chooses."""
    array = F.array(*[F.lit(o) for o in options]) if isinstance(options, tuple) else options
    return F.element_at(array, (F.pmod(at, F.size(array)) + 1).cast("int"))


def chosen(name: Column, cases: dict[str, Column]) -> Column:
    """The case of a name; others aren't evaluated."""
    items = list(cases.items())
    return functools.reduce(lambda c, x: c.when(name == x[0], x[1]), items[1:], F.when(name == items[0][0], items[0][1]))


def text(value: Column) -> Column:
    return value.cast("string")


# Code


def _numbers() -> Column:
    """Five numbers that depend on a and b."""
    return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.pmod(F.col("a") * i * 7 + F.col("b") * 3, F.lit(90)))


def _count_of(word: Column, letters: str) -> Column:
    return F.length(word) - F.length(F.translate(word, letters, ""))


def _shifted(word: Column, by: Column) -> Column:
    """Each small letter moved on in the alphabet."""
    codes = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.pmod(F.ascii(F.substr(word, i, F.lit(1))) - 97 + by, F.lit(26)) + 97)
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


#: Family -> problem, body of a Python function f, its arguments, and the value it has. %1$d and %2$d are a and b, %3$s is a word, %4$s numbers, %5$s a sentence.
CODE: dict[str, tuple[str, str, str, Callable[[], Column]]] = {
    "sum_multiples": ("Add all multiples of 3 from 1 to %1$d.", "def f(n):\n    total = 0\n    for i in range(1, n + 1):\n        if i %% 3 == 0:\n            total += i\n    return total", "%1$d", lambda: text(3 * sum_to(F.floor(F.col("a") / 3)))),
    "factorial": ("Give the factorial of %6$d.", "def f(n):\n    out = 1\n    for i in range(2, n + 1):\n        out *= i\n    return out", "%6$d", lambda: text(F.factorial(F.col("small").cast("int")))),
    "fib": ("Give Fibonacci number %1$d, where numbers 1 and 2 are 1.", "def f(n):\n    x, y = 0, 1\n    for i in range(n):\n        x, y = y, x + y\n    return x", "%1$d", lambda: text(fibonacci(F.col("a")))),
    "is_prime": ("Is %1$d a prime number?", "def f(n):\n    if n < 2:\n        return False\n    for i in range(2, n):\n        if n %% i == 0:\n            return False\n    return True", "%1$d", lambda: F.when(is_prime(F.col("a")), "True").otherwise("False")),
    "gcd": ("Give the greatest common divisor of %1$d and %2$d.", "def f(x, y):\n    while y > 0:\n        x, y = y, x %% y\n    return x", "%1$d, %2$d", lambda: text(greatest_common_divisor(F.col("a"), F.col("b")))),
    "sum_digits": ("Add the digits of %1$d%2$d.", "def f(n):\n    total = 0\n    while n > 0:\n        total += n %% 10\n        n //= 10\n    return total", "%1$d%2$d", lambda: text(digit_sum(F.col("a")) + digit_sum(F.col("b")))),
    "collatz": ("Count the Collatz steps from %1$d to 1.", "def f(n):\n    steps = 0\n    while n > 1:\n        n = n // 2 if n %% 2 == 0 else 3 * n + 1\n        steps += 1\n    return steps", "%1$d", lambda: text(collatz_steps(F.col("a")))),
    "sum_squares": ("Add the squares of the numbers from 1 to %1$d.", "def f(n):\n    total = 0\n    for i in range(1, n + 1):\n        total += i * i\n    return total", "%1$d", lambda: text(F.floor(F.col("a") * (F.col("a") + 1) * (2 * F.col("a") + 1) / 6))),
    "rev_str": ("Reverse the word %3$s.", "def f(s):\n    return s[::-1]", "'%3$s'", lambda: F.reverse("word")),
    "palindrome": ("Does %3$s read the same backwards?", "def f(s):\n    return s == s[::-1]", "'%3$s'", lambda: F.when(F.col("word") == F.reverse("word"), "True").otherwise("False")),
    "caesar": ("Move each letter of %3$s on by %6$d places in the alphabet.", "def f(s, k):\n    return ''.join(chr((ord(c) - 97 + k) %% 26 + 97) for c in s)", "'%3$s', %6$d", lambda: _shifted(F.col("word"), F.col("small"))),
    "vowels": ("Count the vowels of %3$s.", "def f(s):\n    total = 0\n    for c in s:\n        if c in 'aeiou':\n            total += 1\n    return total", "'%3$s'", lambda: text(_count_of(F.col("word"), VOWELS))),
    "consonants": ("Count the consonants of %3$s.", "def f(s):\n    total = 0\n    for c in s:\n        if c not in 'aeiou':\n            total += 1\n    return total", "'%3$s'", lambda: text(F.length("word") - _count_of(F.col("word"), VOWELS))),
    "find_max": ("Find the largest of %4$s.", "def f(xs):\n    best = xs[0]\n    for x in xs:\n        if x > best:\n            best = x\n    return best", "[%4$s]", lambda: text(F.array_max(_numbers()))),
    "sum_list": ("Add %4$s.", "def f(xs):\n    total = 0\n    for x in xs:\n        total += x\n    return total", "[%4$s]", lambda: text(F.aggregate(_numbers(), F.lit(0).cast("long"), lambda s, x: s + x))),
    "word_count": ("Count the words of: %5$s", "def f(s):\n    return len(s.split())", "'%5$s'", lambda: text(F.size(F.split("sentence", " ")))),
    "triangular": ("Add the numbers from 1 to %1$d.", "def f(n):\n    return n * (n + 1) // 2", "%1$d", lambda: text(sum_to(F.col("a")))),
}


def _drawn(spark: SparkSession, n: int, seed: int, names: tuple[str, ...]) -> DataFrame:
    """id, family and the parameters a, b, small, word, sentence of n rows."""
    rows = spark.range(n).withColumn("family", pick(names, draw(seed, "family", 0, 1_000_003))).withColumn("a", draw(seed, "a", 2, 60)).withColumn("b", draw(seed, "b", 2, 99))
    rows = rows.withColumn("small", draw(seed, "small", 1, 12)).withColumn("word", pick(WORDS, draw(seed, "word", 0, 1_000_003)))
    some = F.transform(F.sequence(F.lit(1), F.col("small")), lambda i: pick(WORDS, F.col("a") * i + F.col("b")))
    return rows.withColumn("sentence", F.array_join(some, " "))


def _filled(template: str) -> Column:
    numbers = F.array_join(_numbers().cast("array<string>"), ", ")
    return F.format_string(template, F.col("a"), F.col("b"), F.col("word"), numbers, F.col("sentence"), F.col("small"))


def code_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, task_type, family, difficulty, prompt, code, call, expected: a problem, a function that solves it, and its value."""
    rows = _drawn(spark, n, seed, tuple(CODE))
    part = lambda k: chosen(F.col("family"), {name: _filled(x[k]) for name, x in CODE.items()})
    expected = chosen(F.col("family"), {name: x[3]() for name, x in CODE.items()})
    return rows.select(F.format_string("code-%06d", "id").alias("id"), F.lit("coding").alias("task_type"), "family", difficulty(n).alias("difficulty"), part(0).alias("prompt"), part(1).alias("code"), F.concat(F.lit("f("), part(2), F.lit(")")).alias("call"), expected.alias("expected"))


#: Mistakes: what stands in working code, and what stands there instead.
MISTAKES = ((" + 1)", ")"), ("range(1,", "range(0,"), ("range(2,", "range(1,"), ("total += ", "total -= "), ("total = 0", "total = 1"), ("return total", "return None"), (" == ", " != "), (" > ", " < "), ("return ", "retrun "))


def debugging_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, task_type, family, prompt (with broken code), mistake, response (the working code): one mistake, the first that fits from a drawn one on."""
    rows = code_samples(spark, n, seed).withColumn("first", F.pmod(F.xxhash64(F.lit(seed), F.lit("mistake"), "id"), F.lit(len(MISTAKES))))
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.replace("code", F.lit(old), F.lit(new)).alias("broken"), F.lit(f"{old.strip()} -> {new.strip()}").alias("mistake")) for i, (old, new) in enumerate(MISTAKES)])
    turned = F.array_sort(F.transform(F.filter(every, lambda m: m["broken"] != F.col("code")), lambda m: F.struct(F.pmod(m["i"] - F.col("first"), F.lit(len(MISTAKES))).alias("turn"), m["broken"].alias("broken"), m["mistake"].alias("mistake"))))
    rows = rows.withColumn("m", F.get(turned, F.lit(0)))
    prompt = F.concat(F.lit("This code should solve a problem but has a mistake.\nProblem: "), "prompt", F.lit("\n\n```python\n"), "m.broken", F.lit("\n```"))
    return rows.select(F.regexp_replace("id", "^code", "debug").alias("id"), F.lit("debugging").alias("task_type"), "family", prompt.alias("prompt"), F.col("m.mistake").alias("mistake"), F.concat(F.lit("```python\n"), "code", F.lit("\n```")).alias("response"))


# Reasoning and instructions


def _templates(spark: SparkSession, n: int, seed: int, kind: str, cases: dict[str, tuple[str, Callable[[], Column]]]) -> DataFrame:
    rows = _drawn(spark, n, seed, tuple(cases))
    prompt = chosen(F.col("family"), {name: _filled(x[0]) for name, x in cases.items()})
    answer = chosen(F.col("family"), {name: x[1]() for name, x in cases.items()})
    return rows.select(F.format_string(f"{kind}-%06d", "id").alias("id"), F.lit(kind).alias("task_type"), "family", difficulty(n).alias("difficulty"), "a", "b", "small", "word", "sentence", prompt.alias("prompt"), answer.alias("response"))


REASONING: dict[str, tuple[str, Callable[[], Column]]] = {
    "sequence": ("A sequence starts at %1$d and grows by %6$d each time. Which number is fifth?", lambda: F.format_string("Four steps of %d are %d. Added to %d that is %d.", "small", 4 * F.col("small"), "a", F.col("a") + 4 * F.col("small"))),
    "ages": ("Ann is %1$d. Ben is %6$d years older than Ann. How old is Ben in ten years?", lambda: F.format_string("Ben is %d now, so %d in ten years.", F.col("a") + F.col("small"), F.col("a") + F.col("small") + 10)),
    "distance": ("A train travels %1$d km an hour for %6$d hours. How far does it get?", lambda: F.format_string("%d times %d is %d km.", "a", "small", F.col("a") * F.col("small"))),
    "syllogism": ("Every %3$s is heavy. This thing is not heavy. Can it be a %3$s?", lambda: F.format_string("No. If it were a %s, it would be heavy.", "word")),
    "comparison": ("One box holds %1$d stones, another %2$d. Which holds more, and by how many?", lambda: F.when(F.col("a") == F.col("b"), "They hold the same.").when(F.col("a") > F.col("b"), F.format_string("The first, by %d.", F.col("a") - F.col("b"))).otherwise(F.format_string("The second, by %d.", F.col("b") - F.col("a")))),
    "sharing": ("%2$d coins are shared evenly among %6$d people. How many does each get, and how many are left?", lambda: F.format_string("Each gets %d, and %d are left.", F.floor(F.col("b") / F.col("small")), F.col("b") % F.col("small"))),
}

INSTRUCTION: dict[str, tuple[str, Callable[[], Column]]] = {
    "capitals": ("Write in capital letters: %5$s", lambda: F.upper("sentence")),
    "sort": ("Put these words in alphabetical order: %5$s", lambda: F.array_join(F.array_sort(F.split("sentence", " ")), " ")),
    "first": ("Give the first letter of each word: %5$s", lambda: F.array_join(F.transform(F.split("sentence", " "), lambda w: F.substring(w, 1, 1)), " ")),
    "json": ("Write as a JSON object with the keys word and number: %3$s, %1$d", lambda: F.to_json(F.struct(F.col("word").alias("word"), F.col("a").alias("number")))),
    "list": ("Make a numbered list of: %5$s", lambda: F.array_join(F.transform(F.split("sentence", " "), lambda w, i: F.concat(text(i + 1), F.lit(". "), w)), "\n")),
}


def reasoning_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _templates(spark, n, seed, "reasoning", REASONING)


def instruction_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _templates(spark, n, seed, "instruction", INSTRUCTION)


# Passages

PEOPLE, PLACES, THINGS = ("Mara", "Jonas", "Lena", "Tomas", "Ines"), ("the harbour", "the old mill", "the market", "the library"), ("bread", "lamps", "maps", "boats")


def passage_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, task_type (summarization or one of four kinds of question), passage, prompt, response, from the passage's own slots."""
    rows = _drawn(spark, n, seed, ("summarization", "who", "where", "what", "how_many"))
    at = lambda salt, options: pick(options, draw(seed, salt, 0, 1_000_003))
    rows = rows.withColumn("who", at("who", PEOPLE)).withColumn("where", at("where", PLACES)).withColumn("what", at("what", THINGS))
    passage = F.format_string("%s lives near %s and makes %s. In a good week %d of them are sold, in a bad one only %d. People come from far away, since nobody else near %s makes them.", "who", "where", "what", F.col("a") + F.col("b"), "b", "where")
    prompt = chosen(F.col("family"), {"summarization": F.lit("Summarize in one sentence."), "who": F.format_string("Who makes the %s?", "what"), "where": F.format_string("Near what does %s live?", "who"), "what": F.format_string("What does %s make?", "who"), "how_many": F.lit("How many are sold in a good week?")})
    answer = chosen(F.col("family"), {"summarization": F.format_string("%s sells %s near %s.", "who", "what", "where"), "who": F.col("who"), "where": F.col("where"), "what": F.col("what"), "how_many": text(F.col("a") + F.col("b"))})
    return rows.select(F.format_string("passage-%06d", "id").alias("id"), F.col("family").alias("task_type"), passage.alias("passage"), prompt.alias("prompt"), answer.alias("response"))


#: English, German, French, Spanish.
PHRASES = (
    ("good morning", "guten Morgen", "bonjour", "buenos días"), ("thank you", "danke", "merci", "gracias"), ("see you tomorrow", "bis morgen", "à demain", "hasta mañana"),
    ("the house is red", "das Haus ist rot", "la maison est rouge", "la casa es roja"), ("I am hungry", "ich habe Hunger", "j'ai faim", "tengo hambre"), ("where is the station", "wo ist der Bahnhof", "où est la gare", "dónde está la estación"),
)
LANGUAGES = ("English", "German", "French", "Spanish")


def translation_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, task_type, source_language, target_language, prompt, response from the bank of phrases; the languages differ."""
    bank = F.array(*[F.array(*[F.lit(p) for p in row]) for row in PHRASES])
    rows = spark.range(n).withColumn("phrase", pick(bank, draw(seed, "phrase", 0, 1_000_003))).withColumn("s", draw(seed, "source", 0, 3)).withColumn("t", F.pmod(F.col("s") + draw(seed, "target", 1, 3), F.lit(4)))
    word = lambda c: F.element_at("phrase", (F.col(c) + 1).cast("int"))
    prompt = F.concat(F.lit("Translate from "), pick(LANGUAGES, F.col("s")), F.lit(" to "), pick(LANGUAGES, F.col("t")), F.lit(": "), word("s"))
    return rows.select(F.format_string("translation-%06d", "id").alias("id"), F.lit("translation").alias("task_type"), pick(LANGUAGES, F.col("s")).alias("source_language"), pick(LANGUAGES, F.col("t")).alias("target_language"), prompt.alias("prompt"), word("t").alias("response"))


#: Tool -> request and arguments; slots are filled as those of code are.
TOOLS: dict[str, tuple[str, dict[str, str]]] = {
    "get_weather": ("What will the weather be in %3$s in %6$d days?", {"place": "word", "days": "small"}),
    "convert_currency": ("How much are %1$d euros in dollars?", {"amount": "a"}),
    "set_timer": ("Set a timer for %1$d minutes.", {"minutes": "a"}),
    "send_message": ("Tell %3$s that I come %6$d minutes late.", {"to": "word", "minutes": "small"}),
    "search_files": ("Find files about %5$s.", {"query": "sentence"}),
    "create_event": ("Put %3$s on my calendar at %6$d o'clock.", {"title": "word", "hour": "small"}),
    "calculate": ("What is %1$d times %2$d?", {"x": "a", "y": "b"}),
    "translate": ("Say %3$s in another language.", {"text": "word"}),
    "book_table": ("Book a table for %6$d at %3$s.", {"people": "small", "name": "word"}),
}


def tool_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, task_type, tool, prompt, response: the call as JSON with its arguments."""
    rows = _drawn(spark, n, seed, tuple(TOOLS))
    prompt = chosen(F.col("family"), {name: _filled(x[0]) for name, x in TOOLS.items()})
    call = chosen(F.col("family"), {name: F.to_json(F.struct(F.lit(name).alias("tool"), F.struct(*[F.col(c).alias(k) for k, c in x[1].items()]).alias("arguments"))) for name, x in TOOLS.items()})
    return rows.select(F.format_string("tool-%06d", "id").alias("id"), F.lit("function_calling").alias("task_type"), F.col("family").alias("tool"), prompt.alias("prompt"), call.alias("response"))


# SQL tasks

#: Question and statement, over a table with a key, a group and a number.
SHAPES: dict[str, tuple[str, str]] = {
    "filter_count": ("How many rows of {table} have a {number} above {limit}?", "SELECT count(*) AS n FROM {table} WHERE {number} > {limit}"),
    "average": ("What is the mean {number} in {table}?", "SELECT round(avg({number}), 6) AS mean FROM {table}"),
    "extremes": ("What are the least and the largest {number} in {table}?", "SELECT min({number}) AS least, max({number}) AS most FROM {table}"),
    "total": ("What is the sum of {number} in {table}?", "SELECT round(sum({number}), 2) AS total FROM {table}"),
    "group_by": ("How many rows of {table} does each {group} have?", "SELECT {group} AS g, count(*) AS n FROM {table} GROUP BY {group}"),
    "having": ("Which {group} of {table} have more than {limit} rows?", "SELECT {group} AS g FROM {table} GROUP BY {group} HAVING count(*) > {limit}"),
    "top_group": ("Which {group} of {table} has the largest sum of {number}?", "SELECT {group} AS g, round(sum({number}), 2) AS total FROM {table} GROUP BY {group} ORDER BY total DESC, g LIMIT 1"),
    "running": ("Add the numbers from 1 to {limit}, one by one.", "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < {limit}) SELECT n, total FROM t"),
}
SCHEMAS = (
    {"table": "lineitem", "group": "l_returnflag", "number": "l_quantity"},
    {"table": "orders", "group": "o_custkey", "number": "o_totalprice"},
    {"table": "customer", "group": "c_nationkey", "number": "c_acctbal"},
    {"table": "supplier", "group": "s_nationkey", "number": "s_acctbal"},
    {"table": "part", "group": "p_size", "number": "p_retailprice"},
)


def sql_tasks(limit: int = 20) -> list[dict[str, str]]:
    """All tasks: shape, table, question and statement. They are as many as shapes and schemas make."""
    out = []
    for shape, (question, statement) in SHAPES.items():
        for schema in SCHEMAS:
            values = {**schema, "limit": str(limit)}
            out.append({"shape": shape, "table": schema["table"], "question": question.format(**values), "statement": statement.format(**values)})
    return out


def sql_task_samples(spark: SparkSession, n: int, seed: int = 0, limit: int = 20) -> DataFrame:
    """id, task_type, shape, prompt, response: drawn tasks."""
    tasks = sql_tasks(limit)
    bank = F.array(*[F.struct(*[F.lit(t[k]).alias(k) for k in ("shape", "question", "statement")]) for t in tasks])
    rows = spark.range(n).withColumn("t", pick(bank, draw(seed, "task", 0, 1_000_003)))
    return rows.select(F.format_string("sql-%06d", "id").alias("id"), F.lit("sql").alias("task_type"), F.col("t.shape").alias("shape"), F.col("t.question").alias("prompt"), F.col("t.statement").alias("response"))


def run_task(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A generated statement's result; whether it runs is what makes it a sample."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)
