"""Deterministic sample generators: one range, hashes for choices, answers as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, salt: str, low: int, high: int) -> Column:
    """An integer in low..high that depends on the seed, the salt and the row's id alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(high - low + 1)) + low).cast("long")


def difficulty(total: int) -> Column:
    share = F.col("id") / total
    return F.when(share < 0.4, "easy").when(share < 0.8, "medium").otherwise("hard")


def sum_to(n: Column) -> Column:
    return F.floor(n * (n + 1) / 2)


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """Euclid's steps folded over more of them than 64-bit numbers can need."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("x"), b.alias("y")), lambda p, _: F.struct(F.when(p["y"] == 0, p["x"]).otherwise(p["y"]).alias("x"), F.when(p["y"] == 0, F.lit(0).cast("long")).otherwise(p["x"] % F.nullif(p["y"], F.lit(0))).alias("y")))
    return pair["x"]


def fibonacci(n: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), zero, lambda p, _: F.struct(p["b"].alias("a"), (p["a"] + p["b"]).alias("b")))["a"]


def is_prime(n: Column) -> Column:
    return (n > 1) & ~F.exists(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(n)).cast("int"))), lambda d: d < n), lambda d: n % d == 0)


def digit_sum(n: Column) -> Column:
    return F.aggregate(F.filter(F.split(n.cast("string"), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + c.cast("long"))


def collatz_steps(n: Column, most: int = 200) -> Column:
    zero = F.struct(n.alias("x"), F.lit(0).cast("long").alias("k"))
    nxt = lambda x: F.when(x % 2 == 0, F.floor(x / 2)).otherwise(3 * x + 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, lambda p, _: F.when(p["x"] <= 1, p).otherwise(F.struct(nxt(p["x"]).alias("x"), (p["k"] + 1).alias("k"))))["k"]


#: Family -> prompt and answer, from the numbers a and b of a row.
FAMILIES = {
    "arithmetic": ("Compute %d + %d.", lambda a, b: (a + b).cast("string")),
    "algebra": ("Solve x + %d = %d for x.", lambda a, b: (b - a).cast("string")),
    "geometry": ("What is the area of a %d by %d rectangle?", lambda a, b: (a * b).cast("string")),
    "triangular": ("Sum the whole numbers from 1 to %d. (Note %d.)", lambda a, b: sum_to(a).cast("string")),
    "gcd": ("What is the greatest common divisor of %d and %d?", lambda a, b: greatest_common_divisor(a, b).cast("string")),
    "fibonacci": ("What is Fibonacci number %d? (Note %d.)", lambda a, b: fibonacci(a).cast("string")),
    "is_prime": ("Is %d a prime number? (Note %d.)", lambda a, b: F.when(is_prime(a), "yes").otherwise("no")),
    "sum_digits": ("Add the digits of %d%d.", lambda a, b: (digit_sum(a) + digit_sum(b)).cast("string")),
    "collatz": ("How many Collatz steps does %d take to 1? (Note %d.)", lambda a, b: collatz_steps(a).cast("string")),
    "reverse": ("Reverse the digits %d%d.", lambda a, b: F.reverse(F.concat(a.cast("string"), b.cast("string")))),
    "summing": ("Add all multiples of 3 up to %d. (Note %d.)", lambda a, b: (3 * sum_to(F.floor(a / 3))).cast("string")),
}


def math_samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, task_type, family, difficulty, prompt, response, in as many partitions as the range has; the same for any."""
    names = list(FAMILIES)
    rows = spark.range(n).withColumn("k", draw(seed, "family", 0, len(names) - 1)).withColumn("a", draw(seed, "a", 2, 60)).withColumn("b", draw(seed, "b", 2, 99))
    prompt = answer = None
    for k, name in enumerate(names):
        shape, solve = FAMILIES[name]
        hit = F.col("k") == k
        text = F.format_string(shape, "a", "b")
        prompt = F.when(hit, text) if prompt is None else prompt.when(hit, text)
        value = solve(F.col("a"), F.col("b"))
        answer = F.when(hit, value) if answer is None else answer.when(hit, value)
    family = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") + 1).cast("int"))
    return rows.select(F.format_string("math-%06d", "id").alias("id"), F.lit("math").alias("task_type"), family.alias("family"), difficulty(n).alias("difficulty"), "a", "b", prompt.alias("prompt"), answer.alias("response"))


def flat_catalog(spark: SparkSession, catalog: dict[str, dict[str, list[str]]]) -> DataFrame:
    """id (seed-00000 ... in nesting order), domain, subdomain, concept."""
    rows = spark.createDataFrame([(d, i, s, j, list(c)) for i, (d, subs) in enumerate(catalog.items()) for j, (s, c) in enumerate(subs.items())], "domain string, i int, subdomain string, j int, concepts array<string>")
    each = rows.select("domain", "i", "subdomain", "j", F.posexplode("concepts").alias("k", "concept"))
    from pyspark.sql import Window

    return each.withColumn("n", F.row_number().over(Window.orderBy("i", "j", "k")) - 1).select(F.format_string("seed-%05d", "n").alias("id"), "domain", "subdomain", "concept")
