"""Queries of branches and small operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import mixture, samples, token_stream, tokens
from ..sources import readers, writers
from ..storage import Tables
from .queries import IDS, SCORED, TURNS, _ids, _turns, docs, query, strip_sql, table

BARE = f"length({strip_sql('text')})"
PLAIN = "least(1, greatest(0, least(1.0, {n} / 250.0) * 0.85 + {bonus} + CASE WHEN {n} BETWEEN 40 AND 4000 THEN 0.05 ELSE 0 END))"


@query("build_stats", f"""
    WITH s AS (SELECT lang, source, round({PLAIN.format(n=BARE, bonus='0.1')}, 4) AS quality, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN {BARE} < 200 THEN 'too_short' END AS reason FROM documents),
    g AS (SELECT 'total' AS dimension, 'all' AS value, quality FROM s WHERE reason IS NULL UNION ALL SELECT 'lang', lang, quality FROM s WHERE reason IS NULL
          UNION ALL SELECT 'source', source, quality FROM s WHERE reason IS NULL UNION ALL SELECT 'reason', reason, NULL FROM s WHERE reason IS NOT NULL)
    SELECT dimension, value, count(*) AS docs, round(avg(quality), 3) AS mean_quality FROM g GROUP BY dimension, value""")
def build_stats(spark, sf_dir):
    """Kept documents and their mean quality by language and source, and why the others went."""
    quality = samples.composite_quality(F.lit(None).cast("string"), F.col("text"), F.lit(True))
    reason = F.when(~F.col("lang").isin("en", "de"), "language").when(F.length(tx.strip(F.col("text"))) < 200, "too_short")
    rows = table(spark, sf_dir, "documents").select("lang", "source", quality.alias("quality"), reason.alias("reason"))
    return mixture.build_stats(rows, "lang", "source").withColumn("mean_quality", F.round("mean_quality", 3))


@query("composite_branches", f"SELECT conv_id, turn, CAST(round(CASE WHEN length(a) > 0 AND turn % 3 > 0 THEN {SCORED} ELSE {PLAIN.format(n='length(' + strip_sql('b') + ')', bonus='CASE WHEN turn % 2 = 0 THEN 0.1 ELSE 0 END')} END, 3) AS DOUBLE) AS score FROM {TURNS}")
def composite_branches(spark, sf_dir):
    """Turns as reasoning (every third has none) of the turn after it, with an input at even turns: all branches of the score."""
    reasoning = F.when(F.col("turn") % 3 > 0, F.col("reasoning"))
    score = samples.composite_quality(reasoning, F.col("response"), F.col("turn") % 2 == 0)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(score, 3).alias("score"))


@query("gold_kinds", f"SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END) / 2.0 AS share, CASE WHEN {BARE} >= 40 THEN 1.0 ELSE 0.0 END AS length_40, 0.0 AS unknown FROM documents")
def gold_kinds(spark, sf_dir):
    gold = F.array(F.lit("The"), F.lit("dEr"))
    of = lambda kind: samples.gold_score(F.lit(kind), F.col("text"), gold)
    return table(spark, sf_dir, "documents").select("doc_id", of("all_substr_ci").alias("share"), of("length_40").alias("length_40"), of("another").alias("unknown"))


NUMBERS = "list_distinct(regexp_extract_all({}, '[0-9]+'))"


@query("jaccard_conventions", f"""
    WITH n AS (SELECT a.doc_id, {NUMBERS.format('a.text')} AS x, {NUMBERS.format('b.text')} AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    j AS (SELECT doc_id, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0) AS s FROM n)
    SELECT doc_id, round(CASE WHEN nx = 0 AND ny = 0 THEN 1.0 WHEN nx = 0 OR ny = 0 THEN 0.0 ELSE s END, 6) AS equal_if_empty, round(CASE WHEN nx = 0 OR ny = 0 THEN 0.0 ELSE s END, 6) AS zero_if_empty,
           round(CASE WHEN nx > 0 AND ny > 0 THEN s END, 6) AS skipped_if_empty FROM j""")
def jaccard_conventions(spark, sf_dir):
    """The numbers in a document and in the one after it, with each of the three ways to count empty sets."""
    d = table(spark, sf_dir, "documents")
    numbers = lambda name: d.select((F.col("doc_id") - int(name == "y")).alias("doc_id"), F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias(name))
    both, x, y = numbers("x").join(numbers("y"), "doc_id"), F.col("x"), F.col("y")
    ways = {"equal_if_empty": (1.0, 0.0), "zero_if_empty": (0.0, 0.0), "skipped_if_empty": (None, None)}
    return both.select("doc_id", *[F.round(tx.jaccard_or(x, y, *how), 6).alias(name) for name, how in ways.items()])


@query("tail_blocks", f"""
    WITH s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS p, t FROM (SELECT doc_id, unnest({IDS}) AS t, generate_subscripts({IDS}, 1) AS i FROM documents)),
    v AS (SELECT p - b AS p, t FROM s, (SELECT CAST(floor(count(*) * (1 - 0.05)) AS BIGINT) AS b FROM s) WHERE p >= b)
    SELECT CAST(p // 128 AS BIGINT) AS block, md5(string_agg(CAST(t AS VARCHAR), ',' ORDER BY p)) AS ids FROM v GROUP BY p // 128 HAVING count(*) = 128""")
def tail_blocks(spark, sf_dir):
    """The last twentieth of all tokens, for validation, in blocks."""
    found = tokens.tail_blocks(_ids(spark, sf_dir), 0.05, 128)
    return found.select(F.col("block").cast("long").alias("block"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("token_round_trip", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def token_round_trip(spark, sf_dir):
    """All documents encoded with an id before and after, and decoded again."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    ids = token_stream.encode(docs(spark, sf_dir), file, 50256, 50256)
    return token_stream.decode(ids, file, (50256,)).select(F.col("seq").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("metric_log", "SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def metric_log(spark, sf_dir):
    """All events as a long log of metrics, added to in two parts and read back."""
    path = f"{Tables(spark).root}/metrics"
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    for part in (0, 1):
        writers.metric_log(rows.filter(F.col("step") % 2 == part), path)
    read = readers.csv_rows(spark, path, "step long, metric string, value double")
    return read.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("scored_samples", f"SELECT conv_id, turn, CAST(round({SCORED}, 6) AS DOUBLE) AS reasoning, {SCORED} >= 0.4 AS keep FROM {TURNS}")
def scored_samples(spark, sf_dir):
    """Scores of a sample against their least values; there are no log probabilities here, so confidence is null and passes."""
    rows = _turns(spark, sf_dir).withColumn("logprobs", F.lit(None).cast("array<double>"))
    return samples.scored(rows, {"confidence_score": 0.9, "reasoning_score": 0.4}).select("conv_id", "turn", F.round("reasoning_score", 6).alias("reasoning"), "keep")
