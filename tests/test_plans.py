"""Every query with SQL against DuckDB; the others against brute force or by their invariants."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import dedup, documents, evaluation, filters, generate, mixture, normalize, quality, samples, tokens
from textloom.plans import queries as plans
from textloom.sources import readers, writers
from textloom.streaming import clean


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_sql(spark, sf_dir, duck, same_rows, name):
    same_rows(plans.QUERIES[name](spark, sf_dir), duck, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_without_sql_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() >= 0


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)], "seq long, text string, lang string, source string")


def rules(spark, name, *rows):
    return [r.rule for r in filters.apply_filter(texts(spark, *rows), name).orderBy("seq").collect()]


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 200
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_white_space_is_that_of_unicode(spark):
    odd = "a b\u0085c\u001cd　e\r\nf"
    row = texts(spark, odd).select(tx.words(F.col("text")).alias("w"), tx.collapse(F.col("text")).alias("c")).first()
    assert row.w == odd.split() and row.c == " ".join(odd.split())


def test_preprocessing_order_and_reasons(spark):
    rows = ["", "  ", "<b>Hello</b> &nbsp; world http://x.y/z end", "Hello world end", "ﬁne\x07 text", "x" * 60]
    out = normalize.preprocess(texts(spark, *rows), min_length=1).orderBy("seq").collect()
    assert [r.reason for r in out] == ["empty", "too_short", None, "duplicate", None, None]
    assert out[4].clean == "fine text"
    cut = normalize.preprocess(texts(spark, "x" * 60), max_length=10, truncate=True).first()
    assert cut.clean == "x" * 10 and cut.reason is None
    assert normalize.preprocess(texts(spark, "x" * 60), max_length=10).first().reason == "too_long"


def test_filter_boundaries(spark):
    assert rules(spark, "nsfw", "short sex", " ".join(["word"] * 97 + ["sex"] * 3), " ".join(["word"] * 96 + ["sex"] * 4)) == [None, None, "nsfw_density"]
    assert rules(spark, "gambling", "alphabet better letters and so on here") == ["gambling_density"]
    assert rules(spark, "seo_spam", "one two six ten elephant the and of is at it by", "one two six ten elephant the and of is at it by on") == ["keyword_stuffing", None]
    assert rules(spark, "html_code", "{" + "a" * 100 + "}", "A" * 80, "{a}" * 6 + " b c", "x " * 9 + "é" * 500) == ["json_blob", "base64_blob", "css_blocks", "minified"]
    assert rules(spark, "repeated_content", "a" * 5 + " bcdefgh", "a" * 6 + " bcdefgh", "go Go gO three", "go Go gO GO four", "l1\nl2\nl2\nl3") == [None, "repeated_char", None, "repeated_word", "repeated_line"]
    assert rules(spark, "document_length", "", "x" * 49, "x" * 50, None) == ["empty_document", "too_short", None, "empty_document"]
    assert rules(spark, "unicode_quality", "a\x01b", "a�b", "\U0001f600" * 10, "\U0001f600" * 11) == ["control_chars", "replacement_chars", None, "non_bmp"]
    assert rules(spark, "language", "el perro come una manzana roja en la casa grande de mi abuela hoy") == ["non_english"]
    with pytest.raises(ValueError):
        filters.apply_filter(texts(spark, "a"), "unknown")


def test_metrics_against_python(spark):
    rows = ["", "a.", "One two. Three two!\n\nTwo lines\nhere 12²", "é 😀 x" * 30]
    out = quality.metrics(texts(spark, *rows), compression=True).orderBy("seq").collect()
    import zlib

    for text, r in zip(rows, out):
        words = text.lower().split()
        freq = collections.Counter(words)
        assert r.word_entropy == pytest.approx(-sum(c / len(words) * math.log2(c / len(words)) for c in freq.values()) if words else 0)
        chars = collections.Counter(text)
        assert r.character_entropy == pytest.approx(-sum(c / len(text) * math.log2(c / len(text)) for c in chars.values()) if text else 0)
        assert r.sentence_count == len(re.split(r"[.!?]+", text.strip()))
        assert r.digit_ratio == pytest.approx(sum(c.isdigit() for c in text) / max(1, len(text)))
        assert r.compression_ratio == (1.0 if len(text) < 100 else pytest.approx(len(zlib.compress(text.encode())) / len(text.encode())))


def greedy(n, linked):
    kept = []
    for i in range(n):
        if not any(linked(k, i) for k in kept):
            kept.append(i)
    return kept


def test_greedy_rounds_equal_the_loop(spark):
    rng = random.Random(1)
    buckets = {i: {rng.randrange(25) for _ in range(2)} for i in range(60)}
    members = spark.createDataFrame([(i, b) for i, bs in buckets.items() for b in bs], "seq long, bucket long")
    assert sorted(r.seq for r in dedup.greedy_over_buckets(spark, members).collect()) == greedy(60, lambda a, b: buckets[a] & buckets[b])
    links = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08}
    rows = spark.range(40).withColumnRenamed("id", "seq")
    found = dedup.greedy_over_links(spark, rows, spark.createDataFrame(list(links), "earlier long, later long"))
    assert sorted(r.seq for r in found.collect()) == greedy(40, lambda a, b: (a, b) in links)


def test_minhash_dedup_equals_the_sequential_filter(spark, sf_dir):
    df = plans.docs(spark, sf_dir).limit(80)
    signatures = {r.seq: r.signature for r in dedup.minhash_signatures(df).collect()}
    ids = sorted(signatures)
    bands = {i: {(k, tuple(signatures[i][k * 8 : k * 8 + 8])) for k in range(16)} for i in ids}
    want = [ids[k] for k in greedy(len(ids), lambda a, b: bands[ids[a]] & bands[ids[b]])]
    assert sorted(r.seq for r in dedup.minhash_dedup(spark, df).collect() if r.kept) == want
    a, b = dedup.minhash_coefficients()
    row = dedup.minhash_signatures(texts(spark, "One  two", "")).orderBy("seq").collect()
    x = int(hashlib.md5(b"one two").hexdigest()[:8], 16)
    assert row[0].signature == [(int(p) * x + int(r)) % dedup.PRIME for p, r in zip(a, b)] and row[1].signature == [0] * 128


def test_near_dedup_and_tfidf_by_brute_force(spark, sf_dir):
    rows = [(r.seq, r.lang, r.text) for r in plans.docs(spark, sf_dir).collect()]
    pairs = {(r.earlier, r.later) for r in plans.QUERIES["jaccard_pairs"](spark, sf_dir).collect()}
    ids = sorted(i for i, *_ in rows)
    want = {ids[k] for k in greedy(len(ids), lambda a, b: (ids[a], ids[b]) in pairs)}
    assert {r.doc_id for r in plans.QUERIES["neardup_by_lang"](spark, sf_dir).collect() if r.kept} == want
    counts = {i: collections.Counter(re.findall(r"\b\w\w+\b", t.lower())) for i, _, t in rows}
    often = collections.Counter(w for c in counts.values() for w in c)
    vectors = {}
    for i, c in counts.items():
        v = {w: n * (math.log((1 + len(rows)) / (1 + often[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[i] = {w: x / size for w, x in v.items()}
    found = {(r.earlier, r.later) for r in plans.QUERIES["tfidf_pairs"](spark, sf_dir).collect()}
    assert found == {(a, b) for a in ids for b in ids if a < b and sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) >= 0.92}


def test_shuffle_shards_and_samples(spark):
    rows = spark.range(19).withColumnRenamed("id", "seq")
    placed = mixture.numbered(rows, 8, 1, "seq")
    assert sorted(r.pos for r in placed.collect()) == list(range(19))
    assert mixture.shards(placed, 19).select("shard").distinct().count() == 19
    assert sorted(r.seq for r in mixture.bottom_k(rows, 5, 1, "seq").collect()) == sorted(r.seq for r in placed.filter("pos < 5").collect())
    quota = mixture.union({"a": rows.withColumn("text", F.lit("x")), "b": rows.withColumn("text", F.lit("y"))}, {"a": 3})
    assert {r.source: r["count"] for r in quota.groupBy("source").count().collect()} == {"a": 3, "b": 19}


def test_next_fit_and_packed_arrays(spark):
    sizes = [3, 5, 2, 9, 8, 1, 1, 20]
    ids = spark.createDataFrame([(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate(sizes)], "seq long, ids array<long>")
    assigned = tokens.next_fit(ids.select("seq", F.size("ids").alias("n")), 10)
    where = {r.seq: (r.pack, r.segment) for r in assigned.collect()}
    assert where == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 0), 4: (2, 0), 5: (2, 1), 6: (3, 0)} or where == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 0), 4: (2, 0), 5: (2, 1), 6: (2, 2)}
    first = tokens.packed(ids, assigned).filter("pack = 0").first()
    assert first.ids == [0, 1, 2, 100, 101, 102, 103, 104, 200, 201]
    assert first.labels == [0, 1, 2, -100, 101, 102, 103, 104, -100, 201]
    assert first.segment_ids == [0] * 3 + [1] * 5 + [2] * 2 and first.position_ids == [0, 1, 2, 0, 1, 2, 3, 4, 0, 1]


@pytest.mark.parametrize("n", [8, 9, 16, 17])
def test_chunks(spark, n):
    ids = spark.createDataFrame([(0, list(range(3))), (1, list(range(3, n)))], "seq long, ids array<long>")
    out = tokens.chunks(ids, 8).orderBy("chunk").collect()
    assert [(r.ids, r.labels) for r in out] == [(list(range(i * 8, i * 8 + 8)), list(range(i * 8 + 1, i * 8 + 9))) for i in range((n - 1) // 8)]


def test_sample_rules(spark):
    df = spark.createDataFrame(
        [("math", "4"), ("qa", ""), ("chat", "This is a sentence that trails off and"), ("chat", "An open fence ``` stays open in this text"), ("chat", "Unbalanced { brace in a longer sentence."), ("chat", "human: leaked format in a longer sentence."), ("chat", "[1, 2, this is not quite json at all, is it]")],
        "task string, response string",
    )
    got = [r[0] for r in df.select(samples.sample_quality(F.col("response"), F.col("task"))).collect()]
    assert got == ["too_short", "too_short", "incomplete", "incomplete", "incomplete", "hallucinated_formatting", "broken_json"]
    one = spark.createDataFrame([("Sure, here you go\nassistant: hi\n\n\n\nreal text\nAs an AI I can't.\n",)], "t string")
    assert one.select(normalize.without_artifacts(F.col("t"))).first()[0] == "real text\n"
    v = spark.createDataFrame([(None,), ("no json",), ('ok {"verdict": "keep"}',), ('{"verdict": "odd"}',)], "t string").select(samples.verdict(F.col("t")).alias("v")).collect()
    assert [(r.v.verdict, r.v.reason) for r in v] == [("REVIEW", "no_verifier_response"), ("REVIEW", "unparseable_verifier"), ("KEEP", None), ("REVIEW", None)]
    n = spark.createDataFrame([("about 1,234.5 of them",), ("none",)], "t string").select(samples.extract_number(F.col("t"))).collect()
    assert [r[0] for r in n] == [1234.5, None]
    c = spark.createDataFrame([([math.log(0.5), None],), ([],)], "p array<double>").select(samples.confidence(F.col("p"))).collect()
    assert [c[0][0], c[1][0]] == [pytest.approx(0.5), None]


def test_evaluation_by_hand(spark):
    series = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 3.0, 3.5])], "series string, step long, value double")
    assert [r.bad for r in evaluation.early_stopping(series, 2).orderBy("step").collect()] == [0, 0, 1, 2, 0, 1]
    spikes = spark.createDataFrame([("a", i, 1.0 if i < 4 else 9.0) for i in range(5)], "series string, step long, value double")
    assert [r.spike for r in evaluation.loss_spikes(spikes, 4, 2.0).orderBy("step").collect()] == [False, False, False, False, True]
    board = spark.createDataFrame([("x", "1"), ("y", ""), ("z", "3")], "name string, score string")
    assert [r.name for r in evaluation.leaderboard(board, "score").orderBy("rank").collect()] == ["z", "x", "y"]
    assert {r.name: r.score for r in evaluation.upsert(board, spark.createDataFrame([("x", "7")], "name string, score string")).collect()} == {"x": "7", "y": "", "z": "3"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"text": "a", "id": 1}\n\nnot json\n{"content": "b"}\n{"id": 3}\n{"messages": [{"content": "x"}, {"content": "y"}]}\n')
    rows = readers.tolerant_jsonl(spark, str(tmp_path / "in.jsonl")).orderBy("seq").collect()
    assert [(r.text, r.reason) for r in rows] == [("a", None), (None, "json_decode_error"), ("b", None), (None, "no_text_field"), (None, "no_text_field")]
    found = readers.tolerant_jsonl(spark, str(tmp_path / "in.jsonl")).filter("doc IS NOT NULL").orderBy("seq").select(readers.detected_text(F.col("doc")).alias("t")).collect()
    assert [r.t for r in found] == ["a", "b", None, "x\ny"] or [r.t for r in found] == ["a", "b", "", "x\ny"]
    assert readers.latest_version(["CC-MAIN-2023-50", "CC-MAIN-2024-10"]) == "CC-MAIN-2024-10" and readers.latest_version(["20220301.en", "20231101.en"]) == "20231101.en"
    book = spark.createDataFrame([([[("p",), (None,)], None],)], "c array<array<struct<paragraph:string>>>").select(F.transform("c", lambda s: F.struct(s.alias("sections"))).alias("chapters"))
    assert book.select(readers.textbook_text(F.col("chapters"))).first()[0] == "p\n\n"
    df = texts(spark, " one ", "two", None)
    for fmt in writers.EXPORTERS:
        writers.export(df, fmt, str(tmp_path / fmt))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 3 and spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    writers.split_by(df, "text = 'two'", str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split/part=verified")).count() == 1
    ids = spark.createDataFrame([(0, [1, 2]), (1, [])], "seq long, ids array<long>")
    assert writers.token_stream(ids, str(tmp_path / "tokens"), 9) == {"dtype": "uint16", "total_tokens": 4, "documents": 2}
    assert b"".join(bytes(r.data) for r in spark.read.parquet(str(tmp_path / "tokens")).orderBy("seq").collect()) == b"\x01\x00\x02\x00\x09\x00\x09\x00"
    log = tmp_path / "log"
    log.write_text('{"step": 1, "loss": 2.5}\nbroken\n{"step": 2, "loss": 2.0, "lr": 0.1}\n')
    assert sorted((r.step, r.tag, r.value) for r in readers.event_series(spark, str(log)).collect()) == [(1, "loss", 2.5), (2, "loss", 2.0), (2, "lr", 0.1)]


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    plans.docs(spark, sf_dir).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    names = ["document_length", "language_quality", "language"]

    def drain(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    want = {(r.seq, r.rule) for r in clean.clean_stream(batch, names).collect()}
    assert {(r.seq, r.rule) for r in drain(clean.counters(clean.clean_stream(stream, names)), "cleaned").collect()} == want
    assert drain(clean.first_seen(stream), "seen").count() == batch.select(normalize.dedup_text(F.col("text"))).distinct().count()
    for _ in range(2):
        clean.resume_into(stream, str(tmp_path / "out"), str(tmp_path / f"again{_}"), "seq").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_generated_answers_are_right(spark):
    def gcd(a, b):
        return math.gcd(a, b)

    def fib(n):
        a, b = 0, 1
        for _ in range(n):
            a, b = b, a + b
        return a

    def collatz(n):
        k = 0
        while n > 1:
            n, k = (n // 2 if n % 2 == 0 else 3 * n + 1), k + 1
        return k

    solve = {
        "arithmetic": lambda a, b: a + b, "algebra": lambda a, b: b - a, "geometry": lambda a, b: a * b, "triangular": lambda a, b: a * (a + 1) // 2, "gcd": gcd, "fibonacci": lambda a, b: fib(a),
        "is_prime": lambda a, b: "yes" if a > 1 and all(a % d for d in range(2, a)) else "no", "sum_digits": lambda a, b: sum(map(int, f"{a}{b}")), "collatz": lambda a, b: collatz(a),
        "reverse": lambda a, b: f"{a}{b}"[::-1], "summing": lambda a, b: sum(range(3, a + 1, 3)),
    }
    rows = generate.math_samples(spark, 400, 7).collect()
    assert {r.family for r in rows} == set(solve) and all(r.response == str(solve[r.family](r.a, r.b)) for r in rows)
    assert rows == generate.math_samples(spark, 400, 7).repartition(3).orderBy("id").collect()


def test_splitting_keeps_all_sentences(spark):
    text = "\n\n".join(" ".join(f"Sentence {i}-{j} is here." for j in range(i + 1)) for i in range(12))
    parts = documents.split_documents(texts(spark, text, "short", None), 120).orderBy("seq", "part").collect()
    assert all(len(r.text) <= 120 for r in parts) and [r.text for r in parts if r.seq > 0] == ["short", ""]
    assert re.findall(r"\d+-\d+", " ".join(r.text for r in parts)) == re.findall(r"\d+-\d+", text)
