"""Token streams, merges, windows of near-duplicates and distilled records."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpora, dedup, distill, evaluation, token_stream
from textloom.plans import queries as plans


def test_stream_round_trip(spark, tmp_path):
    """Over several files, with blocks across them; other element types; refused ids."""
    rows = [(i, list(range(i % 7))) for i in range(50)] + [(50, None)]
    df = spark.createDataFrame(rows, "seq long, ids array<int>").repartition(5)
    flat = [x for _, ids in rows for x in [*(ids or []), 9]]
    for vocabulary, kind in ((10, "<u2"), (70_000, "<u4")):
        path = f"file://{tmp_path}/{vocabulary}"
        made = token_stream.write_stream(df, path, vocabulary, 9)
        assert made["dtype"] == kind and made["docs"] == 51 and made["tokens"] == len(flat)
        for block in (8, 1000):
            found = sorted((r.start, r.ids) for r in token_stream.read_stream(spark, path, block).collect())
            assert [s for s, _ in found] == list(range(0, len(flat), block)) and [x for _, ids in found for x in ids] == flat
    with pytest.raises(Exception, match="outside the vocabulary"):
        token_stream.write_stream(df, f"file://{tmp_path}/low", 5, 4)
    assert token_stream.read_stream(spark, f"file://{tmp_path}/10").count() == 1
    nothing = token_stream.write_stream(df.limit(0), f"file://{tmp_path}/none", 10, 9)
    assert nothing["tokens"] == 0 and token_stream.read_stream(spark, f"file://{tmp_path}/none").count() == 0


def test_encode_and_decode(spark):
    public = pytest.importorskip("public_tokenizers")
    texts = {1: "Some words, ß and 😀.", 2: "", 3: None}
    df = spark.createDataFrame(list(texts.items()), "seq long, text string")
    ids = token_stream.encode(df, public.path("byte_bpe_50k.json"), 50256, 50256)
    assert all(r.ids[0] == r.ids[-1] == 50256 for r in ids.collect())
    back = {r.seq: r.text for r in token_stream.decode(ids, public.path("byte_bpe_50k.json"), (50256,)).collect()}
    assert back == {1: texts[1], 2: "", 3: ""}


def test_full_packs(spark):
    rows = [(0, 0, [1] * 10, [0] * 10, list(range(10))), (0, 1, [2] * 3, [0] * 3, [0, 1, 2])]
    packs = spark.createDataFrame(rows, "scope int, pack int, ids array<int>, segment_ids array<int>, position_ids array<int>")
    kept = token_stream.full_packs(packs, 12, 2).orderBy("pack").collect()
    assert kept[0].ids == kept[0].labels == [1] * 10 + [0, 0] and kept[0].segment_ids[-2:] == [-1, -1] and len(kept) == 2
    assert token_stream.full_packs(packs, 12, 3).count() == 1


def shingles(text, k):
    words = "".join(c if c.isascii() and c.isalnum() or c.isspace() else " " for c in text.lower()).split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else set(words)


def jaccard(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)


def windowed(texts, window, k=3, least=0.8):
    kept = []
    for i in sorted(texts):
        s = shingles(texts[i], k)
        if not any(jaccard(s, t) >= least for _, t in kept[-window:]):
            kept.append((i, s))
    return {i for i, _ in kept}


@pytest.mark.parametrize("window", [2, 5, 1000])
def test_near_duplicates_of_the_last_kept(spark, window):
    import random

    draw = random.Random(4)
    base = [[f"w{draw.randrange(500)}" for _ in range(30)] for _ in range(6)]
    texts = {}
    for i in range(70):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            words[draw.randrange(30)] = "other"
        texts[i * 3] = " ".join(words) if i % 9 else draw.choice(["", "  ", "two words"])
    df = spark.createDataFrame(list(texts.items()), "seq long, text string")
    found = {r.seq for r in dedup.sliding_near_dedup(spark, df, window=window).collect() if r.kept}
    assert found == windowed(texts, window)


def test_half_of_all_rows_are_one_text(spark):
    """One key for 20,000 rows, whatever the tier; null texts too."""
    df = spark.range(40_000).selectExpr("id seq", "CASE WHEN id % 2 = 0 THEN 'the one text that all know' WHEN id = 1 THEN NULL ELSE concat('text ', id, ' other') END text")
    found = dedup.first_by_key(df, F.sha2("text", 256))
    assert found.filter("duplicate").count() == 19_999 and found.columns == ["seq", "text", "duplicate"]
    reasons = {r.reason: r["count"] for r in dedup.two_tier(df).groupBy("reason").count().collect()}
    assert reasons == {"exact": 19_999, None: 20_001}
    near = dedup.near_dedup(spark, df.filter("seq < 4000"))
    assert near.filter("not kept").count() == 1999


def test_sample_near_duplicates(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "J i h g f e d c b a!"), (3, "a b c d e f g h i j k"), (4, "a b c"), (5, "..."), (6, "..."), (7, None)]
    df = spark.createDataFrame(rows, "seq long, text string")
    assert {r.seq for r in dedup.sample_near_dedup(spark, df).collect() if not r.kept} == {2, 3}


def test_configuration(spark, tmp_path):
    @dataclasses.dataclass
    class Inner:
        depth: int = 1

    @dataclasses.dataclass
    class Outer:
        name: str = "x"
        inner: Inner = dataclasses.field(default_factory=Inner)

    assert corpora.configured(Outer, {"name": "y", "inner": {"depth": 3, "odd": 1}, "more": 2}) == Outer("y", Inner(3))
    assert len(corpora.config_hash("a", 1)) == 12 and corpora.config_hash("a", 1) != corpora.config_hash("a", 2)
    with pytest.raises(ValueError, match="nowhere"):
        corpora.resolved(spark.createDataFrame([("a", 1)], "name string, n int"), spark.createDataFrame([], "name string, n int"), ["a", "nowhere"])


def test_caches_and_rewrites(spark, tmp_path):
    rows = spark.range(5)
    asked = []

    def fails():
        asked.append(1)
        raise OSError("no network")

    path = f"file://{tmp_path}/c"
    assert corpora.cached(spark, path, fails, lambda: rows).count() == 5
    assert corpora.cached(spark, path, fails).count() == 5 and len(asked) == 1
    assert corpora.rewritten(spark, path, lambda df: df.unionByName(spark.range(5, 8))).count() == 8
    (tmp_path / "c").rename(tmp_path / "c.old")  # cut short between the renames
    assert corpora.rewritten(spark, path, lambda df: df).count() == 8
    assert corpora.folder_size(spark, path) > 0 and corpora.humanized(3 << 20) == "3.0 MB"


def test_reports_for_people(spark):
    reports = spark.createDataFrame([(10, 7, {"a": 1, "b": 2}), (5, 4, {"b": 1}), (0, 0, {})], "total long, kept long, reasons map<string,long>")
    merged = corpora.merged_reports(reports)
    r = merged.first()
    assert (r.total, r.kept, r.removed, r.removed_pct) == (15, 11, 4, 26.67) and [(x.reason, x.n) for x in r.reasons] == [("b", 3), ("a", 1)]
    assert "26.67 %" in corpora.report_text(merged)
    assert corpora.markdown(spark.createDataFrame([("x|y", 0.5)], "name string, v double")) == "| name | v |\n| - | - |\n| x\\|y | 0.5000 |"


def test_early_stopping_with_a_delta(spark):
    values = [5.0, 4.8, 4.2, 4.1, 4.15, 3.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series string, step long, value double")
    found = [(r.bad, r.stop) for r in evaluation.early_stopping(df, 2, 0.5).orderBy("step").collect()]
    assert found == [(0, False), (1, False), (0, False), (1, False), (2, True), (0, False)]


def test_evaluation_items_are_marked(spark):
    rows = distill.evaluation_items(spark, [{"category": "math", "prompt": "1+1", "kind": "num", "gold": ["2"]}]).collect()
    assert rows[0].eval_only and not rows[0].train and rows[0].gold == ["2"]


def test_semantic_duplicates_by_quality(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta"
    texts = [(1, base, 0.5), (2, base, 0.5), (3, base, 0.9), (4, base, 0.7), (5, "other words that nobody else has", 0.1), (6, base, None), (7, "other words that nobody else has", None)]
    df = spark.createDataFrame(texts, "seq long, text string, quality double")
    assert {r.seq for r in dedup.semantic_dedup(spark, df).collect() if r.kept} == {1, 3, 5}


def test_the_sample_chain_is_its_sql_on_odd_rows(spark, same_rows, tmp_path):
    """Dangling ends, brackets, no language, letters before a harmful word: rules of the whole chain that SQL doesn't have."""
    import duckdb

    long = "a b c d " * 40
    texts = [("This short sentence of a text ends in and", "en"), ("[a short text that begins with a bracket", "en"), ("A text in no language that is known to us", None), ("A text in a language that is left out here", "fr")]
    texts += [("La voiture d\u00e9rape, d\u00e9rape, d\u00e9rape et encore.", "en"), ("We hate, kill and bomb in this one sentence.", "de"), (None, "en"), ("short", "en"), (long, "en"), (long[:110], "en"), (long[:110].replace(" ", "  "), "en")]
    rows = [(i, text, lang, "src1", len(text or "")) for i, (text, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(plans.QUERIES["sample_chain"](spark, str(tmp_path)), con, plans.ORACLE["sample_chain"])


def test_batches_of_many_rows_are_taken_a_few_at_a_time():
    import pyarrow as pa

    from textloom.functions import counting

    batch = pa.record_batch([pa.array(range(1000)), pa.array([[i] for i in range(1000)])], names=["seq", "ids"])
    parts = list(counting.few_batches([batch]))
    assert max(p.num_rows for p in parts) == counting.ROWS and [i for p in parts for i in p.column(0).to_pylist()] == list(range(1000))
    assert [x for a, b in counting.few(batch.column(0), batch.column(1)) for x in zip(a, b)] == [(i, [i]) for i in range(1000)]


def test_long_batches_are_encoded_split_and_signed_a_few_rows_at_a_time(spark):
    import pyarrow as pa
    import public_tokenizers

    from textloom.functions import counting
    from textloom.operators import documents

    class Spy:
        """Gives the function that Spark would run."""

        def select(self, *_):
            return self

        def filter(self, *_):
            return self

        def unionByName(self, other):
            return other

        def mapInArrow(self, run, _):
            self.run = run
            return self

    file = public_tokenizers.path("byte_bpe_50k.json")
    for made, name, values in (
        (token_stream.encode(Spy(), file), "text", ["a b c"] * 1000),
        (token_stream.decode(Spy(), file), "ids", [[1, 2]] * 1000),
        (documents.split_documents(Spy(), 5), "text", ["a b c"] * 1000),
        (dedup.minhash_signatures(Spy(), 4), "norm", ["a b c"] * 1000),
    ):
        out = list(made.run(iter([pa.record_batch([pa.array(range(1000)), pa.array(values)], names=["seq", name])])))
        assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= counting.ROWS


def test_statistics_order_ids_of_rows_only(spark):
    rows = [(i, "ab " * i, list(range(i))) for i in range(40)]
    found = token_stream.tokenizer_statistics(spark.createDataFrame(rows, "seq long, text string, ids array<long>"), 3, 100, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    ordered = [x for x in plan.split("\n") if "TakeOrdered" in x]
    assert ordered and not [x for x in ordered if "ids" in x or "text" in x] and found.first().avg_tokens == 4.5
