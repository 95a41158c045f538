"""Source divergence, alignment of tokenizers and uniform shards, against brute force on small tables with awkward rows."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("textloom.llm")

from test_llm import LONG, awkward, nothing  # noqa: E402

# 11

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_by_loop(rows, least_docs, k):
    from test_llm import lower

    docs = [(lower(t), lang or "", source or "") for t, lang, source in rows]
    df, n = collections.Counter(), collections.Counter()
    for text, lang, source in docs:
        found = TERM.findall(text)
        for term in found:
            n[lang, source, term] += 1
            n[lang, None, term] += 1
        for term in set(found):
            df[lang, term] += 1
    out = set()
    for lang in {d[1] for d in docs}:
        kept = sorted(t for (x, t), c in df.items() if x == lang and c >= least_docs)
        sources = sorted({d[2] for d in docs if d[1] == lang})

        total = {s: sum(n[lang, s, t] for t in kept) for s in [*sources, None]}

        def p(source, term):
            return 1 + 10**9 * (n[lang, source, term] + 2) // (total[source] + 2 * len(kept))

        table = {s: {t: p(s, t) for t in kept} for s in [*sources, None]}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(table[s][t], table[r][t]) for t in kept), r.encode(), r) for r in sources if r != s]
            terms = [(-f(table[s][t], table[None][t]), t.encode(), t) for t in kept if n[lang, s, t] and table[s][t] > table[None][t]]
            out |= {(lang, s, "pair", r, -v, i + 1) for i, (v, _, r) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:k])}
    return out


@pytest.fixture(params=["broadcast", "merge", "flushed"])
def way(request, monkeypatch):
    from textloom.llm import divergence

    if request.param == "merge":
        monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    if request.param == "flushed":
        monkeypatch.setattr(divergence, "HELD", 5)
        monkeypatch.setattr(divergence, "GROWTH", 2)


def test_divergence_is_that_of_a_loop(spark, way):
    from textloom.llm.divergence import source_divergence

    df, _ = awkward(spark)
    rng = np.random.default_rng(5)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "éüxyz"]
    many = [(100 + i, " ".join(rng.choice(words, 30, p=(w := rng.random(40) ** 4) / w.sum())).title(), "fr", f"s{i % 7}", None, None, None, None, None) for i in range(60)]
    df = df.union(spark.createDataFrame(many, df.schema))
    rows = [(r[1], r[2], r[3]) for r in df.toDF(*"abcdefghi").collect()]
    found = source_divergence(spark, df, least_docs=3, k=4).collect()
    assert len(found) == len(set(found))
    assert set(map(tuple, found)) == divergence_by_loop(rows, 3, 4)


def test_divergence_without_terms(spark):
    from textloom.llm.divergence import source_divergence

    assert source_divergence(spark, nothing(spark)).count() == 0
    df = spark.createDataFrame([(1, "one two", "en", "a"), (2, None, "en", None), (3, "123", None, "b")], "doc_id long, text string, lang string, source string")
    assert set(map(tuple, source_divergence(spark, df).collect())) == {("en", "a", "pair", "", 0, 1), ("en", "", "pair", "a", 0, 1)}


def test_probabilities_are_exact_beyond_64_bits(spark):
    from textloom.llm.divergence import smoothed

    n, total, v = 8 * 10**17, 9 * 10**17, 10**6
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(smoothed("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_the_search_leaves_out_low_buckets(spark, sf_dir):
    """Best-first waves end before all buckets are seen, with the same terms as a look at all of them."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from textloom.llm.divergence import Divergence, difference

    found = Divergence(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    seen = []
    inner = found._with_groups

    def watched(rows, groups, keys):
        out = inner(rows, groups, keys)
        if "bucket" in keys:
            seen.append(out.count())
        return out

    found._with_groups = watched
    terms = found.terms(10)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    alls = found.scored.filter("p > q").select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value")).withColumn("rank", F.row_number().over(best)).filter("rank <= 10")
    assert sorted(map(tuple, terms.select(alls.columns).collect())) == sorted(map(tuple, alls.collect()))
    assert 0 < sum(seen) < found.scored.count() / 2


# 12


def aligned_by_loop(texts):
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    a.decoder = ByteLevel()
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def ranges(ids, parts):
        out, at = [], 0
        for i, part in zip(ids, parts):
            out.append((at, at + len(part), i))
            at += len(part)
        return out

    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        parts_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids_b]
        parts_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + text).encode()
        docs.append((ranges(ids_a, parts_a), ranges(ids_b, parts_b)) if b"".join(parts_a) == whole == b"".join(parts_b) else None)
    links = []
    for doc in docs:
        found = []
        if doc:
            i = j = 0
            while i < len(doc[0]) and j < len(doc[1]):
                found.append((doc[0][i][2], doc[1][j][2]))
                end_a, end_b = doc[0][i][1], doc[1][j][1]
                i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        links.append(found)
    count = collections.Counter(x for found in links for x in found)
    top = {}
    for (_, y), c in count.items():
        top[y] = max(c, top.get(y, 0))
    out = []
    for doc, found in zip(docs, links):
        if not doc:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, e, _ in doc[0]} & {e for _, e, _ in doc[1]})
        of = [collections.defaultdict(list) for _ in doc]
        for ids, side in zip(of, doc):
            for _, end, i in side:
                ids[bisect.bisect_left(cuts, end)].append(str(i))
        groups = ["|".join(",".join(ids[g]) for ids in of) for g in range(len(cuts))]
        best = sum(count[x] == top[x[1]] for x in found)
        out.append((len(doc[0]), len(doc[1]), len(groups), len(found), best, sum(count[x] for x in found), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("unit_bytes", [8 << 20, 300])
def test_alignment_is_that_of_a_loop(spark, sf_dir, monkeypatch, unit_bytes):
    """With units of 300 bytes, counts of pairs come together from many units, and long texts are units of their own."""
    from textloom.llm import alignment

    texts = [None, "", " ", "a", "  two  spaces ", "a▁b", "<|endoftext|> and <s> and <0x41>", "\n\n\ttabs\r\n", "naïve 😀 日本語 Ⅷ", "é", "\x00", "internationalisation's", LONG[:3000], " " * 700, "x" * 500]
    few = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    texts = texts + [t[:1500] for t in few] + [few[0][:1500], "a"]
    monkeypatch.setattr(alignment, "UNIT_BYTES", unit_bytes)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in alignment.align_tokenizers(spark, df).collect()}
    wanted = aligned_by_loop(texts)
    assert wanted[3][0] == 1 and wanted[5][0] == 0 and sum(w[0] > 0 for w in wanted) > 35
    for i, w in enumerate(wanted):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, texts[i]


def test_alignment_of_awkward_rows(spark):
    from textloom.llm.alignment import align_tokenizers

    df, rows = awkward(spark)
    found = align_tokenizers(spark, df).collect()
    wanted = aligned_by_loop([t for _, t, _ in rows])
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found) == sorted((str(i), *w) for (i, _, _), w in zip(rows, wanted))
    assert align_tokenizers(spark, nothing(spark)).count() == 0


# 13


def test_hypergeometric_has_its_law():
    from textloom.llm.sharding import hypergeometric

    rng = np.random.default_rng(0)
    for good, bad, draws in ((7, 5, 6), (40, 3, 20), (3, 200, 50), (1000, 1500, 800)):
        low, high = max(0, draws - bad), min(draws, good)
        p = np.array([math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(low, high + 1)])
        seen = np.bincount([hypergeometric(rng, good, bad, draws) - low for _ in range(4000)], minlength=len(p))
        many = p * 4000 >= 5
        chi = ((seen - 4000 * p)[many] ** 2 / (4000 * p[many])).sum()
        assert len(seen) == len(p) and chi < many.sum() + 5 * math.sqrt(2 * many.sum())
    assert hypergeometric(rng, 0, 9, 4) == 0 and hypergeometric(rng, 9, 0, 4) == 4 and hypergeometric(rng, 5, 5, 10) == 5
    large = [hypergeometric(rng, 4 * 10**11, 6 * 10**11, 10**10) for _ in range(300)]
    sd = math.sqrt(10**10 * 0.24 * 0.99)
    assert abs(np.mean(large) - 4 * 10**9) < 5 * sd / math.sqrt(300) and 0.8 < np.std(large) / sd < 1.2


def test_shards_are_exact_and_whole(spark):
    from textloom.llm.sharding import shard_rows

    df, rows = awkward(spark)
    for parts, shards in ((1, 24), (5, 3), (70, 4)):
        found = shard_rows(spark, df.repartition(parts), shards).collect()
        wanted = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == wanted
        slots = collections.defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_rows(spark, nothing(spark)).count() == 0


def test_the_matrix_adds_up(spark, monkeypatch):
    """With two children to a node, the tree has seven levels."""
    from textloom.llm import sharding

    monkeypatch.setattr(sharding, "FAN_OUT_BITS", 1)
    s = sharding.Sharding(spark, spark.range(5000).selectExpr("id AS doc_id", "'x' AS text").repartition(100), 7)
    matrix = {r.part: r.counts for r in s.matrix().collect()}
    assert {r.part: r["count"] for r in s.rows.groupBy("part").count().collect()} == {p: sum(c) for p, c in matrix.items()}
    assert [sum(c[k] for c in matrix.values()) for k in range(7)] == s.sizes()


def test_the_shuffle_is_uniform(spark):
    """Tenths of the input and tenths of a shard meet as often as chance has it, and neighbours part."""
    from textloom.llm.sharding import shard_rows

    n, shards = 20_000, 4
    found = shard_rows(spark, spark.range(n, numPartitions=7).selectExpr("id AS doc_id", "'x' AS text"), shards).collect()
    at = {r.doc_id: (r.shard, r.slot) for r in found}
    seen = collections.Counter((d * 10 // n, s, k * 10 * shards // n) for d, (s, k) in at.items())
    chi = sum((seen[d, s, k] - n / 400) ** 2 / (n / 400) for d in range(10) for s in range(shards) for k in range(10))
    assert abs(chi - 390) < 5 * math.sqrt(2 * 390)
    assert abs(sum(at[d][0] == at[d + 1][0] for d in range(n - 1)) / n - 1 / shards) < 0.02
    assert abs(np.corrcoef(range(n), [at[d][1] for d in range(n)])[0, 1]) < 0.04


def test_shards_on_disk_are_whole_rows_in_order(spark, tmp_path):
    from textloom.llm.sharding import write_shards

    df, rows = awkward(spark)
    write_shards(spark, df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    assert back.columns == [*df.columns[:5], "Text_5", *df.columns[6:], "slot", "shard"]
    for s in range(3):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / f"shard={s}")).coalesce(1).collect()]
        assert slots == list(range(len(slots)))


# 1 and 6, mended


def test_the_index_lies_in_the_shared_folder(spark):
    """And its files go with it, also those that a compaction replaces."""
    import os

    from textloom.llm.common import shared_dir
    from textloom.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, "textloom_test_place", buckets=2)
    folder = f"{shared_dir(spark)}/textloom-index".removeprefix("file://")
    mine = lambda: [x for x in os.listdir(folder) if x.startswith("textloom_test_place")]
    try:
        index.append(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
        index.append(spark.createDataFrame([(3, "c")], "doc_id long, text string"))
        assert len(mine()) == 1
        index.compact()
        assert len(mine()) == 1 and index.read().count() == 3
        assert DigestIndex(spark, "textloom_test_place").read().count() == 3
    finally:
        index.drop()
    assert mine() == []


def test_lines_each():
    from textloom.llm.line_quality import lines_each

    for lengths, most in (([5, 1, 9], 100), ([200_001, 3, 4, 5], 1000), ([7] * 50, 100), ([0, 0], 10), ([], 10), ([10**6] * 30, 10)):
        n = lines_each(lengths, most)
        assert n >= 1 and (n == 1 or sum(min(x, n) for x in lengths) <= max(most, 1))
        assert n >= max(1, *lengths, 1) or sum(min(x, n + 1) for x in lengths) > most


def test_a_long_labelled_document_shuts_out_no_other(spark):
    """One document of 200,001 lines, whose id comes first in the order of the sample, leaves the others' labels their say."""
    from textloom.llm.line_quality import held_out, line_quality
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = spark.range(10**6, 10**6 + 2000).select(F.col("id").alias("doc_id")).filter(~held_out(F.col("doc_id")))
    first = ids.orderBy(F.crc32(F.col("doc_id").cast("string"))).first().doc_id
    long = spark.createDataFrame([(first, "\n".join(f"line {i % 7} of a text" for i in range(200_001)))], "doc_id long, text string")
    more = spark.createDataFrame([(first, 1, 0)], "doc_id long, quality int, toxic int")
    found = line_quality(spark, docs.unionByName(long), labels.select("doc_id", "quality", "toxic").unionByName(more.select("doc_id", F.col("quality").cast(labels.schema["quality"].dataType), F.col("toxic").cast(labels.schema["toxic"].dataType))))
    scored = found.join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len({r.score for r in scored}) > 50
    assert sum(r.predicted == r.quality for r in scored) >= 0.99 * len(scored)
