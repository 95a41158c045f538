"""The training-data operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("textloom.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from textloom.llm import common, packing, queries  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, kept string, digest int, key int"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, other columns with clashing names."""
    base = " ".join(f"tok{i}" for i in range(60))
    texts = {
        1: "Hello World again and again",
        2: "hello world AGAIN and again",
        3: None,
        4: "",
        5: "  \n\t ",
        6: LONG,
        7: LONG + " tail",
        8: base,
        9: base.replace("tok30", "other"),
        10: base.replace("tok50", "other"),
        11: f"start one {PASSAGE} end one",
        12: f"begin two {PASSAGE} finish two",
        13: "same line here\nsame line here\nSame line here\nunique\n\n same line her ",
        14: "É upper É stays É",
        15: "é upper é stays é",
        16: "naïve 😀 text with <|endoftext|> inside and\x85odd breaks",
    }
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, "x", None, 1, None) for i, t in texts.items()]
    rows += [rows[7], (None, base, "en", "s1", 3, None, "k", None, 2), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1], r[3]) for r in rows]


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().translate(common.ASCII_LOWER).decode()


def test_sql_of_the_queries(spark, sf_dir, duck, same_rows):
    for name, sql in queries.ORACLE.items():
        same_rows(queries.QUERIES[name](spark, sf_dir), duck, sql)


def test_pick_prefers_the_exact_name(spark):
    df, _ = awkward(spark)
    assert common.pick(df, text="string").filter("text = 'x'").isEmpty()
    with pytest.raises(common.ColumnMissing):
        common.pick(df, nowhere="long")


# 1


def test_exact_dedup_rows(spark):
    from textloom.llm.exact_dedup import exact_dedup, keep_one_of_each_text

    df, rows = awkward(spark)
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(-1 if i is None else i)
    found = exact_dedup(spark, df).collect()
    assert len(found) == len(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids) and (r.keep_id if r.keep_id is not None else -1) == max(ids)
    assert {bytes(r.digest) for r in kept} == set(by_digest)
    stay = keep_one_of_each_text(spark, df)
    assert stay.columns == df.columns and stay.count() == len(groups)
    assert exact_dedup(spark, nothing(spark)).count() == 0


TWO = "doc_id long, text string"


@pytest.fixture
def index(spark):
    from textloom.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, "textloom_test_digests", buckets=5)
    yield index
    index.drop()


def decisions(found):
    return {r.doc_id: (r.keep_id, r.kept) for r in found.collect()}


def test_digest_index_remembers(spark, index):
    def batch(*rows):
        return decisions(index.append(spark.createDataFrame(rows, TWO)))

    assert batch((1, "a"), (2, "A"), (3, "b")) == {1: (2, False), 2: (2, True), 3: (3, True)}
    assert batch((9, "a"), (8, "c"), (7, "c")) == {9: (2, False), 8: (8, True), 7: (8, False)}
    assert index.append(spark.createDataFrame([], TWO)).count() == 0
    assert index.read().count() == 3


def test_digest_index_isnt_shuffled(spark, index):
    """The anti-join is a sort-merge join; only the new digests are exchanged."""
    index.append(spark.createDataFrame([(1, "a")], TWO))
    groups = spark.range(9).selectExpr("unhex(sha2(string(id), 256)) digest", "id keep_id")
    plan = index.unseen(groups)._jdf.queryExecution().sparkPlan().toString() + index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [digest" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning(digest") == 1


def test_a_batch_may_be_repeated(spark, index):
    """Appended again after a failure between the write and the result, or halfway through the write, it loses nothing."""
    from textloom.llm.exact_dedup import digests

    first, second = spark.createDataFrame([(1, "a"), (2, "b")], TWO), spark.createDataFrame([(3, "b"), (4, "c"), (5, "C"), (6, "d"), (None, "e")], TWO)
    index.append(first, "one")
    index.add(digests(second.filter("doc_id < 6")), "two")  # some of it was written before all was lost
    wanted = {3: (2, False), 4: (5, False), 5: (5, True), 6: (6, True), None: (None, True)}
    assert decisions(index.append(second, "two")) == wanted
    assert decisions(index.append(second, "two")) == wanted  # written, but the result was lost
    assert index.read().count() == index.read().select("digest").distinct().count() == 5
    assert decisions(index.append(first, "one")) == {1: (1, True), 2: (2, True)}
    assert not any(kept for _, kept in decisions(index.append(second, "three")).values())


def test_compaction(spark, index):
    from textloom.llm.exact_dedup import DigestIndex

    for k in range(3):
        index.append(spark.range(20).selectExpr("id doc_id", f"concat('{k}', id) text"), str(k))
    before = sorted(index.read().collect())
    files = len(index.read().inputFiles())
    index.compact()
    assert sorted(index.read().collect()) == before and len(index.read().inputFiles()) == 5 < files
    # Cut short before the old table goes, and after.
    index._create(index.fresh)
    again = DigestIndex(spark, index.table)
    assert sorted(again.read().collect()) == before and again.buckets == 5
    spark.sql(f"ALTER TABLE {index.table} RENAME TO {index.fresh}")
    assert sorted(DigestIndex(spark, index.table).read().collect()) == before


def test_dropped_ids_by_shuffle(spark, monkeypatch):
    from textloom.llm import exact_dedup

    df, rows = awkward(spark)
    wanted = sorted(map(repr, exact_dedup.keep_one_of_each_text(spark, df).collect()))
    monkeypatch.setattr(exact_dedup, "DROP_BY_BROADCAST", 0)
    assert sorted(map(repr, exact_dedup.keep_one_of_each_text(spark, df).collect())) == wanted


def test_a_group_of_a_third_of_all_rows(spark):
    from textloom.llm.exact_dedup import exact_dedup

    df = spark.range(6000).selectExpr("id doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END text")
    found = exact_dedup(spark, df)
    assert found.filter("kept").count() == 4001
    assert found.filter("group_size = 2000 AND keep_id = 5997").count() == 2000


# 2


def shingles(text):
    words = WORDS.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows(spark, df):
    from textloom.llm.near_dedup import near_duplicates

    return near_duplicates(spark, df).collect()


def test_near_duplicates_of_awkward_rows(spark):
    df, rows = awkward(spark)
    found = near_rows(spark, df)
    assert len(found) == len(rows)
    want = brute_components({i: t for i, t, _ in rows if i is not None}.items())
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
        else:
            assert r.kept
    assert near_rows(spark, nothing(spark)) == []


def test_large_nodes_lose_no_link(spark, monkeypatch):
    """Chains of copies and many documents around one passage, with nodes so small that all paths are taken."""
    from textloom.llm import near_dedup

    rng = np.random.default_rng(5)
    rows, words = [], [f"v{i}" for i in range(80)]
    for i in range(160):
        if i % 4 == 0:
            at = int(rng.integers(80))
            words = [*words[:at], f"n{i}", *words[at + 1 :]]
        text = " ".join(words) if i % 2 else " ".join([*words[:45], *(f"r{int(x)}" for x in rng.integers(10_000, size=30))])
        rows.append((i, text))
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 10)
    monkeypatch.setattr(near_dedup, "FETCH_BY_BROADCAST", 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_rows(spark, df)} == want


def test_components(spark):
    from textloom.llm.components import connected_components

    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 101), (7, 7), (5, 4)]
    found = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 100}
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


# 3


def brute_stats(text):
    words = WORDS.findall(text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    from textloom.llm.quality_rules import quality_rules

    rng = np.random.default_rng(2)
    df, rows = awkward(spark)
    names = [f"word{i}" for i in range(3000)]
    plain = [(1000 + i, " ".join(rng.choice(names, int(rng.integers(80, 300)))), "en", f"s{i % 2}") for i in range(400)]
    junk = [(3000, " ".join(f"{w}***&&&" for w in names[:200]), "en", "s0"), (3001, "a b c d e " * 30, "en", "s0")]
    both = common.pick(df, doc_id="long", text="string", lang="string", source="string").unionByName(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string"))
    found = quality_rules(spark, both).collect()
    assert len(found) == len(rows) + len(plain) + len(junk)
    texts = {i: t for i, t, _ in rows} | {p[0]: p[1] for p in plain + junk}
    for r in found:
        if r.doc_id is not None:
            n, *rest = brute_stats(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
            assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
            assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in found}
    assert not by_id[3000].kept and not by_id[3000].base_failed and by_id[3001].base_failed
    assert sum(by_id[p[0]].kept for p in plain) >= 0.99 * len(plain)
    assert quality_rules(spark, nothing(spark)).count() == 0


def test_chi2():
    from textloom.llm.quality_rules import chi2_cdf, chi2_quantile

    assert chi2_cdf(chi2_quantile(0.95, 5), 5) == pytest.approx(0.95)
    assert chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_outliers_by_group_resist_contamination(spark):
    """A fifth of one source's rows lies far off; the estimate of the others is not pulled there."""
    from textloom.llm.quality_rules import robust_outliers

    rng = np.random.default_rng(3)
    rows = [(i, "en", "a", int(n), int(5 * n), int(n) if i % 5 == 0 else 0, 10, 0, 0) for i, n in enumerate(rng.integers(100, 400, 500))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    found = {r.doc_id: r.outlier for r in robust_outliers(spark, df).collect()}
    assert all(found[i] == (i % 5 == 0) for i in found)


# 4

MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nAnd a second paragraph."),
    (1, 1, "assistant", "> how do I   SORT a list?\nUse sorted()."),
    (1, 2, "user", ">> How do I sort a list?\n> Use sorted().\nThanks!"),
    (1, 4, "user", "> And a second paragraph.\nNobody answered this."),
    (2, 0, "user", "> Thanks!\nFrom another thread."),
    (2, 1, "assistant", "> never said anywhere\nHm."),
    (2, 2, "user", None),
    (3, 0, "user", ""),
    (3, 1, None, "  > indented quote\n\n>"),
    (4, 7, "user", "> Later self\nLater self"),
]


def test_quotations_against_sql_and_by_hand(spark, same_rows):
    import duckdb

    from textloom.llm.quotations import link_quotations, reply_ordered

    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    linked = link_quotations(spark, df)
    sql = queries.ORACLE["op4_quotations"].replace("coalesce(parent_conv_id, conv_id) AS parent_conv_id, coalesce(parent_turn, turn) AS parent_turn", "parent_conv_id, parent_turn")
    same_rows(linked, con, sql)
    by = {(r.conv_id, r.turn): r for r in linked.collect()}
    assert by[1, 1].own_text == "Use sorted()." and (by[1, 1].parent_conv_id, by[1, 1].parent_turn) == (1, 0)
    assert (by[1, 2].parent_turn, by[1, 2].n_linked, by[1, 2].quote_depth) == (1, 2, 2)
    assert by[1, 4].parent_turn == 0 and by[1, 4].depth == 1
    assert (by[2, 0].thread_conv_id, by[2, 0].thread_turn, by[2, 0].depth) == (1, 0, 3)
    assert by[2, 1].n_linked == 0 and by[2, 1].parent_turn == 0 and by[2, 1].depth == 4
    assert by[4, 7].n_linked == 0
    place = {(r.conv_id, r.turn): i for i, r in enumerate(reply_ordered(linked).collect())}
    assert all(place[r.parent_conv_id, r.parent_turn] < place[k] for k, r in by.items() if r.parent_conv_id is not None)


def test_quotations_of_awkward_tables(spark):
    from textloom.llm.quotations import link_quotations

    rows = [(None, 0, "u", "a"), (1, None, "u", "> a\nb"), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 1, "u", "> a"), (None, None, None, None), (5, 0, "u", "\n".join(f"> q{i}" for i in range(20_000)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, row int, Turn string")
    found = link_quotations(spark, df).collect()
    assert len(found) == len(rows)
    assert [r.parent_turn for r in found if r.conv_id == 1 and r.turn == 1] == [0]
    assert link_quotations(spark, df.limit(0)).count() == 0


def test_a_long_chain_of_replies(spark):
    from textloom.llm.quotations import link_quotations

    df = spark.range(300).selectExpr("9L conv_id", "id turn", "'user' role", "concat('> m', id - 1, char(10), 'm', id) text")
    found = {r.turn: r.depth for r in link_quotations(spark, df).collect()}
    assert found == {i: i for i in range(300)}


def test_native_plans(spark, sf_dir):
    for name in ("op4_quotations", "op5_mixing"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# 5


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: capped[s] if s in capped else rest * weight[s] / free for s in names}
        over = [s for s in names if s not in capped and target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    from textloom.llm.mixing import Mixture

    df, rows = awkward(spark)
    more = [(100 + i, " ".join(["w"] * (50 + i)), "en", ["tiny", "Z", "é", "big"][min(i, 3)]) for i in range(60)]
    both = common.pick(df, doc_id="long", text="string", lang="string", source="string").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    every = [(i, t, s) for i, t, s in rows] + [(i, t, s) for i, t, _, s in more]
    sizes = collections.Counter()
    for _, t, s in every:
        sizes[s] += len(WORDS.findall(t or ""))
    targets = brute_targets(sizes)
    mix = Mixture(spark, both, block_words=8)
    found = mix.taken().collect()
    assert len(found) == len(every)
    assert sorted(r.size for r in found) == sorted(len(WORDS.findall(t or "")) for _, t, _ in every)
    assert sorted({round(r.target, 6) for r in found}) == sorted({round(t, 6) for t in targets.values()})
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    by_target = collections.Counter()
    for r in found:
        by_target[round(r.target, 6)] += r.taken
    for t, taken in by_target.items():
        assert abs(taken - t) <= max(40, 0.03 * t)
    again = Mixture(spark, both.repartition(7), block_words=8).taken()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, found), key=repr) == sorted(map(key, again.collect()), key=repr)
    assert Mixture(spark, nothing(spark)).taken().count() == 0


def test_permutation_and_mixed_documents(spark):
    from textloom.llm.mixing import Mixture

    rows = [(i, "\n".join(f"d{i}w{k} " for k in range(5 + i % 9)), "en", f"s{i % 4}", 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = Mixture(spark, df, block_words=4, shard_slots=16)
    used = collections.defaultdict(list)
    sizes = {r.sid: r.n_blocks for r in mix.sources.collect()}
    for r in mix.slots().collect():
        used[r.sid, r.slot // sizes[r.sid]].append(r.block)
    for (sid, turn), blocks in used.items():
        assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(sizes[sid]))
        if (sid, turn + 1) in used:
            assert len(blocks) == sizes[sid]
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    words = collections.Counter()
    original = {i: WORDS.findall(t) for i, t, *_ in rows}
    out = mix.documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        found = WORDS.findall(r.text)
        assert r.n_chars == len(r.text) and [w for w in original[r.doc_id] if w in set(found)] == found
        words[r.doc_id] += len(found)
    assert {i: n for i, n in taken.items() if n} == dict(words)


# 6


def test_forward_backward_against_enumeration():
    import itertools

    from textloom.llm.line_quality import Chain

    rng = np.random.default_rng(0)
    chain = Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    counts = np.array([3, 1, 5, 2])
    x = rng.normal(size=(counts.sum(), 3))
    good, pairs = chain.marginals(x, counts, pairs=True)
    at, total = 0, np.zeros((2, 2))
    for n in counts:
        z, p, q = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            s = sum(x[at + t] @ chain.emit for t in range(n) if path[t]) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))
            z += np.exp(s)
            p += np.exp(s) * np.array(path)
            for a, b in zip(path, path[1:]):
                q[a, b] += np.exp(s)
        assert np.allclose(good[at : at + n], p / z)
        total += q / z
        at += n
    assert np.allclose(pairs, total)


def test_gradient_against_enumeration():
    """The loss by all paths of all lines, its derivatives by differences."""
    import itertools

    from textloom.llm.line_quality import PICKS, Chain

    rng = np.random.default_rng(1)
    counts, y = np.array([3, 1, 4, 2]), np.array([1, 0, 0, 1])
    x, lengths, w = rng.normal(size=(counts.sum(), 3)), rng.uniform(1, 5, size=counts.sum()), rng.normal(size=7)

    def loss(w):
        total, at = 0.0, 0
        for n, label in zip(counts, y):
            z = mean = 0.0
            for path in itertools.product((0, 1), repeat=int(n)):
                p = np.exp(sum(x[at + t] @ w[:3] for t in range(n) if path[t]) + sum(w[3 + 2 * a + b] for a, b in zip(path, path[1:])))
                z += p
                mean += p * (lengths[at : at + n] @ np.array(path)) / lengths[at : at + n].sum()
            good = (mean / z) ** PICKS
            total -= np.log(good if label else 1 - good)
            at += n
        return total / len(y)

    step = 1e-6 * np.eye(7)
    wanted = [(loss(w + s) - loss(w - s)) / 2e-6 for s in step]
    assert np.allclose(Chain.gradient(w, x, lengths, counts, y), wanted, atol=1e-5)


def test_bad_lines_within_good_documents(spark):
    """Lines of one document bear different labels: junk put into good documents is found, the lines around it stay good."""
    from textloom.llm.line_quality import fit_quality

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = fit_quality(spark, docs, labels)
    good = [r.text for r in docs.join(labels.filter("quality = 1"), "doc_id").select("text").collect() if r.text and r.text.count("\n") > 5]
    assert len(good) > 50
    junk = "Thnd*** iner*** ther*** ththsh$$$ ountin$$$ ntnd*** that*** a,%%% erat$$$ ddff*** one### two%%%"
    found = n = 0
    for text in good:
        lines = [x for x in text.split("\n") if x.split()]
        p, _ = model.lines(["\n".join([*lines[:3], junk, *lines[3:]]).encode()])
        assert p[3] < 0.5
        found, n = found + (np.delete(p, 3) >= 0.5).sum(), n + len(lines)
    assert found >= 0.95 * n


def test_line_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.op6_line_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in held) >= 0.98 * len(held)


def test_line_quality_of_awkward_rows(spark):
    from textloom.llm.line_quality import line_quality

    df, rows = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 17)] + [(1, 0, 0, "x"), (None, 1, 0, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    found = line_quality(spark, df, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    empty = {r.score for r in found if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1
    assert {r.score for r in line_quality(spark, df, labels.limit(0)).collect()} == {0.5}
    assert line_quality(spark, nothing(spark), labels).count() == 0


# 7


ENCODER = []


def public_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not PUBLIC:
        PUBLIC.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return PUBLIC[0].encode(text, add_special_tokens=False).ids


PUBLIC = []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t\r'sStTabéß1²$.\x85\xa0 😀", max_size=40))
def test_ids_are_those_of_the_tokenizer(text):
    if not ENCODER:
        ENCODER.append(packing.Encoder())
    assert ENCODER[0](text).tolist() == [*ENCODER[0].full.encode(text, add_special_tokens=False).ids, 0]


def check_packed(found, texts, length):
    pieces = collections.defaultdict(list)
    for r in found:
        pieces[r.sequence_id].append(r)
    for rows in pieces.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    if texts:
        for i, text in texts.items():
            ids = np.array([*public_ids(text or ""), 0], dtype="<u4")
            at = 0
            for r in sorted((r for r in found if r.doc_id == i), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                part = ids[at : at + r.length].tobytes()
                assert r.ids_crc32 == zlib.crc32(part) and (r.ids is None or bytes(r.ids) == part)
                at += r.length
            assert at == len(ids)
    return sum(r.length for r in found), len(pieces)


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = packing.pack_documents(spark, docs.repartition(5)).collect()
    tokens, sequences = check_packed(found, texts, 1024)
    assert tokens >= 0.97 * 1024 * sequences
    assert check_packed(packing.pack_documents(spark, docs, length=64, most_open=3, with_ids=False).collect(), texts, 64)[0] == tokens


def test_ids_are_the_tokenizer_files(spark):
    """On every text of a table, and where the ranks' pattern would give up."""
    import pyarrow.parquet as pq

    encoder = packing.Encoder()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    for text, wanted in zip(texts, encoder.full.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder(text).tolist() == [*wanted.ids, packing.END]
    for run in ("a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000 + "b", "a" * 1_000_000, "x" + "\u3000" * 300_000, (" " * 9_000 + "x") * 20):
        assert encoder(run).tolist() == [*encoder.full.encode(run, add_special_tokens=False).ids, packing.END]
    # Half a run decides; shorter ones may stay with the ranks.
    assert packing.has_long_run("a" * 3 + " " * packing.LONG_RUN + "b") and not packing.has_long_run("a " * 1000)


def test_packing_long_white_space(spark):
    texts = {1: "a" + " " * 1_000_000 + "b", 2: "a" + "\n" * 1_000_000 + "b", 3: "a" * 1_000_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packed(packing.pack_documents(spark, docs).collect(), texts, 1024)


def test_packing_awkward_rows(spark):
    df, rows = awkward(spark)
    unique = df.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packed(packing.pack_documents(spark, unique).collect(), {i: t for i, t, _ in rows if i is not None}, 1024)
    assert check_packed(packing.pack_documents(spark, df).collect(), {}, 1024)[0] == sum(len(public_ids(t or "")) + 1 for _, t, _ in rows)
    assert packing.pack_documents(spark, nothing(spark)).count() == 0


# 8


def brute_passages(rows, window=13):
    words = {i: WORDS.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 30])
def test_passages_go(spark, chunk):
    from textloom.llm import substring_dedup

    df, rows = awkward(spark)
    rng = np.random.default_rng(1)
    more = [(200 + i, " ".join([*(f"p{x}" for x in rng.integers(99, size=i)), *PASSAGE.split()[i % 11 : 12 + i % 29], *(f"q{x}" for x in rng.integers(3, size=25))])) for i in range(60)]
    both = common.pick(df, doc_id="long", text="string").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = substring_dedup.substring_dedup(spark, both.repartition(3), chunk_words=chunk).collect()
    want = brute_passages([(i, t) for i, t, _ in rows if i is not None] + more)
    assert len(found) == len(rows) + len(more)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert substring_dedup.substring_dedup(spark, nothing(spark)).count() == 0


def test_any_two_windows_share_an_aligned_anchor():
    from textloom.llm.substring_dedup import COVER, PERIOD

    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


# 9


def edits_within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        n = gone = 0
        left = []
        for line in (t or "").split("\n"):
            bare = line.strip(" \t\n\r\x0b\x0c")
            if bare:
                n += 1
                hit = any(edits_within_one(bare, x) for x in seen)
                if bare not in seen:
                    seen.append(bare)
                if hit:
                    gone += 1
                    continue
            left.append(line)
        out[i] = (n, gone, "\n".join(left))
    return out


def test_lines_within_one_edit_go(spark, monkeypatch):
    from textloom.llm import line_dedup

    df, rows = awkward(spark)
    rng = np.random.default_rng(4)
    texts = []
    for i in range(120):
        line = list("abcabc") if i % 2 else list("the quick brown fox é😀")
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(line)))
            line[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list("abé ")))] * int(rng.integers(0, 2))
        texts.append((300 + i, "".join(line) + f"\n{i}\nx"))
    both = common.pick(df, doc_id="long", text="string").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    want = brute_lines([(i, t) for i, t in {i: t for i, t, _ in rows if i is not None}.items()] + texts)
    for most in (500_000, 2):
        monkeypatch.setattr(line_dedup, "FETCH_BY_BROADCAST", most)
        found = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(spark, both.repartition(3)).collect()}
        assert found == want
    assert line_dedup.line_dedup(spark, df).count() == len(rows)
    assert line_dedup.line_dedup(spark, nothing(spark)).count() == 0


def test_variants_of_lines_are_never_broadcast(spark, monkeypatch):
    from textloom.llm import line_dedup

    plans = []

    class Seen(line_dedup.Scratch):
        def keep(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().keep(df)

    monkeypatch.setattr(line_dedup, "Scratch", Seen)
    out = line_dedup.line_dedup(spark, spark.createDataFrame([(i, f"a line of some length {i % 9}") for i in range(40)], "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    pairs, verified, last = plans[-3:]
    assert "variant" in pairs and "levenshtein" in verified and "kept" in last
    assert not any("Broadcast" in p for p in (pairs, verified, last))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé😀", min_size=1, max_size=9), st.integers(0, 8), st.sampled_from(["cut", "put", "swap"]), st.sampled_from("abé😀"))
def test_lines_one_edit_apart_share_half_and_variant(a, at, how, c):
    from textloom.llm.line_dedup import DELETED, SUBSTITUTED, WHOLE, half_keys, variants

    at %= len(a)
    b = {"cut": a[:at] + a[at + 1 :], "put": a[:at] + c + a[at:], "swap": a[:at] + c + a[at + 1 :]}[how]
    if b and a != b:
        both = set(half_keys(a)) & set(half_keys(b))
        assert both
        bits = [sum(1 << i for i, k in enumerate(half_keys(x)) if k in both) for x in (a, b)]
        va, vb = (set(variants(x, s)) for x, s in zip((a, b), bits))
        mates = {SUBSTITUTED: SUBSTITUTED, DELETED: WHOLE, WHOLE: DELETED}
        assert any((h, mates[k]) in vb for h, k in va)


# 10


def test_toxicity_held_out(spark):
    from textloom.llm.learning import labelled_sample
    from textloom.llm.toxicity import toxicity, without_toxic

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs, marks = queries.documents(spark, sf), queries.labels(spark, sf)
    found = toxicity(spark, docs, marks, sample=1500).collect()
    used = {r.doc_id for r in labelled_sample(docs, marks, ["quality", "toxic"], 1500).select("doc_id").collect()}
    held = [(r.rejected, labels[r.doc_id]) for r in found if r.doc_id in labels and r.doc_id not in used]
    clean = [r for r, t in held if not t]
    toxic = [r for r, t in held if t]
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.8 * len(toxic)
    few = docs.filter("doc_id < 500")
    stay = without_toxic(spark, few, marks)
    assert stay.columns == docs.columns and 0.8 * 500 < stay.count() < 500


def test_toxicity_of_awkward_rows(spark):
    from textloom.llm.toxicity import toxicity

    df, rows = awkward(spark)
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in range(1, 17)] + [(None, 1, 1, "x"), (2, None, 1, "x")], "doc_id long, quality int, toxic int, text string")
    found = toxicity(spark, df, labels, least_docs=1).collect()
    assert len(found) == len(rows) and all(0 <= r.p_toxic <= 1 for r in found)
    assert not any(r.rejected for r in toxicity(spark, df, labels.limit(0)).collect())
    assert toxicity(spark, nothing(spark), labels).count() == 0


def test_chain_feeds_earlier_probabilities():
    from textloom.llm.toxicity import ToxicityChain

    rng = np.random.default_rng(0)
    y0 = rng.integers(0, 2, 400)
    present = [[int(v)] for v in y0]
    chain = ToxicityChain.fit(["a", "toxic"], [b"x", b"y"], present, np.stack([y0, y0], 1))
    assert len(chain.weights[0]) == 3 and len(chain.weights[1]) == 4 and chain.weights[1][2] > 0.1
    p = chain.score([b"y", b"x"])
    assert p[0, 1] > 0.9 and p[1, 1] < 0.1


# The pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark)
    for name, stage in pipeline.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if name != "packing":
            assert docs.columns == before.columns
        was = {r.doc_id: r.text for r in before.collect()} if name != "packing" else {}
        if name == "exact_dedup":
            last = {lower(t): i for i, t in sorted(was.items())}
            assert {r.doc_id for r in docs.collect()} == set(last.values())
        if name == "near_dedup":
            want = brute_components(was.items())
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if c == i}
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} <= set(was)
    assert check_packed(docs.collect(), {}, 1024)[0] > 0
    assert pipeline.run(spark, sf_dir).count() == docs.count()
