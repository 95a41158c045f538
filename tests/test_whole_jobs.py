"""Queries that do the whole job where SQL says a part of it, against loops in Python."""

import collections
import math
import re
import unicodedata
import zlib

import pytest

from textloom.operators import dedup, filters
from textloom.plans import queries as plans


def stored(spark, path, rows):
    """A scale folder with these (doc_id, text, lang, source) as its documents."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def brute_preprocess(rows, least=50, languages=("en", "de")):
    """doc_id -> (clean, reason), by the reference's loop."""
    seen, out = set(), {}
    for i, text, lang, source in sorted(rows):
        clean = text or ""
        for pattern in (r"<[^>]+>", "&[a-zA-Z]+;", r"https?://\S+"):
            clean = re.sub(pattern, " ", clean)
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", unicodedata.normalize("NFKC", clean))
        clean = " ".join(clean.split())
        reason = "kept"
        if not text:
            reason = "empty"
        elif len(clean) < least:
            reason = "too_short"
        elif (source, clean) in seen:
            reason = "duplicate"
        else:
            seen.add((source, clean))
            if lang not in languages:
                reason = "language"
        out[i] = clean, reason
    return out


def test_preprocessing_takes_documents_that_are_not_ascii(spark, sf_dir, tmp_path):
    body = "the café sells <b>ﬁne</b> naïve pastries and Ａpple tarts until ten"
    rows = [(1, body, "de", "a"), (2, body.replace("ﬁ", "fi"), "en", "a"), (3, body, "en", "b"), (4, body + " à Paris", "fr", "a"), (5, None, "en", "a"), (6, "", "en", "a"), (7, "é" * 49, "en", "a"), (8, body + " x", None, "a"), (9, "plain " * 20, "en", "a")]
    documents = [(r.seq, r.text, r.lang, r.source) for r in plans.docs(spark, sf_dir).collect()]
    for sf, given in ((stored(spark, tmp_path, rows), rows), (sf_dir, documents)):
        want = brute_preprocess(given)
        assert {r.doc_id: (r.clean, r.reason) for r in plans.QUERIES["preprocess_clean_all"](spark, sf).collect()} == want
        kept = [c for c, reason in want.values() if reason == "kept"]
        report = plans.QUERIES["preprocess_report_all"](spark, sf).first()
        assert (report.n_total, report.n_kept, report.total_chars) == (len(given), len(kept), sum(map(len, kept)))
        assert all(report[f"removed_{k}"] == sum(reason == k for _, reason in want.values()) for k in ("empty", "too_short", "duplicate", "language"))


def brute_quality(text):
    """The first bound that a text breaks, or None."""
    words = text.split()
    lower = collections.Counter(text.lower().split())
    lines = text.strip().split("\n")
    if len(text.strip()) < 20:
        return "too_short"
    if len(words) < 10:
        return "word_count"
    plain = text.encode()
    measured = {
        "url_ratio": (sum(map(len, re.findall(r"https?://\S+|www\.\S+", text))) / len(text), 0.0, 0.15),
        "digit_ratio": (sum(c.isdigit() for c in text) / len(text), 0.0, 0.5),
        "symbol_ratio": (sum(not c.isalnum() and not c.isspace() for c in text) / len(text), 0.0, 0.3),
        "duplicate_line_ratio": (1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0.0, 0.0, 0.5),
        "average_word_length": (sum(map(len, words)) / len(words), 2.0, 15.0),
        "max_repeated_token_frequency": (max(lower.values()) / len(words), 0.0, 0.15),
        "character_entropy": (-sum(c / len(text) * math.log2(c / len(text)) for c in collections.Counter(text).values()), 3.0, 8.0),
        "compression_ratio": (len(zlib.compress(plain)) / len(plain) if len(text) >= 100 else 1.0, 0.2, 0.9),
        "type_token_ratio": (len(lower) / len(words), 0.1, 1.0),
    }
    for name, (value, least, most) in measured.items():
        if value < least or value > most:
            return f"{name}<min" if value < least else f"{name}>max"
    return None


def brute_chain(spark, rows):
    """doc_id -> reason, by the reference's loop over its ten filters, bounds and duplicates; rules of single filters as tested elsewhere."""
    order = "nsfw gambling seo_spam html_code repeated_content language_quality ocr_garbage document_length unicode_quality language".split()
    plain = {}
    for i, text, *_ in rows:
        bare = " ".join(re.sub("&[a-zA-Z]+;|&#[0-9]+;|&#x[0-9a-fA-F]+;", " ", re.sub("<[^>]+>", " ", text or "")).split())
        plain[i] = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", bare)
    df = spark.createDataFrame(list(plain.items()), "seq long, text string")
    hits = {name: {r.seq: r.rule for r in filters.apply_filter(df, name).collect()} for name in order}
    signatures = {r.seq: r.signature for r in dedup.minhash_signatures(df).collect()}
    out, seen, buckets = {}, set(), set()
    for i, text, *_ in sorted(rows):
        first = next((f"{name}:{hits[name][i]}" for name in order if hits[name][i]), None)
        key = " ".join(plain[i].lower().split())
        bands = {(k, tuple(signatures[i][k * 8 : k * 8 + 8])) for k in range(16)}
        if not (text or "").strip():
            out[i] = "empty"
        elif first or brute_quality(plain[i]):
            out[i] = first or f"quality:{brute_quality(plain[i])}"
        elif key in seen:
            out[i] = "dedup:exact_duplicate"
        else:
            seen.add(key)
            out[i] = "dedup:minhash_lsh" if bands & buckets else "keep"
            buckets |= bands if out[i] == "keep" else set()
    return out


GOOD = (
    "The old harbour town was quiet that morning, and most people had not yet come out of their houses. A few of the men who work with the boats "
    "would look up at the sky, think about the weather, and then go back to their nets. It is said that no good day at sea can start in such a fog, but they know better than that."
)


def test_whole_cleaning_chain(spark, sf_dir, tmp_path):
    long_copies = " ".join(f"{GOOD[k:]} {GOOD}" for k in range(20))
    rows = [
        (1, GOOD, "keep"),
        (2, GOOD.replace("quiet", "quiet......."), "repeated_content:repeated_char"),
        (3, GOOD.replace("no good", "no good good GOOD good"), "repeated_content:repeated_word"),
        (4, GOOD.replace(" ", "\n ").upper().lower(), "dedup:exact_duplicate"),
        (5, GOOD + " Nobody minds.", "dedup:minhash_lsh"),
        (6, (GOOD + " Nobody minds.").upper().lower(), "dedup:exact_duplicate"),
        (7, long_copies, "quality:compression_ratio<min"),
        (8, " \n\t", "empty"),
        (9, None, "empty"),
        (10, "<p>too&nbsp;short</p>" + "<br>" * 20, "document_length:too_short"),
        (11, "This is a text that would be kept but is short of one hundred signs.", "quality:compression_ratio>max"),
        (12, "sex " * 5 + "a" * 9, "nsfw:nsfw_density"),
    ]
    small = [(i, t, "en", "a") for i, t, _ in rows]
    found = {r.doc_id: r.reason for r in plans.QUERIES["clean_chain_full"](spark, stored(spark, tmp_path, small)).collect()}
    assert found == brute_chain(spark, small) == {i: reason for i, _, reason in rows}
    documents = [(r.seq, r.text) for r in plans.docs(spark, sf_dir).collect()]
    want = brute_chain(spark, documents)
    assert {r.doc_id: r.reason for r in plans.QUERIES["clean_chain_full"](spark, sf_dir).collect()} == want
    counts = collections.Counter(want[i] for i in sorted(want) if want[i] != "keep")
    assert [(r.reason, r.n) for r in plans.QUERIES["removal_reasons_top50_full"](spark, sf_dir).collect()] == counts.most_common(50)


def test_quality_queries_apply_the_compression_bound(spark, sf_dir, tmp_path):
    planted = [(1, " ".join(f"{GOOD[k:]} {GOOD}" for k in range(20)), "en", "a"), (2, GOOD, "en", "a"), (3, GOOD[:99], "en", "a"), (4, GOOD + " \n" + GOOD, "en", "a")]
    documents = [(r.seq, r.text, r.lang, r.source) for r in plans.docs(spark, sf_dir).collect()]
    found = {}
    for sf, given in ((stored(spark, tmp_path, planted), planted), (sf_dir, documents)):
        found[sf] = {r.doc_id: r.rule for r in plans.QUERIES["quality_filter_full"](spark, sf).collect()}
        assert found[sf] == {i: brute_quality(t or "") or "keep" for i, t, *_ in given}
        want = {i: len(zlib.compress(t.encode())) / len(t.encode()) if len(t) >= 100 else 1.0 for i, t, *_ in given}
        assert {r.doc_id: r.compression_ratio for r in plans.QUERIES["quality_metrics_full"](spark, sf).collect()} == pytest.approx(want, abs=1e-6)
        row = plans.QUERIES["quality_summary_full"](spark, sf).filter("metric = 'compression_ratio'").first()
        assert (row["mean"], row["least"], row["most"]) == pytest.approx((sum(want.values()) / len(want), min(want.values()), max(want.values())), abs=1e-5)
    assert [found[str(tmp_path)][i] for i in (1, 2, 3)] == ["compression_ratio<min", "keep", "compression_ratio>max"]


def test_sets_are_written_once_and_compared_with_one_first_row(spark, monkeypatch):
    import random

    from textloom.operators import dedup

    draw, written = random.Random(8), []
    bases = [[f"w{draw.randrange(400)}" for _ in range(30)] for _ in range(8)]
    rows = []
    for i in range(90):
        words = list(draw.choice(bases))
        for _ in range(draw.randrange(3)):
            words[draw.randrange(30)] = f"x{draw.randrange(20)}"
        rows.append((i, " ".join(words), draw.choice(["a", "b"])))
    keep = dedup.Tables.keep
    monkeypatch.setattr(dedup.Tables, "keep", lambda self, df: written.append(df.columns) or keep(self, df))
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(28)}
    sets = {(frozenset(grams(t)), lang): i for i, t, lang in reversed(rows)}
    firsts = sorted((i, s, lang) for (s, lang), i in sets.items())
    want = {(i, j): len(s & z) / len(s | z) for i, s, one in firsts for j, z, two in firsts if i < j and one == two and len(s & z) >= 0.6 * len(s | z)}
    frame = spark.createDataFrame(rows, "seq long, text string, lang string")
    for together, ids, held in ((1_000, 1_000_000, 2_000_000), (3, 1_000_000, 100), (1_000, 0, 100)):
        for name, value in (("MOST_TOGETHER", together), ("MOST_IDS", ids), ("HELD", held)):
            monkeypatch.setattr(dedup, name, value)
        for join in (dedup.similar_sets, dedup.links_by_heads):
            written.clear()
            _, links = join(spark, frame, 3, 0.6, "lang")
            assert {(r.earlier, r.later): pytest.approx(r.similarity) for r in links.collect()} == want
            assert sum("items" in c for c in written) == (1 if ids else 1 + (join is dedup.similar_sets))
