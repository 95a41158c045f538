"""Named queries over the standard tables, and SQL for DuckDB that says the same in its own way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from ..operators import cleaning, corpora, dedup, documents, evaluation, filters, generate, mixture, normalize, quality, samples, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")


# Pieces of SQL


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WS = lex.WS
W = f"list_filter(regexp_split_to_array(text, {q(WS + '+')}), lambda w: w <> '')"
N = f"len({W})"
L = "length(text)"


def n_of(pattern: str, of: str = "text") -> str:
    return f"len(regexp_extract_all({of}, {q(pattern)}))"


def strip_sql(of: str) -> str:
    return f"regexp_replace({of}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def chars_sql(chars: str, of: str = "text") -> str:
    return f"length(regexp_replace({of}, {q(f'[^{chars}]')}, '', 'g'))"


def mode_sql(items: str) -> str:
    return f"coalesce(list_max(map_values(list_aggregate({items}, 'histogram'))), 0)"


def collapsed_sql(of: str) -> str:
    return f"trim(regexp_replace({of}, {q(WS + '+')}, ' ', 'g'))"


LOWER_COLLAPSED = collapsed_sql("lower(text)")
KEY_B = collapsed_sql(f"regexp_replace(lower(text), {q('[^a-z0-9' + WS[1:-1] + ']')}, ' ', 'g')")

# Preprocessing

CLEAN = collapsed_sql(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {q(lex.TAG)}, ' ', 'g'), {q(lex.NAMED_ENTITY)}, ' ', 'g'), {q(lex.HTTP_URL)}, ' ', 'g'), {q(normalize.CONTROLS)}, '', 'g')")
PREPROCESSED = f"""
    WITH c AS (SELECT doc_id, lang, source, text, CASE WHEN ascii_only THEN {CLEAN} ELSE NULL END AS clean
               FROM (SELECT *, regexp_full_match(text, '[\\x00-\\x7F]*') AS ascii_only FROM documents) WHERE ascii_only),
    r AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN length(clean) < 50 THEN 'too_short' END AS r0 FROM c),
    d AS (SELECT *, coalesce(r0, CASE WHEN doc_id <> min(CASE WHEN r0 IS NULL THEN doc_id END) OVER (PARTITION BY source, CASE WHEN r0 IS NULL THEN clean END) THEN 'duplicate' END,
                 CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END) AS reason FROM r)
"""


def _preprocessed(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """All documents, or the ASCII ones, for which NFKC changes nothing and SQL can say the same."""
    rows = docs(spark, sf_dir)
    rows = rows.filter(F.col("text").rlike(r"^[\x00-\x7F]*\z")) if ascii_only else rows
    return normalize.preprocess(rows, min_length=50, languages=["en", "de"])


def _with_reasons(preprocessed: DataFrame) -> DataFrame:
    return preprocessed.select(F.col("seq").alias("doc_id"), "clean", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("preprocess_clean", PREPROCESSED + "SELECT doc_id, clean, coalesce(reason, 'kept') AS reason FROM d")
def preprocess_clean(spark, sf_dir):
    """The ASCII documents alone; preprocess_clean_all takes all."""
    return _with_reasons(_preprocessed(spark, sf_dir, ascii_only=True))


@query("preprocess_clean_all")
def preprocess_clean_all(spark, sf_dir):
    return _with_reasons(_preprocessed(spark, sf_dir))


@query("preprocess_report", PREPROCESSED + """
    SELECT count(*) AS n_total, count(*) FILTER (reason IS NULL) AS n_kept, count(*) FILTER (reason = 'empty') AS removed_empty, count(*) FILTER (reason = 'too_short') AS removed_too_short,
           count(*) FILTER (reason = 'duplicate') AS removed_duplicate, count(*) FILTER (reason = 'language') AS removed_language,
           CAST(sum(length(clean)) FILTER (reason IS NULL) AS BIGINT) AS total_chars, CAST(sum(length(clean) // 4) FILTER (reason IS NULL) AS BIGINT) AS estimated_tokens,
           round_even(count(*) FILTER (reason IS NULL) / count(*), 4) AS retention_rate FROM d""")  # fmt: skip
def preprocess_report(spark, sf_dir):
    """Counts of the ASCII documents alone; preprocess_report_all counts all."""
    return normalize.preprocess_report(_preprocessed(spark, sf_dir, ascii_only=True))


@query("preprocess_report_all")
def preprocess_report_all(spark, sf_dir):
    return normalize.preprocess_report(_preprocessed(spark, sf_dir))


@query("preprocess_unicode")
def preprocess_unicode(spark, sf_dir):
    return normalize.preprocess(docs(spark, sf_dir)).select("seq", "clean", "reason")


@query("strip_html_pages", f"SELECT page_id, regexp_replace({collapsed_sql(f'''regexp_replace(regexp_replace(html, {q(lex.TAG)}, ' ', 'g'), {q(lex.ENTITY)}, ' ', 'g')''')}, {q(normalize.ALL_CONTROLS)}, '', 'g') AS text FROM pages")
def strip_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize.corpus_text(F.col("html")).alias("text"))


# Filters: (rule if ...) in SQL, on documents, or on pages as text

RULES = {
    "nsfw": f"CASE WHEN {L} < 20 OR {N} = 0 THEN NULL WHEN ({n_of(lex.SEXUAL)} + 2 * {n_of(lex.SERVICE)}) / {N} > 0.03 THEN 'nsfw_density' WHEN {N} < 100 AND {n_of(lex.SEXUAL)} + {n_of(lex.SERVICE)} > 3 THEN 'nsfw_count' END",
    "gambling": f"CASE WHEN {L} < 20 OR {N} = 0 THEN NULL WHEN {n_of(lex.GAMBLING)} / {N} > 0.02 THEN 'gambling_density' END",
    "seo_spam": f"CASE WHEN {L} < 30 OR {N} < 5 THEN NULL WHEN {n_of(lex.URL)} / {N} > 0.1 THEN 'url_density' WHEN {mode_sql(f'list_transform(list_filter({W}, lambda w: length(w) > 3), lambda w: lower(w))')} / {N} > 0.08 THEN 'keyword_stuffing' WHEN {n_of(lex.LINK_FARM)} > 3 THEN 'link_farm' WHEN {N} > 10 AND len(list_filter({W}, lambda w: length(w) > 1 AND regexp_matches(w, '\\p{{Lu}}') AND w = upper(w))) / {N} > 0.3 THEN 'caps_ratio' END",
    "html_code": f"CASE WHEN {L} < 10 THEN NULL WHEN regexp_matches(text, {q('^(?:' + lex.XML_DECLARATION + ')')}) THEN 'xml_declaration' WHEN length({strip_sql('text')}) > 100 AND regexp_matches({strip_sql('text')}, '(?s)^[{{\\[].*[}}\\]]$') THEN 'json_blob' WHEN regexp_matches(text, {q(lex.BASE64)}) THEN 'base64_blob' WHEN {N} > 0 AND {n_of(lex.TAG)} / {N} > 0.3 THEN 'html_density' WHEN {n_of(lex.BLOCK)} > 5 THEN 'css_blocks' WHEN {n_of(lex.SCRIPT)} > 3 THEN 'script_blocks' WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500 AND length(x) - length(replace(x, ' ', '')) < 10)) > 0 THEN 'minified' END",
    "language_quality": f"CASE WHEN {L} < 20 THEN NULL WHEN {chars_sql(chr(92) + 'p{L}')} / {L} < 0.5 THEN 'low_alpha_ratio' WHEN {N} > 0 AND {n_of(lex.URL)} / {N} > 0.15 THEN 'high_url_density' WHEN {chars_sql(''' .,!?;:()-[]{}'''.strip().replace('-[]', chr(92) + '-' + chr(92) + '[' + chr(92) + ']') + chr(34) + chr(39))} / {L} > 0.4 THEN 'high_punct_ratio' WHEN list_aggregate(string_split(text, ''), 'entropy') < 3.0 THEN 'low_entropy' WHEN {n_of('[^\\x00-\\x7F]{10,}')} > 5 THEN 'ocr_garbage' WHEN regexp_matches(text, {q(lex.MOJIBAKE)}) THEN 'mojibake' END",
    "ocr_garbage": f"CASE WHEN {L} < 20 OR {N} = 0 THEN NULL WHEN {n_of('(?m)' + lex.OCR)} / {N} > 0.05 THEN 'ocr_density' END",
    "document_length": f"CASE WHEN {L} = 0 THEN 'empty_document' WHEN {L} < 50 THEN 'too_short' END",
    "unicode_quality": f"CASE WHEN regexp_matches(text, {q(normalize.ALL_CONTROLS)}) THEN 'control_chars' WHEN regexp_matches(text, '\\x{{fffd}}') THEN 'replacement_chars' WHEN {n_of('[\\x{10000}-\\x{10FFFF}]')} > 10 THEN 'non_bmp' END",
    "language": f"CASE WHEN {L} < 50 OR {N} < 10 THEN NULL WHEN len(list_filter({W}, lambda w: list_contains({list(lex.ENGLISH)!r}, regexp_replace(lower(w), '^[.,!?;:()]+|[.,!?;:()]+$', '', 'g')))) / {N} < 0.15 THEN 'non_english' WHEN {chars_sql('a-zA-Z')} / {L} < 0.5 THEN 'non_latin' END",
}


def _filtered(name: str, on: str) -> Query:
    key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[on]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, on).select(key, F.col(text).alias("text"))
        return filters.apply_filter(rows, name).select(key, F.coalesce("rule", F.lit("keep")).alias("rule"))

    return run


for _name, _rule in RULES.items():
    query(f"filter_{_name}", f"SELECT doc_id, coalesce({_rule}, 'keep') AS rule FROM documents")(_filtered(_name, "documents"))
for _name in ("html_code", "seo_spam"):
    query(f"filter_{_name}_pages", f"SELECT page_id, coalesce({RULES[_name]}, 'keep') AS rule FROM (SELECT page_id, html AS text FROM pages)")(_filtered(_name, "pages"))
query("filter_repeated_content")(_filtered("repeated_content", "documents"))

CHAIN = ("document_length", "unicode_quality", "nsfw", "gambling", "seo_spam", "html_code", "language_quality", "ocr_garbage", "language")
CHAINED = "SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN ({RULES[n]}) IS NOT NULL THEN '{n}:' || ({RULES[n]}) END" for n in CHAIN) + ", 'keep') AS reason FROM documents"


def _top_reasons(chained: DataFrame) -> DataFrame:
    # A filter on the key would be pushed below the aggregation and have every rule evaluated once more.
    counts = chained.groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), (F.max("reason") != "keep").alias("hit")).filter("hit")
    return counts.orderBy(F.desc("n"), "first").limit(50).select("reason", "n")


def _chained(spark, sf_dir):
    """Nine filters on the raw text, as SQL can say them; clean_chain_full is the whole chain."""
    out = filters.chain(table(spark, sf_dir, "documents"), list(CHAIN))
    return out.select("doc_id", F.coalesce(F.concat("stage", F.lit(":"), "rule"), F.lit("keep")).alias("reason"))


query("clean_chain", CHAINED)(_chained)


@query("removal_reasons_top50", f"SELECT reason, count(*) AS n FROM ({CHAINED}) WHERE reason <> 'keep' GROUP BY reason ORDER BY n DESC, min(doc_id) LIMIT 50")
def removal_reasons(spark, sf_dir):
    return _top_reasons(_chained(spark, sf_dir))


@query("clean_chain_full")
def clean_chain_full(spark, sf_dir):
    """All ten content filters in the configured order on normalised text, then quality bounds and duplicates."""
    return cleaning.clean_documents(spark, docs(spark, sf_dir)).select(F.col("seq").alias("doc_id"), F.coalesce("reason", F.lit("keep")).alias("reason"))


@query("removal_reasons_top50_full")
def removal_reasons_full(spark, sf_dir):
    return _top_reasons(clean_chain_full(spark, sf_dir))


LW = f"list_transform({W}, lambda w: lower(w))"
LINES = f"string_split({strip_sql('text')}, chr(10))"
SENTENCES = f"regexp_split_to_array({strip_sql('text')}, '[.!?]+')"
SPOKEN = f"list_filter({SENTENCES}, lambda s: {strip_sql('s')} <> '')"
METRIC_SQL = {
    "url_ratio": f"coalesce(list_sum(list_transform(regexp_extract_all(text, {q(lex.PLAIN_URL)}), lambda u: length(u))), 0) / greatest({L}, 1)",
    "digit_ratio": f"{chars_sql(chr(92) + 'p{Nd}' + chr(92) + 'x{b2}' + chr(92) + 'x{b3}' + chr(92) + 'x{b9}')} / greatest({L}, 1)",
    "symbol_ratio": f"length(regexp_replace(text, {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + WS[1:-1] + ']')}, '', 'g')) / greatest({L}, 1)",
    "duplicate_line_ratio": f"CASE WHEN len({LINES}) < 2 THEN 0 ELSE 1 - len(list_distinct({LINES})) / len({LINES}) END",
    "average_word_length": f"CASE WHEN {N} = 0 THEN 0 ELSE list_sum(list_transform({W}, lambda w: length(w))) / {N} END",
    "max_repeated_token_frequency": f"CASE WHEN {N} = 0 THEN 0 ELSE {mode_sql(LW)} / {N} END",
    "character_entropy": f"CASE WHEN {L} = 0 THEN 0 ELSE list_aggregate(string_split(text, ''), 'entropy') END",
    "word_entropy": f"coalesce(list_aggregate({LW}, 'entropy'), 0)",
    "type_token_ratio": f"CASE WHEN {N} = 0 THEN 0 ELSE len(list_distinct({LW})) / {N} END",
    "sentence_count": f"len({SENTENCES})",
    "average_sentence_length": f"CASE WHEN len({SPOKEN}) = 0 THEN 0 ELSE list_sum(list_transform({SPOKEN}, lambda s: len(list_filter(regexp_split_to_array(s, {q(WS + '+')}), lambda w: w <> '')))) / len({SPOKEN}) END",
    "paragraph_count": f"len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {strip_sql('p')} <> ''))",
    "char_count": L,
    "word_count": N,
}
FLOATS = [n for n in quality.METRICS if not n.endswith("_count")]
MEASURED = "SELECT doc_id, text, " + ", ".join(f"{sql} AS {n}" for n, sql in METRIC_SQL.items()) + " FROM documents"


def _measured(spark, sf_dir, compression: bool = False):
    return quality.metrics(table(spark, sf_dir, "documents"), compression)


def _rounded(measured_df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return measured_df.select("doc_id", *[F.col(n).cast("bigint").alias(n) if n.endswith("_count") else F.round(F.col(n).cast("double"), 6).alias(n) for n in names])


def _ruled(measured_df: DataFrame) -> DataFrame:
    return quality.quality_filter(measured_df).select("doc_id", F.coalesce("quality_rule", F.lit("keep")).alias("rule"))


def _summed_up(measured_df: DataFrame) -> DataFrame:
    return quality.summary(measured_df).select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")])


@query("quality_metrics", "SELECT doc_id, " + ", ".join(f"CAST(round({n}, 6) AS DOUBLE) AS {n}" if n in FLOATS else f"CAST({n} AS BIGINT) AS {n}" for n in quality.METRICS) + f" FROM ({MEASURED})")
def quality_metrics(spark, sf_dir):
    return _rounded(_measured(spark, sf_dir), quality.METRICS)


@query("quality_filter", "SELECT doc_id, CASE WHEN length(" + strip_sql("text") + ") < 20 THEN 'too_short' WHEN word_count < 10 THEN 'word_count' WHEN sentence_count < 1 THEN 'sentence_count' "
       + " ".join((f"WHEN {n} < {lo} THEN '{n}<min' " if lo is not None else "") + (f"WHEN {n} > {hi} THEN '{n}>max'" if hi is not None else "") for n, lo, hi in quality.BOUNDS if n in METRIC_SQL) + f" ELSE 'keep' END AS rule FROM ({MEASURED})")
def quality_filter(spark, sf_dir):
    return _ruled(_measured(spark, sf_dir))


@query("quality_summary", " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}), 6) AS mean, CAST(round(min({n}), 6) AS DOUBLE) AS least, CAST(round(max({n}), 6) AS DOUBLE) AS most FROM m" for n in quality.METRICS).join([f"WITH m AS ({MEASURED}) ", ""]))
def quality_summary(spark, sf_dir):
    return _summed_up(_measured(spark, sf_dir))


# The same with the compression ratio and its bounds, for which SQL has no zlib


@query("quality_metrics_full")
def quality_metrics_full(spark, sf_dir):
    return _rounded(_measured(spark, sf_dir, compression=True), quality.ALL_METRICS)


@query("quality_filter_full")
def quality_filter_full(spark, sf_dir):
    return _ruled(_measured(spark, sf_dir, compression=True))


@query("quality_summary_full")
def quality_summary_full(spark, sf_dir):
    return _summed_up(_measured(spark, sf_dir, compression=True))


@query("compression_ratio")
def compression_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.zlib_ratio(F.col("text")).alias("compression_ratio"))


# Deduplication


@query("dedup_exact_norm", f"SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY {LOWER_COLLAPSED}) AS duplicate FROM documents")
def dedup_exact_norm(spark, sf_dir):
    out = dedup.first_by_key(docs(spark, sf_dir).select("seq", "text"), F.sha2(normalize.dedup_text(F.col("text")), 256))
    return out.select(F.col("seq").alias("doc_id"), "duplicate")


@query("dedup_by_source", "SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY source, text) AS duplicate FROM documents")
def dedup_by_source(spark, sf_dir):
    return dedup.first_by_key(docs(spark, sf_dir), F.sha2("text", 256), "source").select(F.col("seq").alias("doc_id"), "duplicate")


@query("dedup_two_tier", f"""
    WITH e AS (SELECT doc_id, text, doc_id <> min(doc_id) OVER (PARTITION BY text) AS x FROM documents),
    n AS (SELECT *, min(doc_id) FILTER (NOT x) OVER (PARTITION BY {KEY_B}) AS f FROM e)
    SELECT doc_id, CASE WHEN x THEN 'exact' WHEN doc_id <> f THEN 'normalized' ELSE 'kept' END AS reason FROM n""")
def dedup_two_tier(spark, sf_dir):
    return dedup.two_tier(docs(spark, sf_dir).select("seq", "text")).select(F.col("seq").alias("doc_id"), F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("dedup_quota_by_source", """
    WITH f AS (SELECT doc_id, source FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY source, md5(text)))
    SELECT doc_id, source FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20""")
def dedup_quota(spark, sf_dir):
    first = dedup.first_by_key(docs(spark, sf_dir), F.md5("text"), "source").filter("not duplicate")
    return dedup.quota(first.select("seq", "source"), 20, "source").withColumnRenamed("seq", "doc_id")


@query("minhash_signatures")
def minhash_signatures(spark, sf_dir):
    return dedup.minhash_signatures(docs(spark, sf_dir))


@query("minhash_dedup")
def minhash_dedup(spark, sf_dir):
    return dedup.minhash_dedup(spark, docs(spark, sf_dir))


def similar_sql(k: int, least: float, scope: str = "0", key: str = KEY_B, rows: str = "SELECT doc_id, lang, source, text FROM documents") -> str:
    """CTEs up to j (earlier, later, similarity): pairs of one scope whose sets of k-word shingles are similar enough."""
    return f"""
    t AS (SELECT doc_id, {scope} AS scope, list_filter(string_split({key}, ' '), lambda w: w <> '') AS ws FROM ({rows})),
    s AS (SELECT DISTINCT doc_id, scope, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) ELSE ws END) AS k FROM t),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS earlier, b.doc_id AS later, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.scope = b.scope AND a.doc_id < b.doc_id GROUP BY 1, 2),
    j AS (SELECT earlier, later, m / (x.n + y.n - m) AS similarity FROM p JOIN c x ON x.doc_id = earlier JOIN c y ON y.doc_id = later WHERE m / (x.n + y.n - m) >= {least})"""


#: The rows that the loop drops, one after another: those with an earlier similar one that isn't dropped.
GREEDY = """
    e AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM (SELECT later AS id, list(earlier) AS before FROM j GROUP BY later)),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone
          UNION ALL SELECT e.i, CASE WHEN len(list_filter(e.before, lambda x: NOT list_contains(g.gone, x))) > 0 THEN list_append(g.gone, e.id) ELSE g.gone END FROM g JOIN e ON e.i = g.i + 1),
    dropped AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM g ORDER BY i DESC LIMIT 1))"""


@query("jaccard_pairs", f"WITH {similar_sql(5, 0.85, 'lang')} SELECT earlier, later, round(similarity, 6) AS similarity FROM j")
def jaccard_pairs(spark, sf_dir):
    return dedup.jaccard_pairs(spark, docs(spark, sf_dir), 5, 0.85, "lang").withColumn("similarity", F.round("similarity", 6))


@query("neardup_by_lang", f"WITH RECURSIVE {similar_sql(5, 0.85, 'lang')}, {GREEDY} SELECT doc_id, doc_id NOT IN (SELECT id FROM dropped) AS kept FROM documents")
def neardup_by_lang(spark, sf_dir):
    return dedup.near_dedup(spark, docs(spark, sf_dir), 5, 0.85, "lang").withColumnRenamed("seq", "doc_id")


@query("tfidf_pairs")
def tfidf_pairs(spark, sf_dir):
    return dedup.tfidf_pairs(docs(spark, sf_dir)).withColumn("similarity", F.round("similarity", 5))


@query("fingerprint_dedup", f"SELECT conv_id, turn, conv_id * 1000 + turn <> min(conv_id * 1000 + turn) OVER (PARTITION BY {collapsed_sql('text')}) AS duplicate FROM conversations")
def fingerprint_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    return dedup.first_by_key(rows, samples.fingerprint(F.lit(""), F.col("text"))).select("conv_id", "turn", "duplicate")


# Mixtures and statistics


def _mixture(spark, sf_dir):
    frames = {"documents": docs(spark, sf_dir), "benchmark": table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "seq")}
    return mixture.union(frames, {"documents": 500, "benchmark": 30})


def _placed(spark, sf_dir):
    rows = _mixture(spark, sf_dir)
    return mixture.numbered(rows, corpora.cells_for(rows), 42, "source", "seq")


MIXED = "SELECT 'documents' AS source, doc_id AS seq, text FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500) UNION ALL SELECT 'benchmark', item_id, text FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 30)"
SHUFFLED = f"SELECT *, row_number() OVER (ORDER BY md5('42:' || source || ':' || seq), source, seq) - 1 AS pos FROM ({MIXED})"


@query("mixture_build", f"SELECT source, seq, pos, md5(text) AS text_md5 FROM ({SHUFFLED})")
def mixture_build(spark, sf_dir):
    return _placed(spark, sf_dir).select("source", "seq", "pos", F.md5("text").alias("text_md5"))


@query("mixture_shards", f"WITH s AS ({SHUFFLED}) SELECT CAST(pos // greatest(1, (SELECT count(*) FROM s) // 10) AS BIGINT) AS shard, count(*) AS n FROM s GROUP BY 1")
def mixture_shards(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    return mixture.shards(placed, _mixture(spark, sf_dir).count()).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("n"))


@query("mixture_stats", f"SELECT coalesce(source, 'all') AS source, count(*) AS docs, CAST(sum({L}) AS BIGINT) AS chars, CAST(sum(greatest(1, {L} // 4)) AS BIGINT) AS tokens, round_even(avg({L}), 1) AS avg_chars FROM documents GROUP BY ROLLUP (source)")
def mixture_stats(spark, sf_dir):
    return mixture.source_statistics(table(spark, sf_dir, "documents")).select(F.when(F.col("all_sources") == 1, "all").otherwise(F.col("source")).alias("source"), "docs", "chars", "tokens", "avg_chars")


@query("corpus_metadata", f"SELECT count(*) AS docs, CAST(sum({L}) AS BIGINT) AS chars, CAST(sum({N}) AS BIGINT) AS words, CAST(sum({L}) // 4 AS BIGINT) AS tokens, CAST(round_even(sum({L}) / count(*), 0) AS BIGINT) AS avg_chars, CAST(round_even(sum({N}) / count(*), 0) AS BIGINT) AS avg_words FROM documents")
def corpus_metadata(spark, sf_dir):
    return mixture.corpus_metadata(table(spark, sf_dir, "documents"))


BUCKET = "CASE " + " ".join(f"WHEN {L} // 4 <= {n} THEN '{n}'" for n in lex.CONTEXT_LENGTHS) + f" ELSE '>{lex.CONTEXT_LENGTHS[-1]}' END"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("tokens", tx.estimated_tokens(F.col("text")))


@query("context_buckets", f"SELECT {BUCKET} AS bucket, count(*) AS docs FROM documents GROUP BY 1")
def context_buckets(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(mixture.context_bucket(F.col("tokens")).alias("bucket")).agg(F.count("*").alias("docs"))


@query("stats_by_dimension", " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS docs, CAST(sum({L} // 4) AS BIGINT) AS tokens FROM documents GROUP BY {d}" for d in ("lang", "source")))
def stats_by_dimension(spark, sf_dir):
    return mixture.by_dimension(_tokens(spark, sf_dir), "lang", "source")


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return mixture.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("routing_lookup", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'a' WHEN source = 'src2' THEN 'b' ELSE CASE lang WHEN 'de' THEN 'c' WHEN 'fr' THEN 'd' ELSE 'e' END END AS teacher FROM documents")
def routing_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task_type"), F.col("lang").alias("domain"))
    tasks, domains = spark.createDataFrame([("src1", "a"), ("src2", "b")], "task_type string, teacher string"), spark.createDataFrame([("de", "c"), ("fr", "d")], "domain string, teacher string")
    return mixture.routed(items, tasks, domains, "e").select("doc_id", "teacher")


@query("fallback_source", "SELECT item_id AS seq FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = 'nowhere')")
def fallback_source(spark, sf_dir):
    """A source without rows, and one to take in its place."""
    got = docs(spark, sf_dir).filter("source = 'nowhere'").select("seq")
    return corpora.source_or(lambda: got, lambda: table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq")))


@query("bottomk_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def bottomk_sample(spark, sf_dir):
    return mixture.bottom_k(table(spark, sf_dir, "documents").select("doc_id"), 100, 7, "doc_id")


@query("systematic_sample", "SELECT doc_id FROM documents WHERE doc_id % greatest(1, (SELECT count(*) FROM documents) // 100) = 0")
def systematic_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return rows.filter(F.col("doc_id") % max(1, rows.count() // 100) == 0)


@query("train_val_split", "SELECT CASE WHEN p < floor((SELECT count(*) FROM documents) * 0.05) THEN 'val' ELSE 'train' END AS split, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS p FROM documents)")
def train_val_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return mixture.split_train_validation(mixture.numbered(rows, corpora.cells_for(rows), 3, "doc_id"), rows.count(), 0.05).select("split", "doc_id")


@query("plan_items")
def plan_items(spark, sf_dir):
    u = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "id"), 11) / float(1 << 53)
    kind = mixture.weighted_choice(u(1), {"explain": 0.4, "code": 0.35, "qa": 0.25})
    hard = F.when(F.col("id") < 400, "easy").when(F.col("id") < 800, "medium").otherwise("hard")
    return spark.range(1000).select(F.format_string("item-%06d", "id").alias("id_text"), kind.alias("task_type"), hard.alias("difficulty"))


# Samples


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "response")


RESPONSE = strip_sql("text")
RW = f"list_filter(regexp_split_to_array(r, {q(WS + '+')}), lambda w: w <> '')"
GRAMS = f"list_transform(range(1, len({RW}) - 2), lambda i: array_to_string(({RW})[i:i + 3], ' '))"


@query("sample_quality", f"""
    SELECT conv_id, turn, CASE WHEN length(r) < 30 THEN 'too_short' WHEN length(r) > 8000 THEN 'too_long'
        WHEN r = '' OR regexp_matches(r, {q(lex.DANGLING)}) OR {n_of('```', 'r')} % 2 = 1 OR {n_of('[{]', 'r')} <> {n_of('[}]', 'r')} OR {n_of('[(]', 'r')} <> {n_of('[)]', 'r')} THEN 'incomplete'
        WHEN length(r) > 120 AND (len({RW}) < 4 OR len(list_distinct({GRAMS})) / len({GRAMS}) < 0.35) THEN 'repeated_reasoning'
        WHEN regexp_matches(r, {q(lex.LEAKED_FORMAT)}) THEN 'hallucinated_formatting'
        WHEN regexp_matches(r, '^[{{\\[]') AND NOT json_valid(r) THEN 'broken_json' ELSE 'keep' END AS rule
    FROM (SELECT conv_id, turn, {RESPONSE} AS r FROM conversations)""")
def sample_quality(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.coalesce(samples.sample_quality(F.col("response"), F.lit("chat")), F.lit("keep")).alias("rule"))


@query("sample_toxicity", f"SELECT doc_id, least(1.0, ({n_of(lex.HARMFUL[0])} + {n_of(lex.HARMFUL[1])}) / 5) > 0.5 AS toxic FROM documents")
def sample_toxicity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (samples.toxicity_score(F.col("text")) > 0.5).alias("toxic"))


KEY = f"lower(substr(coalesce((list_filter(regexp_split_to_array(b, {q(WS + '+')}), lambda w: w <> ''))[1], ''), 1, 12))"
SCORED = f"CASE WHEN length(a) = 0 THEN 0 ELSE greatest(0, least(1, CASE WHEN regexp_matches(a, {q(lex.STEP_MARK)}) THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(a, {q(lex.CONNECTIVE)}) THEN 0.15 ELSE 0 END + CASE WHEN length(a) BETWEEN 80 AND 6000 THEN 0.25 WHEN length(a) BETWEEN 30 AND 79 THEN 0.1 ELSE 0 END + CASE WHEN k = '' THEN 0 WHEN contains(lower(a), k) THEN 0.25 WHEN contains(lower(a), substr(k, 1, 6)) THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(a, {q(lex.CONTRADICTION)}) THEN 0.2 ELSE 0 END)) END"
TURNS = f"(SELECT conv_id, turn, a, b, {KEY} AS k FROM (SELECT p.conv_id, p.turn, {strip_sql('p.text')} AS a, n.text AS b FROM conversations p JOIN conversations n ON n.conv_id = p.conv_id AND n.turn = p.turn + 1))"


def _turns(spark, sf_dir):
    """Each turn as the reasoning, the one after it as the response."""
    c = table(spark, sf_dir, "conversations")
    return c.alias("p").join(c.alias("n"), (F.col("p.conv_id") == F.col("n.conv_id")) & (F.col("n.turn") == F.col("p.turn") + 1)).select("p.conv_id", "p.turn", F.col("p.text").alias("reasoning"), F.col("n.text").alias("response"))


@query("reasoning_score", f"SELECT conv_id, turn, CAST(round({SCORED}, 6) AS DOUBLE) AS score FROM {TURNS}")
def reasoning_score(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(samples.reasoning_score(F.col("reasoning"), F.col("response")), 6).alias("score"))


@query("composite_quality", f"SELECT doc_id, round(least(1, greatest(0, least(1.0, length({strip_sql('text')}) / 250.0) * 0.85 + 0.1 + CASE WHEN length({strip_sql('text')}) BETWEEN 40 AND 4000 THEN 0.05 ELSE 0 END)), 3) AS score FROM documents")
def composite_quality(spark, sf_dir):
    score = samples.composite_quality(F.lit(None).cast("string"), F.col("text"), F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 3).alias("score"))


@query("artifact_strip")
def artifact_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize.without_artifacts(F.col("text")).alias("text"))


@query("heuristic_quality", f"""
    SELECT doc_id, n AS n_words, round(f, 6) AS max_word_freq, CASE WHEN x OR n < 30 THEN 'REJECT' WHEN f > 0.06 AND n > 100 THEN 'REVIEW' ELSE 'KEEP' END AS verdict,
           round(least(1, greatest(0, 0.5 + least(0.25, n / 4000) + CASE WHEN x OR n < 30 OR (f > 0.06 AND n > 100) THEN 0 ELSE 0.1 END - CASE WHEN x THEN 0.3 ELSE 0 END - CASE WHEN n < 30 THEN 0.2 ELSE 0 END - CASE WHEN f > 0.06 AND n > 100 THEN 0.15 ELSE 0 END)), 6) AS score
    FROM (SELECT doc_id, CAST({N} AS BIGINT) AS n, {mode_sql("ws")} / greatest(1, len(ws)) AS f, len(list_filter([{', '.join(map(q, lex.TEACHER_PHRASES))}], lambda p: contains(lower(text), p))) > 0 AS x
          FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+') AS ws FROM documents))""")  # fmt: skip
def heuristic_quality(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", samples.heuristic_quality(F.col("text")).alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.round("max_word_freq", 6).alias("max_word_freq"), "verdict", F.round("score", 6).alias("score"))


@query("chat_flatten", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def chat_flatten(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


# Tokens: a word's id is the start of its MD5

IDS = f"list_transform({W}, lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS BIGINT))"


def _ids(spark, sf_dir, *more):
    return docs(spark, sf_dir).select("seq", *more, tokens.word_ids(F.col("text")).alias("ids"))


@query("token_chunks", f"""
    WITH s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS p, t FROM (SELECT doc_id, unnest({IDS}) AS t, generate_subscripts({IDS}, 1) AS i FROM documents)),
    l AS (SELECT p, t, lead(t) OVER (ORDER BY p) AS nx FROM s)
    SELECT chunk, md5(string_agg(CAST(t AS VARCHAR), ',' ORDER BY p)) AS ids, md5(string_agg(CAST(nx AS VARCHAR), ',' ORDER BY p)) AS labels
    FROM (SELECT *, CAST(p // 128 AS BIGINT) AS chunk FROM l) WHERE chunk < (SELECT (count(*) - 1) // 128 FROM s) GROUP BY chunk""")
def token_chunks(spark, sf_dir):
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return tokens.chunks(_ids(spark, sf_dir), 128).select("chunk", digest("ids"), digest("labels"))


@query("truncate_tokens", f"SELECT doc_id, ({IDS})[1:64] AS ids FROM documents")
def truncate_tokens(spark, sf_dir):
    return _ids(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.slice("ids", 1, 64).alias("ids"))


#: Documents of a shard, which is packed in order by one task.
SHARD = 200


@query("pack_next_fit", f"""
    WITH RECURSIVE r AS (SELECT doc_id // {SHARD} AS scope, doc_id AS seq, {N} AS n, row_number() OVER (PARTITION BY doc_id // {SHARD} ORDER BY doc_id) AS i FROM documents WHERE {N} <= 1024),
    a AS (SELECT scope, seq, i, 0 AS pack, 0 AS segment, CAST(0 AS BIGINT) AS start, n AS filled FROM r WHERE i = 1
          UNION ALL SELECT r.scope, r.seq, r.i, CASE WHEN a.filled + r.n > 1024 THEN a.pack + 1 ELSE a.pack END, CASE WHEN a.filled + r.n > 1024 THEN 0 ELSE a.segment + 1 END,
                 CASE WHEN a.filled + r.n > 1024 THEN 0 ELSE a.filled END, CASE WHEN a.filled + r.n > 1024 THEN r.n ELSE a.filled + r.n END
          FROM a JOIN r ON r.scope = a.scope AND r.i = a.i + 1)
    SELECT CAST(scope AS BIGINT) AS scope, seq, CAST(pack AS BIGINT) AS pack, CAST(segment AS BIGINT) AS segment, CAST(start AS BIGINT) AS start FROM a""")
def pack_next_fit(spark, sf_dir):
    ids = _ids(spark, sf_dir).select("seq", F.floor(F.col("seq") / SHARD).alias("shard"), F.size("ids").alias("n"))
    return tokens.next_fit(ids, 1024, "shard")


@query("pack_sequences")
def pack_sequences(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    lengths = ids.select("seq", F.floor(F.col("seq") / SHARD).alias("shard"), F.size("ids").alias("n"))
    return tokens.packed(ids, tokens.next_fit(lengths, 1024, "shard"))


@query("collate_pad", f"""
    WITH t AS (SELECT doc_id, {IDS} AS ids, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents),
    b AS (SELECT *, r // 8 AS batch, least(64, max(len(ids)) OVER (PARTITION BY r // 8)) AS w FROM t)
    SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(w AS BIGINT) AS width, CAST(least(len(ids), w) AS BIGINT) AS n_real, CAST(coalesce(list_sum(ids[1:w]), 0) AS BIGINT) AS total FROM b""")
def collate_pad(spark, sf_dir):
    c = tokens.collate(_ids(spark, sf_dir), 8, 64)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    return c.select(F.col("seq").alias("doc_id"), "batch", F.size("input_ids").cast("bigint").alias("width"), total("mask").alias("n_real"), total("input_ids").alias("total"))


# Evaluation and experiment series


def _series(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("step"), "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@query("loss_spike", "SELECT event_id AS step, value > 2.0 * avg(value) OVER w AND count(*) OVER w = 100 AS spike FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 99 PRECEDING)")
def loss_spike(spark, sf_dir):
    return evaluation.loss_spikes(_series(spark, sf_dir)).select("step", "spike")


@query("early_stop", """
    WITH b AS (SELECT event_type, event_id, coalesce(value < min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM events),
    r AS (SELECT *, count(*) FILTER (better) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM b)
    SELECT event_id AS step, row_number() OVER (PARTITION BY event_type, run ORDER BY event_id) - 1 AS bad, row_number() OVER (PARTITION BY event_type, run ORDER BY event_id) - 1 >= 5 AS stop FROM r""")
def early_stop(spark, sf_dir):
    return evaluation.early_stopping(_series(spark, sf_dir), 5).select("step", F.col("bad").cast("bigint").alias("bad"), "stop")


@query("rolling_rate", "SELECT event_id AS step, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def rolling_rate(spark, sf_dir):
    return evaluation.rolling_count(_series(spark, sf_dir), 60).select("step", "n_recent")


@query("stall_lag", "SELECT event_id AS step, round(coalesce((value - lag(value) OVER w) / greatest(epoch(ts) - epoch(lag(ts) OVER w), 1), 0), 6) AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def stall_lag(spark, sf_dir):
    return evaluation.growth(_series(spark, sf_dir)).select("step", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"))


@query("mc_accuracy", """
    WITH c AS (SELECT vec_id, i - 1 AS choice, CAST(abs(embedding[i]) AS DOUBLE) AS loss, label % 4 AS label FROM embeddings, range(1, 5) r(i)),
    b AS (SELECT vec_id, min(label) AS label, arg_min(choice, loss) AS best, max(CASE WHEN choice = label THEN loss END) AS gold FROM c GROUP BY vec_id)
    SELECT round(avg(CASE WHEN best = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(gold), 6) AS mean_loss, round(exp(least(avg(gold), 20)), 6) AS perplexity FROM b""")
def mc_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example"), F.posexplode(F.slice("embedding", 1, 4)).alias("choice", "x"), (F.col("label") % 4).alias("label"))
    out = evaluation.multiple_choice(e.select("example", "choice", F.abs("x").cast("double").alias("loss"), "label"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


CONFIDENT = "SELECT vec_id, least(1, abs(CAST(embedding[1] AS DOUBLE))) AS confidence, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END AS correct FROM embeddings"
BINS = f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY confidence, vec_id) - 1 AS p FROM ({CONFIDENT})),
    b AS (SELECT least(p // (SELECT greatest(1, count(*) // 20) FROM r), 19) AS bin, count(*) AS n, avg(confidence) AS confidence, avg(correct) AS accuracy FROM r GROUP BY 1)
"""


def _bins(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.least(F.lit(1.0), F.abs(F.element_at("embedding", 1).cast("double"))).alias("confidence"), (F.col("label") % 2 == 0).cast("int").alias("correct"))
    return evaluation.calibration_bins(e)


@query("ece_bins", BINS + "SELECT CAST(bin AS BIGINT) AS bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def ece_bins(spark, sf_dir):
    return _bins(spark, sf_dir).select(F.col("bin").cast("bigint").alias("bin"), "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("ece", BINS + "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return evaluation.calibration_error(_bins(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@query("weighted_ppl", "SELECT round(sum(value * n) / sum(n), 4) AS mean_loss, round(exp(least(sum(value * n) / sum(n), 20)), 2) AS perplexity FROM (SELECT value / 1000 AS value, user_id % 7 + 1 AS n FROM events)")
def weighted_ppl(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("loss"), (F.col("user_id") % 7 + 1).alias("n"))
    return evaluation.weighted_perplexity(e).select(F.round("mean_loss", 4).alias("mean_loss"), F.round("perplexity", 2).alias("perplexity"))


RESULTS = "SELECT event_type AS benchmark, 'accuracy' AS metric, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS label, avg(value) AS value FROM events GROUP BY ALL"


def _results(spark, sf_dir):
    label = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("label")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("benchmark"), F.lit("accuracy").alias("metric"), label).agg(F.avg("value").alias("value"))


@query("compare_pivot", f"SELECT benchmark, metric, round(max(value) FILTER (label = 'a'), 6) AS a, round(max(value) FILTER (label = 'b'), 6) AS b FROM ({RESULTS}) GROUP BY ALL")
def compare_pivot(spark, sf_dir):
    return evaluation.comparison(_results(spark, sf_dir), ["a", "b"]).select("benchmark", "metric", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("compare_improvement", f"WITH r AS ({RESULTS}) SELECT x.benchmark, round(100 * (y.value - x.value) / abs(x.value), 4) AS improvement FROM r x JOIN r y ON x.benchmark = y.benchmark AND x.label = 'a' AND y.label = 'b'")
def compare_improvement(spark, sf_dir):
    return evaluation.improvement(_results(spark, sf_dir), "a", "b").select("benchmark", F.round("improvement", 4).alias("improvement"))


@query("leaderboard", f"SELECT name, row_number() OVER (ORDER BY value DESC, name) AS rank FROM (SELECT benchmark || '/' || label AS name, value FROM ({RESULTS}))")
def leaderboard(spark, sf_dir):
    board = _results(spark, sf_dir).select(F.concat_ws("/", "benchmark", "label").alias("name"), F.col("value").cast("string").alias("score"))
    return evaluation.leaderboard(board, "score").select("name", F.col("rank").cast("bigint").alias("rank"))


# Records, generators, scoring


@query("first_by_id", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_by_id(spark, sf_dir):
    return documents.first_by_id(table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("seq")), "user_id").select("user_id", "event_id")


@query("last_by_id", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_by_id(spark, sf_dir):
    return documents.last_by_id(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("seq")), "user_id").select("user_id", "event_id", "event_type")


@query("license_quota", "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def license_quota(spark, sf_dir):
    return dedup.quota(documents.licensed(docs(spark, sf_dir), "lang", ["en", "de"]), 5, "source").select(F.col("seq").alias("doc_id"), "source")


@query("cap_raw_then_filter", "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) WHERE length(text) >= 50")
def cap_raw(spark, sf_dir):
    from ..sources import readers

    return readers.capped(docs(spark, sf_dir), 100, F.length("text") >= 50, cap_raw=True).select(F.col("seq").alias("doc_id"))


@query("cap_kept_rows", "SELECT doc_id FROM documents WHERE length(text) >= 50 ORDER BY doc_id LIMIT 100")
def cap_kept(spark, sf_dir):
    from ..sources import readers

    return readers.capped(docs(spark, sf_dir), 100, F.length("text") >= 50).select(F.col("seq").alias("doc_id"))


@query("code_quality", "SELECT doc_id, CASE WHEN length(" + strip_sql("text") + ") < 50 THEN 'too_short' WHEN list_avg(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 200 THEN 'minified' WHEN regexp_matches(lower(text), 'auto-generated|autogenerated|do not edit|generated by') THEN 'generated' ELSE 'keep' END AS rule FROM documents")
def code_quality(spark, sf_dir):
    return filters.measured(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(filters.code_quality(), F.lit("keep")).alias("rule"))


@query("split_documents")
def split_documents(spark, sf_dir):
    return documents.split_documents(docs(spark, sf_dir), 2000)


@query("math_samples")
def math_samples(spark, sf_dir):
    return generate.math_samples(spark, 500)


@query("catalog_flatten", "SELECT printf('seed-%05d', row_number() OVER (ORDER BY i) - 1) AS id, domain, subdomain, concept FROM (VALUES (0, 'a', 'x', 'p'), (1, 'a', 'x', 'q'), (2, 'a', 'y', 'r'), (3, 'b', 'z', 's')) t(i, domain, subdomain, concept)")
def catalog_flatten(spark, sf_dir):
    return generate.flat_catalog(spark, {"a": {"x": ["p", "q"], "y": ["r"]}, "b": {"z": ["s"]}})


@query("gold_scoring", "SELECT doc_id, CASE WHEN contains(text, 'the') AND contains(text, 'of') THEN 1.0 ELSE 0.0 END AS substr, CASE WHEN contains(text, 'der') OR contains(text, 'que') THEN 1.0 ELSE 0.0 END AS any_substr FROM documents")
def gold_scoring(spark, sf_dir):
    lit = lambda *g: F.array(*[F.lit(x) for x in g])
    return table(spark, sf_dir, "documents").select("doc_id", samples.gold_score(F.lit("substr"), F.col("text"), lit("the", "of")).alias("substr"), samples.gold_score(F.lit("any_substr"), F.col("text"), lit("der", "que")).alias("any_substr"))


@query("tail_split", "SELECT doc_id, CASE WHEN p >= floor((SELECT count(*) FROM documents) * (1 - 0.05)) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)")
def tail_split(spark, sf_dir):
    placed = tokens.offsets(docs(spark, sf_dir).select("seq", F.lit(1).alias("one")), "one").withColumnRenamed("start", "pos")
    return documents.tail_split(placed, 0.05).select(F.col("seq").alias("doc_id"), "split")


def names() -> list[str]:
    return list(QUERIES)


from . import branches, records, streams  # noqa: E402, F401, I001 - add their queries, records before streams

