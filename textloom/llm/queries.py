"""The queries of this subpackage: each applies an operator to its whole table.

A query returns the columns of its contract, derived from what the operator
gives; ``ORACLE`` has DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .line_quality import line_quality
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality_rules import quality_rules
from .quotations import link_quotations, reply_ordered
from .sharding import shard_rows
from .substring_dedup import substring_dedup
from .toxicity import toxicity

#: DuckDB's lower() folds more than A-Z.
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir)).drop("row")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark, documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message without a parent is given as its own."""
    found = reply_ordered(link_quotations(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    own = {c: F.when(F.col("parent_conv_id").isNull(), F.col(c[7:])).otherwise(F.col(c)) for c in ("parent_conv_id", "parent_turn")}
    return found.withColumns(own)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, documents(spark, sf_dir))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(spark, documents(spark, sf_dir), labels(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(spark, documents(spark, sf_dir), with_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark, documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(spark, documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(spark, documents(spark, sf_dir), labels(spark, sf_dir))
    return found.select("doc_id", "p_low_quality", "p_toxic", (~F.col("rejected")).alias("kept"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark, documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(spark, documents(spark, sf_dir))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No groups are kept together and no key decides: the shuffle is uniform, so there is no ``grown_shard``."""
    found = shard_rows(spark, documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_quotations": op4_quotations,
    "op5_mixing": op5_mixing,
    "op6_line_quality": op6_line_quality,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_alignment": op12_alignment,
    "op13_sharding": op13_sharding,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (
            SELECT doc_id, sha256({LOWERED.format("coalesce(text, '')")}) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op8_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
        ), hit AS (
            SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k) USING (k) WHERE doc_id > m
        ), gone AS (
            SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(13) AS r(j)) GROUP BY doc_id
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)
    """,
    "op2_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS k
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), link AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), edge AS (
            SELECT a, b FROM link UNION SELECT b, a FROM link
        ), reach AS (
            SELECT DISTINCT a AS doc_id, a AS other FROM edge
            UNION
            SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
        ), least AS (
            SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
               doc_id <= coalesce(m, doc_id) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
    # Lines one edit apart share a half, or one is the other with a character more: so pairs to compare come from
    # equal beginnings and ends, and each is held against the other character by character.
    "op9_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), d AS (
            SELECT line, length(line) AS n, min(doc_id * 1000000 + i) AS pos FROM l WHERE line <> '' GROUP BY line
        ), h AS (
            SELECT line, n, pos, unnest([n, n - 1]) AS m FROM d
        ), k AS (
            SELECT line, n, pos, m, 'a' || m || substr(line, 1, m // 2) AS half FROM h UNION ALL
            SELECT line, n, pos, m, 'b' || m || right(line, m - m // 2) FROM h
        ), pair AS (
            SELECT DISTINCT x.line AS a, x.n AS na, x.pos AS at_a, y.line AS b, y.n AS nb, y.pos AS at_b
            FROM k x JOIN k y ON x.half = y.half AND x.m = least(x.n, y.n) AND (x.n = y.n OR x.n + 1 = y.n) AND x.line <> y.line
        ), near AS (
            SELECT a, at_a, b, at_b FROM pair
            WHERE len(list_filter(range(0, nb), lambda p: substr(a, 1, p) = substr(b, 1, p) AND substr(a, CAST(p + 1 + CASE WHEN na = nb THEN 1 ELSE 0 END AS BIGINT)) = substr(b, CAST(p + 2 AS BIGINT)))) > 0
        ), first AS (
            SELECT line, min(pos) AS pos FROM (SELECT line, pos FROM d UNION ALL SELECT a, at_b FROM near UNION ALL SELECT b, at_a FROM near) GROUP BY line
        ), judged AS (
            SELECT l.doc_id, l.i, l.raw, l.line <> '' AS worded, coalesce(f.pos < l.doc_id * 1000000 + l.i, false) AS gone FROM l LEFT JOIN first f ON f.line = l.line AND l.line <> ''
        )
        SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op11_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ), t AS (
            SELECT i, lang, source, unnest(ts) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10
        ), v AS (
            SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
        ), c AS (
            SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT lang, source, sum(n) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(g.total, 0) + 2 * v.v)::HUGEINT AS p,
                   1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.total + 2 * v.v)::HUGEINT AS q
            FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), everything AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM everything QUALIFY part = 'pair' OR rank <= 10
    """,
    "op4_quotations": r"""
        WITH RECURSIVE line AS (
            SELECT conv_id, turn, i, l, len(regexp_replace(regexp_extract(l, '^((?:[ \t]*>)+) ?', 1), '[^>]', '', 'g')) AS level,
                   regexp_replace(l, '^((?:[ \t]*>)+) ?', '') AS body
            FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)
        ), run AS (
            SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS r
            FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE 1 END AS new FROM line)
        ), part AS (
            SELECT conv_id, turn, r, level, string_agg(body, chr(10) ORDER BY i) AS body FROM run GROUP BY conv_id, turn, r, level
        ), own AS (
            SELECT conv_id, turn, max(level) AS quote_depth,
                   regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY r) FILTER (level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own_text
            FROM part GROUP BY conv_id, turn
        ), quote AS (
            SELECT conv_id, turn, r, level, k
            FROM (SELECT *, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM part WHERE level > 0) WHERE k <> ''
        ), held AS (
            SELECT o.conv_id, o.turn, q.k
            FROM (SELECT DISTINCT k FROM quote WHERE len(string_split(k, ' ')) >= 4) q
            JOIN (SELECT conv_id, turn, trim(regexp_replace(lower(own_text), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM own) o
              ON contains(' ' || o.t || ' ', ' ' || q.k || ' ')
        ), said AS (
            SELECT conv_id, turn, k FROM held UNION
            SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(u), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
            FROM (SELECT conv_id, turn, unnest([own_text] || regexp_split_to_array(own_text, '\n[\x20\x09-\x0D]*\n') || string_split(own_text, chr(10))) AS u FROM own)
        ), found AS (
            SELECT q.conv_id, q.turn, q.r, q.level,
                   (SELECT min(s.turn) FROM said s WHERE s.k = q.k AND s.conv_id = q.conv_id AND s.turn < q.turn) AS here,
                   (SELECT min(s.conv_id) FROM said s WHERE s.k = q.k AND s.conv_id < q.conv_id) AS there, q.k
            FROM quote q
        ), origin AS (
            SELECT conv_id, turn, r, level, CASE WHEN here IS NOT NULL THEN conv_id ELSE there END AS o_conv,
                   coalesce(here, (SELECT min(s.turn) FROM said s WHERE s.k = f.k AND s.conv_id = f.there)) AS o_turn
            FROM found f WHERE here IS NOT NULL OR there IS NOT NULL
        ), linked AS (
            SELECT conv_id, turn, count(*) AS n_linked, arg_min(o_conv, level * 1000000 + r) AS o_conv, arg_min(o_turn, level * 1000000 + r) AS o_turn
            FROM origin GROUP BY conv_id, turn
        ), m AS (
            SELECT c.conv_id, c.turn, c.role, own_text, quote_depth, coalesce(n_linked, 0) AS n_linked,
                   (SELECT count(*) FROM quote q WHERE q.conv_id = c.conv_id AND q.turn = c.turn) AS n_quotes,
                   coalesce(o_conv, p.conv_id) AS parent_conv_id, coalesce(o_turn, p.turn) AS parent_turn
            FROM conversations c JOIN own USING (conv_id, turn) LEFT JOIN linked USING (conv_id, turn)
            LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
        ), up AS (
            SELECT conv_id, turn, conv_id AS thread_conv_id, turn AS thread_turn, 0 AS depth FROM m WHERE parent_conv_id IS NULL
            UNION ALL
            SELECT m.conv_id, m.turn, up.thread_conv_id, up.thread_turn, up.depth + 1
            FROM m JOIN up ON m.parent_conv_id = up.conv_id AND m.parent_turn = up.turn
        )
        SELECT conv_id, turn, role, own_text, quote_depth, n_quotes, n_linked, coalesce(parent_conv_id, conv_id) AS parent_conv_id, coalesce(parent_turn, turn) AS parent_turn, thread_conv_id, thread_turn, depth
        FROM m JOIN up USING (conv_id, turn)
    """,
}
