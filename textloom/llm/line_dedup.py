"""Line deduplication up to one edit, by a deletion-neighbourhood join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, raw_bytes

#: Distinct lines that a task gathers before it sends them on.
CHUNK_LINES = 100_000
#: Lines whose texts are fetched by broadcasting where they are; beyond this number the texts are shuffled instead.
#: The driver builds the broadcast, so it is kept to a few MB.
FETCH_BY_BROADCAST = 50_000
LINES = "line binary, doc_id long, line_no int, key long, k0 long, k1 long, k2 long, k3 long"
VARIANTS = "variant long, kind int, doc_id long, line_no int, key long"
SUBSTITUTED, DELETED, WHOLE = 0, 1, 2
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def lines_of(text: bytes | None) -> list[bytes]:
    """Lines as they are compared: without white space at either end; a line without a word is b''."""
    return [x.strip() for x in (text or b"").split(b"\n")]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def half_keys(line: str) -> list[int]:
    """Of two lines with one edit between them, one half is the same in both.

    The halves are those of the shorter line. As a line may be the shorter one
    (or as long) or the longer one, it has keys for both: beginning and end
    for the length n, and beginning and end for n - 1.
    """
    n, out = len(line), []
    for m in (n, n - 1):
        h = m // 2
        out.append(signed(xxhash.xxh3_64_intdigest(f"{m}<{line[:h]}".encode("utf-8", "surrogatepass"))))
        out.append(signed(xxhash.xxh3_64_intdigest(f"{m}>{line[n - (m - h) :]}".encode("utf-8", "surrogatepass"))))
    return out


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def variants(line: str, shared: int) -> list[tuple[int, int]]:
    """(hash, kind) of the variants within the edit bound of one.

    ``shared`` tells, by one bit for each of ``half_keys``, which halves other
    lines share: the edit is in the other half, so only its characters are
    left out. All hashes come from two running sums, so a line of any length
    takes time in proportion to its length.
    """
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code)
    powers = np.ones(n + 1, dtype=np.uint64)
    np.cumprod(np.full(n, BASE), out=powers[1:])
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed(code, 1) * powers[:-1], out=sums[1:])
    out: list[tuple[int, int]] = []

    def positions(first: int, second: int, edge_first: int, edge_second: int) -> np.ndarray:
        take = np.zeros(n, dtype=bool)
        if shared >> first & 1:
            take[edge_first:] = True
        if shared >> second & 1:
            take[:edge_second] = True
        return np.flatnonzero(take)

    at = positions(0, 1, n // 2, n // 2)
    left_out = sums[at] + (sums[n] - sums[at + 1])
    out += [(h, SUBSTITUTED) for h in np.unique(mixed(left_out + mixed(at.astype(np.uint64), 2), n * 4 + 1)).view(np.int64).tolist()]
    at = positions(2, 3, (n - 1) // 2, (n - 1) // 2 + 1)
    joined = sums[at] + (sums[n] - sums[at + 1]) * INVERSE
    out += [(h, DELETED) for h in np.unique(mixed(joined, (n - 1) * 4)).view(np.int64).tolist()]
    if shared & 3:
        out.append((int(mixed(sums[n:], n * 4).view(np.int64)[0]), WHOLE))
    return out


def line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_text for each row of ``docs``.

    A line goes if an earlier one (by doc_id, then by place in the document)
    is equal or one edit away: a character put in, left out or exchanged.
    Earlier ones are judged on the input, whether they stay or not. White
    space at the ends of lines doesn't count; lines without a word stay. Texts of lines that
    stay are unchanged.

    1. Equal lines become one, the earliest, with the hashes of its halves (see
       ``half_keys``). Lines that share no half with another line have no neighbour.
    2. The others emit their variants: the line with one character left out,
       as hashed keys. Equal keys meet; each is held against the earliest line of its key
       only, however many there are, which loses nothing: lines with the
       same character exchanged are all one edit apart, and of a whole line and those that are it
       with a character more, every pair is one edit apart.
    3. The edit distance is verified on the texts.

    Null texts have no lines. Null ids come first. Rows that repeat id and text
    are one document. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    rows = pick(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))

    def distinct_lines(batches):
        def out():
            columns = [list(c) for c in zip(*((h, *at, *k) for h, (at, k) in first.items()))] or [[]] * 8
            kinds = [pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in LINES.split(", ")])

        def order(at):
            return (at[0] is not None, at[0] or 0, at[1], at[2])

        first: dict = {}
        for b in batches:
            for doc_id, text, key in zip(b.column(0).to_pylist(), raw_bytes(b.column(1)), b.column(2).to_pylist()):
                for i, line in enumerate(lines_of(text)):
                    if line:
                        h = xxhash.xxh3_128_digest(line)
                        at = (doc_id, i, key)
                        held = first.get(h)
                        if held is None:
                            first[h] = (at, half_keys(line.decode("utf-8", "replace")))
                        elif order(at) < order(held[0]):
                            first[h] = (at, held[1])
                if len(first) >= CHUNK_LINES:
                    yield out()
                    first = {}
        yield out()

    lines = rows.mapInArrow(distinct_lines, LINES)
    halves = [f"k{i}" for i in range(4)]
    lines = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "key")).alias("at"), *[F.min(k).alias(k) for k in halves])
    lines = scratch.keep(lines.select("at.*", *halves))

    keyed = lines.select("doc_id", "line_no", "key", F.posexplode(F.array(*halves)).alias("bit", "half"))
    shared = scratch.keep(keyed.groupBy("half").count().filter("count > 1").select("half"))
    near = keyed.join(shared, "half", "left_semi").groupBy("doc_id", "line_no", "key").agg(F.sum(F.expr("shiftleft(1, bit)")).cast("int").alias("shared"))
    near = scratch.keep(near)
    wanted = near.groupBy("key").agg(F.collect_list(F.struct("line_no", "shared")).alias("wanted"))
    few = near.limit(FETCH_BY_BROADCAST + 1).count() <= FETCH_BY_BROADCAST
    fetched = rows.dropDuplicates(["key"]) if not few else rows
    fetched = fetched.join(F.broadcast(wanted) if few else wanted.hint("merge"), "key")

    def texts_of(batches):
        for b in batches:
            out = []
            for doc_id, text, key, want in zip(b.column("doc_id").to_pylist(), raw_bytes(b.column("text")), b.column("key").to_pylist(), b.column("wanted").to_pylist()):
                found = lines_of(text)
                out += [(doc_id, w["line_no"], key, w["shared"], found[w["line_no"]].decode("utf-8", "replace")) for w in want]
            columns = zip(*out) if out else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()])], names=["doc_id", "line_no", "key", "shared", "line"])

    texts = scratch.keep(fetched.mapInArrow(texts_of, "doc_id long, line_no int, key long, shared int, line string").dropDuplicates(["key", "line_no"]))

    def neighbourhood(batches):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in VARIANTS.split(", ")]
        for b in batches:
            out = []
            for doc_id, line_no, key, share, line in zip(*(b.column(n).to_pylist() for n in ("doc_id", "line_no", "key", "shared", "line"))):
                out += [(h, kind, doc_id, line_no, key) for h, kind in variants(line, share)]
                if len(out) > 100_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    at = F.struct("doc_id", "line_no", "key")
    emitted = texts.mapInArrow(neighbourhood, VARIANTS)
    met = emitted.groupBy("variant").agg(F.count("*").alias("n"), *[F.min(F.when(F.col("kind") == k, at)).alias(f"first{k}") for k in (SUBSTITUTED, DELETED, WHOLE)]).filter("n > 1").drop("n")
    partner = F.when(F.col("kind") == SUBSTITUTED, F.col("first0")).when(F.col("kind") == DELETED, F.col("first2")).otherwise(F.col("first1"))
    # Spark takes what it doesn't know for as large as what it came from: variants for a line's length, texts for their compressed bytes. Both are
    # many times that, so none of these joins is left to be a broadcast that the driver builds.
    pairs = emitted.join(met.hint("merge"), "variant").select(at.alias("later"), partner.alias("earlier")).filter("earlier < later").distinct()
    pairs = scratch.keep(pairs.select(F.col("later.key").alias("key"), F.col("later.line_no").alias("line_no"), F.col("earlier.key").alias("key_b"), F.col("earlier.line_no").alias("line_no_b")))
    one = texts.select("key", "line_no", F.col("line").alias("a"))
    two = texts.select(F.col("key").alias("key_b"), F.col("line_no").alias("line_no_b"), F.col("line").alias("b"))
    verified = pairs.join(one.hint("merge"), ["key", "line_no"]).join(two.hint("merge"), ["key_b", "line_no_b"]).filter(F.levenshtein("a", "b", 1) >= 0)
    gone = scratch.keep(verified.select("key", "line_no").distinct())

    kept = lines.join(gone.hint("merge"), ["key", "line_no"], "left_anti").groupBy("key").agg(F.collect_list("line_no").alias("kept"))

    def cut(batches):
        for b in batches:
            out = []
            for text, stay in zip(raw_bytes(b.column("text")), b.column("kept").to_pylist()):
                stay, n, removed, left = set(stay or ()), 0, 0, []
                for i, line in enumerate((text or b"").split(b"\n")):
                    if line.strip():
                        n += 1
                        if i not in stay:
                            removed += 1
                            continue
                    left.append(line)
                out.append((n, removed, b"\n".join(left)))
            n, removed, texts_ = zip(*out) if out else ((), (), ())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts_, pa.binary())], names=["doc_id", "n_lines", "n_removed", "kept_text"])

    out = rows.join(kept.hint("merge"), "key", "left").mapInArrow(cut, "doc_id long, n_lines long, n_removed long, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
