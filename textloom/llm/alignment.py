"""Groups and links of the tokens that two tokenizers make of the same bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, pick, raw_bytes
from .packing import Encoder, rows_of

#: Labels of a byte: no token ends at it, one of A does, one of B, one of each.
NONE, END_A, END_B, BOTH = range(4)
#: A span ends at the first label for both.
SPAN = re.compile(rb"[^\x03]*\x03")
#: Bytes of text that are worked on together. A longer text is a unit of its own.
UNIT_BYTES = 8 << 20
SCHEMA = (
    "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places array<int>, times array<int>, pairs array<long>, totals array<long>"
)


class PlainEncoder(Encoder):
    """Special tokens' strings inside a text are plain text."""

    @property
    def full(self):
        tokenizer = super().full
        tokenizer.encode_special_tokens = True
        return tokenizer

    def __call__(self, text: str) -> np.ndarray:
        ids = self._by_ranks(text)
        return self._by_file(text) if ids is None else ids


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpanCounts(dict):
    """span -> tokens of A and of B in it; remembers short spans, of which there are few kinds."""

    def __missing__(self, span: bytes) -> int:
        both = span.count(BOTH)
        value = (span.count(END_A) + both) << 32 | (span.count(END_B) + both)
        if len(span) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[span] = value
        return value


class Tokenizers:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, file_a: str | None = None, ranks_a: str | None = None, file_b: str | None = None):
        import public_tokenizers as public
        import sentencepiece

        self.a = PlainEncoder(file_a, ranks_a)
        at = byte_level()
        entries = self.a.full.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(at[c] for c in entry) if all(c in at for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b or public.path("piece_bpe_32k.model"))
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())
        ]

    def encode(self, text: bytes | None):
        """(ids of A, ids of B), or None for a text that has no tokens."""
        if not text:
            return None
        try:
            plain = text.decode()
        except UnicodeDecodeError:  # neither tokenizer gives these bytes back
            return None
        a, b, whole = self.a(" " + plain), self.b.encode(plain, num_threads=1), b" " + text
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return a, np.array(b, dtype=np.int64)


class Aligner:
    """Works on units of texts, with arrays for all their tokens together."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.counts = tokenizers, SpanCounts()
        self.size_b = len(tokenizers.bytes_b)
        self.length_a = np.array([len(x) for x in tokenizers.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in tokenizers.bytes_b], dtype=np.int64)
        ends = [(len(tokenizers.bytes_a), b",", b"|"), (self.size_b, b",", b";")]
        self.written = np.array([b"%d%s" % (i, end) for n, *both in ends for i in range(n) for end in both], dtype=object)

    def spans(self, labels: np.ndarray, ends: np.ndarray):
        """The tokens of A and of B in each group, by scanning each text's labels, and the number of each text's groups."""
        found, n_groups, start = [], [], 0
        for end in ends.tolist():
            spans = SPAN.findall(labels[start:end].tobytes())
            found.append(np.fromiter(map(self.counts.__getitem__, spans), dtype=np.int64, count=len(spans)))
            n_groups.append(len(spans))
            start = end
        packed = np.concatenate(found) if found else np.empty(0, np.int64)
        return packed >> 32, packed & 0xFFFFFFFF, np.array(n_groups, dtype=np.int64)

    def digests(self, a, b, in_a, in_b, n_tokens) -> list[str]:
        """Of each text, the SHA-256 of its groups as they are written."""
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        ends_a, ends_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        ends_a[last_a - 1] = ends_b[last_b - 1] = 1
        codes[np.arange(len(a)) + np.repeat(last_b - in_b, in_a)] = 2 * a + ends_a
        codes[np.arange(len(b)) + np.repeat(last_a, in_b)] = 2 * (len(self.length_a) + b) + ends_b
        out, start = [], 0
        for end in np.cumsum(n_tokens).tolist():
            out.append(hashlib.sha256(b"".join(self.written[codes[start:end]].tolist())[:-1]).hexdigest())
            start = end
        return out

    def unit(self, number: int, rows: list) -> pa.RecordBatch:
        """A row for each (doc_id, text), and one with the unit's distinct pairs and their links."""
        encoded = [self.tokenizers.encode(text) for _, text in rows]
        has = np.array([e is not None for e in encoded], dtype=bool)
        some = [e for e in encoded if e is not None]
        n_a, n_b = (np.array([len(e[k]) for e in some], dtype=np.int64) for k in (0, 1))
        a, b = (np.concatenate([e[k] for e in some]).astype(np.int64) if some else np.empty(0, np.int64) for k in (0, 1))
        del encoded
        ends = np.cumsum([1 + len(rows[i][1]) for i in np.flatnonzero(has)], dtype=np.int64)
        labels = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        labels[np.cumsum(self.length_a[a]) - 1] = END_A
        labels[np.cumsum(self.length_b[b]) - 1] |= END_B
        in_a, in_b, n_groups = self.spans(labels, ends)
        digests = self.digests(a, b, in_a, in_b, n_a + n_b)
        # Between two ends next to each other lies just one token of A and one of B: each such stretch is a link.
        at = np.flatnonzero(labels)
        is_a, is_b = labels[at] & END_A, (labels[at] & END_B) >> 1
        link = a[np.cumsum(is_a, dtype=np.int64) - is_a] * self.size_b + b[np.cumsum(is_b, dtype=np.int64) - is_b]
        upto = np.searchsorted(at, ends)
        n_links = np.diff(upto, prepend=0)
        kinds = len(self.length_a) * self.size_b
        keys, times = np.unique(np.repeat(np.arange(len(some)), n_links) * kinds + link, return_counts=True)
        pairs, places = np.unique(keys % kinds, return_inverse=True)
        totals = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(totals, places, times)
        n_keys = np.zeros(len(rows), dtype=np.int64)
        n_keys[has] = np.bincount(keys // kinds, minlength=len(some))

        def column(values):
            out = np.zeros(len(rows) + 1, dtype=np.int64)
            out[:-1][has] = values
            return pa.array(out, pa.int64(), mask=np.arange(len(out)) == len(rows))

        def lists(values, lengths, kind, first):
            offsets = np.concatenate([np.zeros(first + 1, np.int64), np.cumsum(lengths)])
            offsets = np.concatenate([offsets, np.repeat(offsets[-1], len(rows) + 2 - len(offsets))])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

        written = iter(digests)
        return pa.record_batch(
            [
                pa.array(np.full(len(rows) + 1, number), pa.int64()), pa.array([i for i, _ in rows] + [None], pa.int64()), column(n_a), column(n_b), column(n_groups), column(n_links),
                pa.array([next(written) if h else "" for h in has] + [None], pa.string()), lists(places, n_keys, pa.int32(), 0), lists(times, n_keys, pa.int32(), 0),
                lists(pairs, [len(pairs)], pa.int64(), len(rows)), lists(totals, [len(pairs)], pa.int64(), len(rows)),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )


def align_tokenizers(spark: SparkSession, docs: DataFrame, file_a: str | None = None, ranks_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    Both tokenizers encode the same bytes: a space and the text. Each byte gets a label (no
    token ends here, one of A, of B, of both); a regular expression scans for spans up to
    each label for both, and the labels in a span count the tokens of its group.

    Links (pairs of tokens whose bytes overlap) are counted in units of up to ``UNIT_BYTES`` of text. A unit
    lists its distinct pairs once, and its documents refer to that list by place. Lists meet the
    counts of all the corpus by pair, where a pair has a row for each unit at
    most, and go back to their unit's documents. The one broadcast has a row for each id of
    B at most, whatever the size of the corpus.

    Null and empty texts, and those that a tokenizer doesn't give back (such as one with U+2581), have zeros and ''. Ids
    may be null or repeat; each row is a document of its own, repeated rows count as often as they come. A very
    long text is a unit. An empty table gives no rows.
    """

    def encode(batches):
        from pyspark import TaskContext

        aligner = Aligner(Tokenizers(file_a, ranks_a, file_b))
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in rows_of(batch):
                if rows and size + len(row[1] or b"") > UNIT_BYTES:
                    yield aligner.unit(number, rows)
                    number, rows, size = number + 1, [], 0
                rows.append(row)
                size += len(row[1] or b"")
        if rows:
            yield aligner.unit(number, rows)

    scratch = Scratch(spark)
    made = scratch.keep(pick(docs, doc_id="long", text="string").mapInArrow(lean(encode), SCHEMA))
    listed = made.filter("groups_sha256 IS NULL").select("unit", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "x"))
    listed = scratch.keep(listed.select("unit", "place", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("total")))
    counts = scratch.keep(listed.groupBy("pair").agg(F.sum("total").alias("count")))
    id_b = F.col("pair") % F.lit(size_of_b(file_b))
    tops = counts.groupBy(id_b.alias("id_b")).agg(F.max("count").alias("top"))
    known = counts.withColumn("id_b", id_b).join(F.broadcast(tops), "id_b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    known = listed.select("unit", "place", "pair").join(known.hint("merge"), "pair").select("unit", "place", "count", "best")

    def add_up(documents: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        count, best = (np.zeros(len(place), dtype=np.int64) for _ in range(2))
        count[place] = known.column("count").to_numpy()
        best[place] = known.column("best").to_numpy(zero_copy_only=False)
        places, times = (documents.column(c).combine_chunks() for c in ("places", "times"))
        ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def of_each(values):
            sums = np.concatenate([[0], np.cumsum(values)])
            return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

        return documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", of_each(best[at] * n)).append_column("count_sum", of_each(count[at] * n))

    documents = made.filter("groups_sha256 IS NOT NULL").drop("pairs", "totals")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(add_up, schema)


def size_of_b(file_b: str | None) -> int:
    import public_tokenizers as public
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file_b or public.path("piece_bpe_32k.model")).get_piece_size()
