"""Removal of passages that an earlier document holds, by difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, hashed_words, lean, pick, raw_bytes, window_hashes

#: {0, 1, 3} is a difference cover modulo 7: for any i and j there is a d < 7 with i+d and j+d both in it.
PERIOD, COVER = 7, (0, 1, 3)
#: Words of a chunk: of what a task gathers before it sorts them; its memory is a few arrays of this length. The
#: more buckets there are, the longer chunks get, up to the larger number, so that a bucket's share of one doesn't vanish.
CHUNK_WORDS = (1_000_000, 8_000_000)
#: Documents of a chunk; their numbers in it take two bytes.
CHUNK_DOCS = 60_000
#: Bytes of text for each bucket, which is settled in memory, and for each task.
BUCKET_BYTES, TASK_BYTES = 64 << 20, 10 << 20
MOST_TASKS = 100_000
#: Rows from a chunk: entries for a bucket (hashes, and which document of the chunk holds each), or,
#: without hashes, the chunk's own row with its documents' keys and the hits found inside it.
ENTRIES = "bucket int, chunk long, hashes binary, holders binary, ids binary, keys binary, found binary"
#: Hits go back to the chunk: hashes, and which document holds each.
HITS = "chunk long, hashes binary, holders binary, keys binary"
#: Anchors: the low half of a hash whose high half decides the bucket. Two that are taken for equal cost work, not words.
ANCHOR = np.dtype("<u4")
#: Windows: two hashes; of the second, the low half decides the bucket and the high 16 bits are sent with the first.
WINDOW, SENT = np.dtype([("a", "<u8"), ("b", "<u8")]), np.dtype([("a", "<u8"), ("b", "<u2")])
#: Makes other word hashes of word hashes.
OTHER = np.uint64(0xD6E8FEB86659FD93)


def in_cover(n: int) -> np.ndarray:
    positions = np.arange(n)
    return positions[np.isin(positions % PERIOD, COVER)]


def packed(numbers: np.ndarray) -> bytes:
    """Rising two-byte numbers as differences, low bytes before high ones: nearly all of it zeros and small numbers."""
    return np.diff(numbers, prepend=np.uint16(0)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel(), dtype=np.uint16)


class Chunk:
    """(hash, document) of some documents, and what can be told from them alone."""

    def __init__(self, buckets: int, most_words: int, earlier_only: bool):
        from pyspark import TaskContext

        self.most_words, self.earlier_only = most_words, earlier_only
        self.buckets, self.number = buckets, TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.hashes, self.sizes, self.keys, self.ids, self.words = [], [], [], [], 0
        self.number += 1

    def add(self, key: int, doc_id: int, h: np.ndarray, words: int) -> None:
        self.words += words
        if len(h):
            self.hashes.append(h)
            self.sizes.append(len(h))
            self.keys.append(key)
            self.ids.append(doc_id)

    def full(self) -> bool:
        return self.words >= self.most_words or len(self.sizes) >= CHUNK_DOCS

    def flush(self) -> pa.RecordBatch:
        """Rows of ENTRIES, with one entry for each hash on behalf of all documents that hold it here.

        For anchors, all holders of a hash that several documents hold are
        hits. With ``earlier_only``, for windows, the holders with the smallest
        id are entries and those with a larger one are hits. So however many
        documents share a passage, each chunk sends one entry for it.
        """
        number, keys, ids, earlier_only = self.number, np.array(self.keys, dtype=np.int64), np.array(self.ids, dtype=np.int64), self.earlier_only
        kind = WINDOW if earlier_only else np.dtype(np.uint64)
        h = np.concatenate([np.empty(0, dtype=kind), *self.hashes])
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.uint16), self.sizes)
        self.clear()
        if earlier_only:
            order = np.lexsort((doc, ids[doc], h["b"], h["a"]))
            h, doc = h[order], doc[order]
            once = starts(h) | starts(doc)  # a document may hold a window several times
            h, doc = h[once], doc[once]
        else:
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
        new = starts(h)
        group = np.cumsum(new) - 1
        if earlier_only:
            send = ids[doc] == ids[doc[new]][group]
            hit = ~send
        else:
            send = new
            hit = (np.bincount(group) > 1)[group]
        back = (h["a"] if earlier_only else h.astype(ANCHOR))[hit]
        by_doc = np.argsort(doc[hit], kind="stable")
        rows = [(number % self.buckets, number, None, packed(doc[hit][by_doc]), None, keys.tobytes(), back[by_doc].tobytes())]
        h, doc = h[send], doc[send]
        decides = h["b"] & np.uint64(0xFFFFFFFF) if earlier_only else h >> np.uint64(32)
        bucket = (decides % np.uint64(self.buckets)).astype(np.int32)
        if earlier_only:
            sent = np.empty(len(h), dtype=SENT)
            sent["a"], sent["b"] = h["a"], h["b"] >> np.uint64(48)
        else:
            sent = h.astype(ANCHOR)
        order = np.lexsort((doc, bucket))
        sent, doc, bucket = sent[order], doc[order], bucket[order]
        edges = [*np.flatnonzero(starts(bucket)), len(bucket)]
        for a, b in zip(edges[:-1], edges[1:]):
            first_ids = ids[doc[a:b][starts(doc[a:b])]].tobytes() if earlier_only else None
            rows.append((int(bucket[a]), number, sent[a:b].tobytes(), packed(doc[a:b]), first_ids, None, None))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names_of(ENTRIES))


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def starts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


def meet(earlier_only: bool):
    """For rows sorted by bucket: a chunk's own row passes, entries of one hash are held together."""

    kind = SENT if earlier_only else ANCHOR

    def settle(rows):
        h = np.concatenate([np.frombuffer(r["hashes"], kind) for r in rows])
        docs = [unpacked(r["holders"]) for r in rows]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(d) for d in docs])
        if earlier_only:
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.cumsum(starts(d)) - 1] for r, d in zip(rows, docs)])
            order = np.lexsort((ids, h["b"], h["a"]))
            ids = ids[order]
        else:
            order = np.argsort(h, kind="stable")
        doc = np.concatenate(docs)
        h, row, doc = h[order], row[order], doc[order]
        new = starts(h)
        group = np.cumsum(new) - 1
        hit = ids > ids[new][group] if earlier_only else (np.bincount(group) > 1)[group]
        h, row, doc = (h["a"] if earlier_only else h)[hit], row[hit], doc[hit]
        order = np.lexsort((doc, row))
        h, row, doc = h[order], row[order], doc[order]
        edges = [*np.flatnonzero(starts(row)), len(row)]
        return [(rows[row[a]]["chunk"], h[a:b].tobytes(), packed(doc[a:b]), None) for a, b in zip(edges[:-1], edges[1:])]

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["hashes"] is None:
                    out.append((row["chunk"], row["found"], row["holders"], row["keys"]))
                    continue
                if rows and row["bucket"] != bucket:
                    out += settle(rows)
                    rows = []
                bucket = row["bucket"]
                rows.append(row)
            yield table(out)
        if rows:
            yield table(settle(rows))

    def table(rows):
        columns = zip(*rows) if rows else [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 3])], names=names_of(HITS))

    return run


def deal(kind):
    """For rows sorted by chunk: the hits of each document, by its key."""

    def settle(rows):
        keys = np.frombuffer(next(r["keys"] for r in rows if r["keys"] is not None), np.int64)
        h = np.concatenate([np.frombuffer(r["hashes"], kind) for r in rows])
        doc = np.concatenate([unpacked(r["holders"]) for r in rows])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        edges = [*np.flatnonzero(starts(doc)), len(doc)]
        return pa.record_batch([pa.array(keys[doc[edges[:-1]]]), pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["key", "found"])

    def run(batches):
        chunk, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["chunk"] != chunk:
                    yield settle(rows)
                    rows = []
                chunk = row["chunk"]
                rows.append(row)
        if rows:
            yield settle(rows)

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = 13, chunk_words: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text for each row of ``docs``.

    A window is ``window`` (8 or more) consecutive words of one document; words
    covered by a window that also starts in a document with a smaller id go.

    1. Anchors are runs of ``window - 6`` words at positions in the cover. Any
       two equal windows contain a pair of aligned equal anchors, so 3 of 7
       positions are enough. Anchors are spread by hash; those that several
       documents hold go back to these documents.
    2. Only windows around shared anchors are then hashed (the extension) and
       spread by hash; the smallest id of each decides. Windows are taken for
       equal by 80 bits and what decides their bucket.
    3. Each document drops the words of its hit windows.

    The numbers of buckets and tasks follow from the bytes of all texts, so that neither
    a bucket, which is settled in memory, nor a task grows with the input. Documents
    travel once, by their key, for steps 2 and 3. A passage common
    to many documents costs one entry per chunk (``CHUNK_WORDS``, unless ``chunk_words`` is given).
    Null texts have no words. Rows with a null id keep all words and take none
    from others. Rows with one id are one document's: they take nothing from
    each other. An empty table gives no rows.
    """
    span = window - PERIOD + 1
    rows = pick(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(max(1, -(-size // TASK_BYTES)), MOST_TASKS)
    buckets = max(2 * tasks, -(-size // BUCKET_BYTES)) if tasks == MOST_TASKS else 2 * tasks
    words = chunk_words or min(max(CHUNK_WORDS[0], buckets * 1_000), CHUNK_WORDS[1])
    by_key = rows.repartition(tasks, "key")

    def anchors(batches):
        table, chunk = WordHashes(), Chunk(buckets, words, False)
        for b in batches:
            for key, doc_id, text in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), raw_bytes(b.column("text"))):
                found = (text or b"").split()
                if doc_id is not None and len(found) >= window:
                    h = window_hashes(hashed_words(found, table), span)
                    chunk.add(key, doc_id, np.unique(h[in_cover(len(h))]), len(found))
                    if chunk.full():
                        yield chunk.flush()
        yield chunk.flush()

    def windows(batches):
        table, chunk = WordHashes(), Chunk(buckets, words, True)
        for b in batches:
            for key, doc_id, text, found in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), raw_bytes(b.column("text")), b.column("found").to_pylist()):
                if found is None:
                    continue
                h = hashed_words((text or b"").split(), table)
                a = window_hashes(h, span)
                at = in_cover(len(a))
                at = at[np.isin(a[at].astype(ANCHOR), np.frombuffer(found, ANCHOR))]
                near = np.zeros(len(h) + PERIOD, dtype=bool)
                for shift in range(PERIOD):
                    near[at - shift + PERIOD - 1] = True  # a window that starts before the text is cut off here
                near = near[PERIOD - 1 :][: len(h) - window + 1]
                w = np.empty(int(near.sum()), dtype=WINDOW)
                w["a"] = window_hashes(h, window)[near]
                w["b"] = window_hashes(h * OTHER, window)[near]
                chunk.add(key, doc_id, w, len(h))
                if chunk.full():
                    yield chunk.flush()
        yield chunk.flush()

    def cut(batches):
        table = WordHashes()
        for b in batches:
            out = []
            for text, found in zip(raw_bytes(b.column("text")), b.column("found").to_pylist()):
                kept = words = (text or b"").split()
                if found is not None:
                    w = window_hashes(hashed_words(words, table), window)
                    first = np.flatnonzero(np.isin(w, np.frombuffer(found, np.uint64)))
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + window, -1)
                    kept = [x for x, covered in zip(words, np.cumsum(step).tolist()) if not covered]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    def with_hits(entries: DataFrame, earlier_only: bool) -> DataFrame:
        met = entries.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet(earlier_only)), HITS)
        found = met.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(lean(deal("<u8" if earlier_only else ANCHOR)), "key long, found binary")
        return by_key.join(found.repartition(tasks, "key").dropDuplicates(["key"]).hint("merge"), "key", "left")

    shared = with_hits(rows.mapInArrow(lean(anchors), ENTRIES), False)
    earlier = with_hits(shared.mapInArrow(lean(windows), ENTRIES), True)
    return earlier.mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, kept_text binary").withColumn("kept_text", F.col("kept_text").cast("string"))
