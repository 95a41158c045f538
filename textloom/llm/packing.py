"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import base64
import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, pick, raw_bytes

END = 0
#: Beyond these code points (and in the rarer controls) libraries may differ in their Unicode tables.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")
#: White space in a row, at which the ranks' pattern grows slow and, far beyond, runs out of stack.
LONG_RUN = 500
SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"


def has_long_run(text: str) -> bool:
    """True if ``LONG_RUN`` characters of white space follow each other: then they fill a block of half that length."""
    half = LONG_RUN // 2
    return any(text[i : i + half].isspace() for i in range(0, len(text) - half + 1, half))


class Encoder:
    """Token ids as ``tokenizers`` gives them for the tokenizer file, without added special tokens.

    The file is what decides. Its vocabulary is also on hand as ranks, which
    give the same ids several times faster; they are used for texts of common
    characters only (the tests hold both against each other over a whole
    table). All others, texts with long runs of white space and whatever the
    ranks fail on go to the file itself.
    """

    def __init__(self, tokenizer_file: str | None = None, ranks_file: str | None = None):
        import public_tokenizers as public
        import tiktoken

        self.tokenizer_file, self.loaded = tokenizer_file or public.path("byte_bpe_50k.json"), None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file or public.path("byte_bpe_50k.tiktoken"), "rb"))}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    @property
    def full(self):
        """The tokenizer file, read where a text needs it."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.tokenizer_file)
        return self.loaded

    def _by_file(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _by_ranks(self, text: str) -> np.ndarray | None:
        if UNUSUAL.search(text) or "<|" in text or has_long_run(text):
            return None
        try:
            return self.fast.encode_to_numpy(text)
        except ValueError:  # the pattern's engine gave up
            return None

    def __call__(self, text: str) -> np.ndarray:
        """The ids, and then the id that ends a document."""
        ids = self._by_ranks(text)
        return np.append(self._by_file(text) if ids is None else ids, END).astype("<u4", copy=False)


class Windows:
    """A fixed number of open windows; the only state of a partition.

    Pieces go where the least space is left (best fit). When a piece fits
    nowhere and all windows are open, the fullest is emitted. A document
    longer than a window must be cut anyway: its head fills the fullest
    window to the brim.
    """

    def __init__(self, length: int, most_open: int, least_head: int, emit):
        self.length, self.most_open, self.least_head, self.emit = length, most_open, least_head, emit
        self.space: list[tuple[int, int]] = []  # (space left, window), sorted
        self.windows: dict[int, list] = {}
        self.made = 0

    def _close(self, window: int, leftover: bool = False) -> None:
        self.emit(self.windows.pop(window), leftover)

    def _put(self, at: int, piece: tuple) -> None:
        space, window = self.space.pop(at)
        self.windows[window].append(piece)
        space -= len(piece[2])
        if space:
            bisect.insort(self.space, (space, window))
        else:
            self._close(window)

    def place(self, piece: tuple) -> None:
        n = len(piece[2])
        at = bisect.bisect_left(self.space, (n, -1))
        if at == len(self.space):
            if len(self.space) >= self.most_open:
                self._close(self.space.pop(0)[1])
            self.made += 1
            self.windows[self.made] = []
            at = bisect.bisect_left(self.space, (self.length, self.made))
            self.space.insert(at, (self.length, self.made))
        self._put(at, piece)

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        if n > self.length and self.space and self.space[0][0] >= self.least_head:
            start = self.space[0][0]
            self._put(0, (doc_id, 0, ids[:start], n))
        while n - start >= self.length:
            self.emit([(doc_id, start, ids[start : start + self.length], n)], False)
            start += self.length
        if start < n:
            self.place((doc_id, start, ids[start:], n))

    def finish(self) -> None:
        for _, window in self.space:
            self._close(window, True)


class Out:
    """Pieces of sequences, gathered into Arrow batches."""

    def __init__(self, first_id: int, with_ids: bool):
        self.next_id, self.with_ids, self.rows = first_id, with_ids, []

    def emit(self, pieces: list, leftover: bool) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            data = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), data if self.with_ids or leftover else None, zlib.crc32(data), n, self.next_id, offset, leftover))
            offset += len(ids)
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*self.rows)) or [()] * len(kinds)
        self.rows = []
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def rows_of(batch: pa.RecordBatch, step: int = 500):
    """(doc_id, text as bytes), a few hundred rows out of the batch at a time."""
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield from zip(part.column(0).to_pylist(), raw_bytes(part.column(1)))


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    length: int = 1024,
    most_open: int = 64,
    least_head: int = 16,
    fan_in: int = 16,
    with_ids: bool = True,
    tokenizer_file: str | None = None,
    ranks_file: str | None = None,
) -> DataFrame:
    """Pieces of documents, packed into sequences of at most ``length`` tokens.

    Each partition is packed as it streams by, with ``most_open`` open windows
    as its state. The windows that are still open at its end are leftovers:
    they come together for ``fan_in`` partitions at a time (at most ``fan_in``
    times ``most_open`` windows, whatever the input) and are merged with cuts,
    so that one sequence of each such group may be short.

    A row is a piece: doc_id, start, length, ids (little-endian unsigned
    32-bit; null unless ``with_ids`` asks for them), ids_crc32, doc_tokens,
    sequence_id, offset. Null and empty texts are documents of the end token
    alone. Ids may be null or repeat; each row is a document of its own. An
    empty table gives no rows.
    """

    def pack(batches):
        from pyspark import TaskContext

        encoder = Encoder(tokenizer_file, ranks_file)
        out = Out(TaskContext.get().partitionId() << 36, with_ids)
        windows = Windows(length, most_open, least_head, out.emit)
        for batch in batches:
            for doc_id, text in rows_of(batch):
                windows.add(doc_id, encoder((text or b"").decode("utf-8", "replace")))
                if len(out.rows) >= 2_000:
                    yield out.batch()
        windows.finish()
        yield out.batch()

    def merge(batches):
        """Whole groups lie together, sorted by group: their pieces fill one sequence after another."""
        group, out, pieces, filled = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != group:
                    if pieces:
                        out.emit(pieces, False)
                        yield out.batch()
                    group, pieces, filled = row["part"], [], 0
                    out = Out((1 << 62) | (group << 36), with_ids)
                ids, start = np.frombuffer(row["ids"], dtype="<u4"), row["start"]
                while len(ids):
                    head = ids[: length - filled]
                    pieces.append((row["doc_id"], start, head, row["doc_tokens"]))
                    filled, start, ids = filled + len(head), start + len(head), ids[len(head) :]
                    if filled == length:
                        out.emit(pieces, False)
                        pieces, filled = [], 0
                        if len(out.rows) >= 10_000:
                            yield out.batch()
        if pieces:
            out.emit(pieces, False)
        if out:
            yield out.batch()

    scratch = Scratch(spark)
    pieces = scratch.keep(pick(docs, doc_id="long", text="string").mapInArrow(lean(pack), SCHEMA))
    rest = pieces.filter("leftover").withColumn("part", F.shiftright("sequence_id", 36) / F.lit(fan_in))
    rest = rest.withColumn("part", F.floor("part").cast("long")).repartition("part").sortWithinPartitions("part", "sequence_id", "offset")
    merged = rest.mapInArrow(merge, SCHEMA)
    return pieces.filter("not leftover").unionByName(merged).drop("leftover")
