"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, pick, raw_bytes
from .learning import descend, labelled_sample, logistic, sigmoid

UPPER, DIGITS, SYMBOLS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@\\^_~{}[]", b".,;:?"
OWN = 18  # features of a line by itself
WIDTH = 3 * OWN + 1  # of the line, the one before, the one after, and the bias
#: Neighbours' features are scaled down, so that a line is judged by itself first.
NEIGHBOUR = 0.15
#: A document is good if two picks of a line, by length, would all be good ones.
PICKS = 2
#: Bytes of text whose lines are featurised and scored at once.
BATCH_BYTES = 4_000_000


def own_features(line: bytes, words: list, again: bool) -> tuple:
    n, k = len(line), len(words)
    share = lambda chars: (n - len(line.translate(None, chars))) / n
    per_word = lambda chars: min(1.0, (n - len(line.translate(None, chars))) / k)
    distinct = len(set(words))
    return (
        1.0,
        math.log(n) / 5,
        math.log(k) / 4,
        min(n / k, 40) / 10,
        share(UPPER),
        share(DIGITS),
        4 * share(SYMBOLS),
        4 * share(b"!"),
        4 * share(b"|"),
        4 * share(STOPS),
        1 - distinct / k,
        (k - distinct) / 50 if k - distinct < 50 else 1.0,
        sum(map(len, words)) / k / 10 if k < 200 else (n / k - 1) / 10,
        1.0 if again else 0.0,
        # What a line of plain prose hardly has at all, by the word.
        ((k - distinct) / k) ** 3,
        per_word(SYMBOLS),
        per_word(b"!"),
        per_word(b"|"),
    )


def own_rows(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word by themselves, their lengths, and the number of them in each text."""
    blocks, rows, lengths, counts = [np.empty((0, OWN), dtype=np.float32)], [], [], []
    for text in texts:
        seen: set = set()
        before = len(lengths)
        for line in (text or b"").split(b"\n"):
            words = line.split()
            if words:
                rows.append(own_features(line, words, line in seen))
                seen.add(line)
                lengths.append(len(line))
                if len(rows) >= 20_000:  # as an array they take a fraction
                    blocks.append(np.array(rows, dtype=np.float32))
                    rows = []
        counts.append(len(lengths) - before)
    blocks.append(np.array(rows, dtype=np.float32).reshape(-1, OWN))
    return np.concatenate(blocks), np.array(lengths, dtype=np.float64), np.array(counts, dtype=np.int64)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it in its text (none: zeros), and the bias."""
    ends = np.cumsum(counts)
    x = np.zeros((len(own), WIDTH), dtype=np.float32)
    x[:, :OWN], x[:, -1] = own, 1
    if len(own):
        x[1:, OWN : 2 * OWN] = NEIGHBOUR * own[:-1]
        x[:-1, 2 * OWN : -1] = NEIGHBOUR * own[1:]
        x[(ends - counts)[counts > 0], OWN : 2 * OWN] = 0
        x[(ends - 1)[counts > 0], 2 * OWN : -1] = 0
    return x


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths, and the number of them in each text."""
    own, lengths, counts = own_rows(texts)
    return with_neighbours(own, counts), lengths, counts


class Chain:
    """Two states (bad 0, good 1): ``emit`` scores good against bad, ``move`` the four transitions."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def marginals(self, x: np.ndarray, counts: np.ndarray, pairs: bool = False, tilt: np.ndarray | float = 0.0):
        """P(good) of each line, by forward-backward over all chains at once; summed pair marginals if asked for.

        ``tilt`` is added to the lines' scores.
        """
        n = len(x)
        potential = np.ones((n, 2))
        z = np.clip(x @ self.emit, -30, 30) + tilt
        potential[:, 1] = np.exp(z)
        potential /= potential.sum(1, keepdims=True)
        a = np.exp(self.move)
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        most = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")  # chains with a line t
        forward, backward = np.empty((n, 2)), np.empty((n, 2))
        at = None
        for t in range(most):
            i = starts[: alive[t]] + t
            at = potential[i] if t == 0 else (at[: alive[t]] @ a) * potential[i]
            at /= at.sum(1, keepdims=True)
            forward[i] = at
        sums = np.zeros((2, 2))
        nxt = np.empty((0, 2))
        for t in range(most - 1, -1, -1):
            i = starts[: alive[t]] + t
            b = np.ones((alive[t], 2))
            if len(nxt):
                b[: len(nxt)] = nxt @ a.T
                b[: len(nxt)] /= b[: len(nxt)].sum(1, keepdims=True)
                if pairs:
                    joint = forward[i[: len(nxt)]][:, :, None] * a[None] * nxt[:, None, :]
                    sums += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            backward[i] = b
            nxt = b * potential[i]
        both = forward * backward
        good = both[:, 1] / both.sum(1)
        return (good, sums) if pairs else good

    def means(self, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each document's mean P(good), weighted by line length (0 without lines)."""
        return shares(lengths, counts, self.marginals(x, counts))

    @classmethod
    def gradient(cls, w: np.ndarray, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the documents' mean negative log likelihood, the line states summed out.

        P(good document) is the length-weighted mean P(good line) to the power
        of ``PICKS``. The mean's derivative is the covariance of the states with
        what the weights multiply: the difference of the expectations under
        chains whose scores are tilted a little one way and the other.
        """
        chain = cls(w[:-4], w[-4:].reshape(2, 2))
        m = np.clip(chain.means(x, lengths, counts), 1e-6, 1 - 1e-6)
        by_mean = np.where(y == 1, -PICKS / m, PICKS * m ** (PICKS - 1) / (1 - m**PICKS)) / len(y)
        total = np.bincount(np.repeat(np.arange(len(counts)), counts), lengths, len(counts))
        tilt = np.repeat(by_mean / np.maximum(total, 1), counts) * lengths
        step = 1e-4 / max(np.abs(tilt).max(initial=0), 1e-12)
        (up, pairs_up), (down, pairs_down) = (chain.marginals(x, counts, pairs=True, tilt=sign * step * tilt) for sign in (1, -1))
        return np.concatenate([x.T @ (up - down), (pairs_up - pairs_down).ravel()]) / (2 * step)

    @classmethod
    def fit(cls, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 100) -> Chain:
        """From documents' labels alone; which of a document's lines are good is hidden."""
        penalties = np.concatenate([np.full(x.shape[1], penalty), np.full(4, 10 * penalty)])
        w = descend(lambda w: cls.gradient(w, x, lengths, counts, y) + penalties * w, np.zeros(x.shape[1] + 4), steps, 0.15)
        return cls(w[:-4], w[-4:].reshape(2, 2))


def shares(lengths: np.ndarray, counts: np.ndarray, good: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(doc, lengths * good, len(counts)) / np.maximum(np.bincount(doc, lengths, len(counts)), 1)


class QualityModel:
    """The chain, and how a document's mean marginal maps to a probability.

    The mean is weighted by line length; a logistic curve in it, rising
    throughout, puts 0.5 where both labels are equally likely. A text without
    a word has no lines: its score is the share of label 1.
    """

    def __init__(self, chain: Chain | None, slope: float, offset: float, prior: float):
        self.chain, self.slope, self.offset, self.prior = chain, slope, offset, prior

    @classmethod
    def fit(cls, own: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: list) -> QualityModel:
        y = np.array(labels, dtype=np.int64)
        some = counts > 0
        if not some.any() or y[some].min() == y[some].max():
            return cls(None, 0.0, 0.0, float(y.mean()) if len(y) else 0.5)
        x = with_neighbours(own, counts).astype(np.float64)
        chain = Chain.fit(x, lengths, counts[some], y[some])
        means = chain.means(x, lengths, counts[some])
        slope, offset = logistic((means[:, None] - 0.5) * 4, y[some].astype(float), 1e-4)
        return cls(chain, max(float(slope), 1e-3), float(offset), float(y.mean()))

    def lines(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of all lines with a word, and their number in each text."""
        x, _, counts = line_features(texts)
        return self.chain.marginals(x, counts), counts

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.chain is not None and texts:
            x, lengths, counts = line_features(texts)
            some = counts > 0
            if some.any():
                out[some] = sigmoid((self.chain.means(x, lengths, counts)[some] - 0.5) * 4 * self.slope + self.offset)
        return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def lines_each(n_lines: list[int], most_lines: int) -> int:
    """The most lines of a document with which all documents together have ``most_lines`` at most (one each at least)."""
    left, rest = most_lines, len(n_lines)
    for n in sorted(n_lines):
        if n * rest > left:
            return max(1, left // rest)
        left, rest = left - n, rest - 1
    return max(1, *n_lines, 1)


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 4000, most_lines: int = 200_000, most_each: int = 2000) -> QualityModel:
    """A model of labels.quality from labelled documents that are not held out.

    Of at most ``sample`` documents, those with the smallest hash of their id, features are
    made by the executors. The driver gets them, not texts: ``most_lines`` lines in all (18 numbers a line) and ``most_each`` of a
    document. If there are more, the longest documents are each represented by as long a run of neighbouring lines as fits, from a place
    that a hash of the id names; every sampled document takes part. Of rows that share an id the one with the fewest lines does. Without usable labels (none, or one kind only) the model gives their share to all.
    """
    rows = labelled_sample(docs, labels, ["quality"], sample, ~held_out(F.col("doc_id")))
    schema = "doc_id long, quality int, n_lines long, own binary, lengths binary"

    def extract(batches):
        for b in batches:
            out = [own_rows([t]) for t in raw_bytes(b.column(2))]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([int(c[0]) for _, _, c in out], pa.int64()), pa.array([o.tobytes() for o, _, _ in out], pa.binary()), pa.array([n.tobytes() for _, n, _ in out], pa.binary())],
                names=["doc_id", "quality", "n_lines", "own", "lengths"],
            )

    scratch = Scratch(spark)
    made = rows.select("doc_id", "quality", "text").mapInArrow(extract, schema)
    made = made.groupBy("doc_id").agg(F.min(F.struct("n_lines", "own", "lengths", "quality")).alias("x"))
    made = scratch.keep(made.select("doc_id", "x.*"))
    most = lines_each([r.n_lines for r in made.select("n_lines").collect()], most_lines)
    most = min(most, most_each)
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.col("n_lines") - most + 1, F.lit(1)))
    run = lambda c, width: F.substring(c, (start * width + 1).cast("int"), F.lit(most * width)).alias(c)
    found = made.select("doc_id", "quality", F.least("n_lines", F.lit(most)).alias("n_lines"), run("own", 4 * OWN), run("lengths", 8)).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.own), bytes(r.lengths)))
    scratch.drop(made)
    own = np.frombuffer(b"".join(bytes(r.own) for r in found), np.float32).reshape(-1, OWN)
    lengths = np.frombuffer(b"".join(bytes(r.lengths) for r in found), np.float64)
    return QualityModel.fit(own, lengths, np.array([r.n_lines for r in found], dtype=np.int64), [r.quality for r in found])


def line_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from whole texts.

    Null texts count as empty, and a document without words gets the share of
    label 1 as its score. Null ids are never held out; rows may repeat.
    Without usable labels (none, or one kind only) all get the same score. An
    empty table gives no rows.
    """
    model = fit_quality(spark, docs, labels, sample)

    def score(batches):
        for b in batches:
            texts = raw_bytes(b.column(1))
            ends = np.cumsum([len(t or b"") for t in texts])
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH_BYTES, side="right")))
                yield pa.record_batch([b.column(0)[start:end], pa.array(model.score(texts[start:end]), pa.float64())], names=["doc_id", "score"])
                start = end

    found = pick(docs, doc_id="long", text="string").mapInArrow(lean(score), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
