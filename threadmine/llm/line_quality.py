"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's score depends on its own features and on those of the lines
before and after it; neighbouring labels are tied by transition weights. Forward-backward gives each line's
probability of being good given the whole document, and the document's score is their mean weighted by length.

Labels are given for documents; in training a document's label stands for all of its lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import held_out, ship_package, slices
from threadmine.llm.hashing import Words, distinct

# Bound of the training sample (documents).
MAX_TRAIN = 3_000
THRESHOLD = 0.3


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in characters]] = 1
    return table


CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _class("0123456789"), "symbol": _class("#*$%&|<>"),
    "loud": _class("!?"), "stop": _class(".,;:"), "other": _class("()[]{}/\\=+_~^@\"'`-"),
    "wide": np.array([int(128 <= b < 192) for b in range(256)]),
}
N_FEATURES = 17


@dataclass
class Lines:
    """Lines with a word of a batch of texts: features, lengths in bytes, and the first line of each text."""

    features: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def line_features(raws: list[bytes]) -> Lines:
    words = Words(raws)
    data = words.bytes
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first_word = np.searchsorted(words.starts, np.append(starts, len(data)))
    n_words = np.diff(first_word)
    some = n_words > 0
    starts, ends, n_words = starts[some], ends[some], n_words[some]
    word_at = first_word[:-1][some]
    owner = np.searchsorted(words.first_bytes, starts, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(raws) + 1))
    length = (ends - starts).astype(np.float64)

    def per_line(by_byte: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(by_byte) + 1, np.int64)
        np.cumsum(by_byte, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float64)

    count = {name: per_line(table[data]) for name, table in CLASSES.items()}
    hashes = words.hashes()
    sizes = (words.ends - words.starts).astype(np.float64)

    def per_word(by_word: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(by_word)))
        return sums[word_at + n_words] - sums[word_at]

    line_of = np.repeat(np.arange(len(starts)), n_words)
    _, kinds = distinct(hashes, np.append(word_at, len(hashes)))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    line_hash = words.range_hashes(starts, ends)
    order = np.lexsort((line_hash, owner))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        equal = (owner[a] == owner[b]) & (line_hash[a] == line_hash[b])
        same[a] |= equal
        same[b] |= equal
    letters = np.maximum(length - per_line((data == 32).astype(np.int64)), 1)
    n = n_words.astype(np.float64)
    features = np.stack([
        np.log1p(length) / 6, np.log1p(n) / 5, np.minimum(per_word(sizes) / n / 10, 3), count["upper"] / letters,
        count["digit"] / letters, np.minimum(count["symbol"] / n, 3), np.minimum(count["loud"] / n, 3),
        np.minimum(count["stop"] / n, 3), np.minimum(count["other"] / n, 3), count["wide"] / letters,
        np.diff(kinds) / n, per_word(again) / n, same.astype(np.float64), per_word(sizes <= 3) / n,
        np.isin(data[np.maximum(ends - 1, 0)], [46, 33, 63, 58]).astype(np.float64),
        CLASSES["upper"][data[starts]].astype(np.float64), np.ones(len(n)),
    ], axis=1) if len(n) else np.zeros((0, N_FEATURES))
    return Lines(features, length, first)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, those of the line before and of the line after (zero at a text's ends)."""
    x = lines.features
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads = lines.first[:-1][np.diff(lines.first) > 0]
    before[heads] = 0
    tails = lines.first[1:][np.diff(lines.first) > 0] - 1
    after[tails] = 0
    return np.concatenate([x, before, after], axis=1)


def forward_backward(unary: np.ndarray, first: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many chains at once: log partition of each, P(good) of each line, sums over pairs of neighbours (2 x 2).

    ``unary`` is the score of good against bad of each line, ``ties`` the 2 x 2 transition scores.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    starts, counts_ = first[order], counts[order]
    scores = np.stack([np.zeros(len(unary)), unary], axis=1)
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    longest = counts_[0] if len(counts_) else 0
    active = np.searchsorted(-counts_, -np.arange(longest), side="left")  # chains longer than t
    alpha[starts] = scores[starts]
    for t in range(1, longest):
        at = starts[:active[t]] + t
        prior = alpha[at - 1]
        alpha[at] = scores[at] + np.logaddexp(prior[:, :1] + ties[0], prior[:, 1:] + ties[1])
    for t in range(longest - 2, -1, -1):
        at = starts[:active[t + 1]] + t
        later = beta[at + 1] + scores[at + 1]
        beta[at] = np.logaddexp(ties[:, 0] + later[:, :1], ties[:, 1] + later[:, 1:])
    total = np.zeros(len(counts))
    last = starts + counts_ - 1
    total[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    each = np.repeat(total, counts)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - each, 0))
    inner = np.ones(len(unary), bool)
    inner[first[:-1][counts > 0]] = False
    at = np.flatnonzero(inner)
    later = beta[at] + scores[at]
    pairs = np.array([[np.exp(np.minimum(alpha[at - 1, i] + ties[i, j] + later[:, j] - each[at], 0)).sum() for j in (0, 1)]
                      for i in (0, 1)])
    return total, good, pairs


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    empty: float

    def scores(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of P(good) of each text; ``empty`` for a text without a line."""
        x = (with_neighbours(lines) - self.mean) / self.scale
        _, good, _ = forward_backward(x @ self.weights[:-1] + self.weights[-1], lines.first, self.ties)
        sums = np.zeros((len(good) + 1, 2))
        np.cumsum(np.stack([good * lines.lengths, lines.lengths], axis=1), axis=0, out=sums[1:])
        weighted, length = (sums[lines.first[1:]] - sums[lines.first[:-1]]).T
        return np.clip(np.where(length > 0, weighted / np.maximum(length, 1), self.empty), 0, 1)


def fit(lines: Lines, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-2) -> Model:
    """Maximise the conditional likelihood of the documents' labels on all their lines, with Adam."""
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    x = with_neighbours(lines)
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(3 * N_FEATURES), np.ones(3 * N_FEATURES))
    model = Model(mean, scale, np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), share)
    model.weights[-1] = np.log(share / (1 - share))
    if len(x) == 0 or labels.min() == labels.max():
        return model
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    counts = np.diff(lines.first)
    y = np.repeat(labels, counts).astype(np.float64)
    seen = np.diag([(np.maximum(counts - 1, 0) * (labels == k)).sum() for k in (0, 1)]).astype(np.float64)
    w = np.concatenate([model.weights, np.zeros(4)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        _, good, pairs = forward_backward(x @ w[:-4], lines.first, w[-4:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (good - y), (pairs - seen).ravel()]) / len(labels) + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-4], w[-4:].reshape(2, 2), share)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled documents that are not held out with the ``max_train`` smallest hashes of doc_id.

    Of an id that repeats the row with the smallest hash of its text is taken.
    Rows with null ids or labels are not learned from; without labels of both kinds the model is constant.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(
        F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(max_train)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("raw"), "raw")
    rows = docs.select("doc_id", raw).join(F.broadcast(sample), ["doc_id"]).withColumn(  # max_train rows
        "turn", F.row_number().over(once)).where("turn = 1").drop("turn")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                lines = line_features([x.as_py() for x in batch.column(2)[lo:hi]])
                parts = list(zip(lines.first, lines.first[1:]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], batch.column(1)[lo:hi],
                    pa.array([lines.features[i:j].astype(np.float32).tobytes() for i, j in parts], pa.binary()),
                    pa.array([lines.lengths[i:j].astype(np.float32).tobytes() for i, j in parts], pa.binary()),
                ], ["doc_id", "y", "x", "n"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("y", T.IntegerType()),
                           T.StructField("x", T.BinaryType()), T.StructField("n", T.BinaryType())])
    found = rows.select("doc_id", "y", "raw").mapInArrow(extract, schema).toArrow().sort_by("doc_id")
    x = [np.frombuffer(b.as_py(), np.float32).reshape(-1, N_FEATURES) for b in found.column("x")]
    n = [np.frombuffer(b.as_py(), np.float32) for b in found.column("n")]
    first = np.zeros(len(x) + 1, np.int64)
    np.cumsum([len(a) for a in x], out=first[1:])
    lines = Lines(np.concatenate([np.zeros((0, N_FEATURES)), *x]).astype(np.float64),
                  np.concatenate([np.zeros(0), *n]).astype(np.float64), first)
    return fit(lines, np.array(found.column("y").to_pylist(), np.int64))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, over its whole text.

    A null text, an empty one or one without words scores the share of good labels. Repeated rows are scored each
    for itself, a null doc_id is kept (held_out is then null), an empty table gives an empty result.
    Needs (doc_id, text) and (doc_id, quality); other columns are ignored.
    """
    model = train(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                scores = model.scores(line_features([x.as_py() for x in batch.column(1)[lo:hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(scores)], ["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select("doc_id", raw).mapInArrow(judge, schema).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
