"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples are labels; all other text is unlabelled and contains toxic documents too, in the
proportion ``prior``. A linear classifier g over hashed word features is fitted to the risk estimator

    prior * E_p[loss(g)]  +  max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss. The second term estimates the risk on clean documents; where it would fall below zero, the
model has begun to fit the unlabelled sample itself, and the step climbs out of it instead.

A feature is a word, or its first four or six bytes, that a document holds, holds twice, four times, or in one
of a hundred words. The model keeps the features that are most over-represented among the positives, so a
document of any length is judged by a few of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import held_out, ship_package, slices
from threadmine.llm.hashing import NOT_ALNUM, Words, distinct, mix
from threadmine.session import stage

PREFIXES = (None, 4, 6)
# Bounds of the training sample (rows) and of the model (features).
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 12_000, 2_048


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def margins(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """g of each text, from its distinct feature values."""
        at = np.minimum(np.searchsorted(self.features, values), max(len(self.features) - 1, 0))
        known = self.features[at] == values if len(self.features) else np.zeros(len(values), bool)
        sums = np.concatenate(([0.0], np.cumsum(np.where(known, self.weights[at], 0.0)))) if len(self.features) \
            else np.zeros(len(values) + 1)
        return sums[first[1:]] - sums[first[:-1]] + self.bias


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature hashes (32 bits) of each text, and the first of each text."""
    words = Words([r.lower() for r in raws], NOT_ALNUM)
    parts = [(words.hashes(p) >> np.uint64(32)) ^ np.uint64(i * 0x9E3779B9 & 0xFFFFFFFF) for i, p in enumerate(PREFIXES)]
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(len(raws)), counts * len(PREFIXES))
    values = np.stack(parts, axis=1).reshape(-1)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(values)))
    values, owner = values[at], owner[at]
    found = [(values, owner)]
    for i, repeated in enumerate((times >= 2, times >= 4, (times >= 2) & (times * 100 >= counts[owner]))):
        mark = np.uint64(0x85EBCA6B * (i + 1) & 0xFFFFFFFF)
        found.append((values[repeated] ^ mark, owner[repeated]))
    values, owner = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(raws) + 1))
    return distinct(values[order], first)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300,
        rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> Model:
    """Train on the feature sets of positive and unlabelled documents."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    positive, unlabelled = _without_copies(positive), _without_copies(unlabelled)
    known = _select(positive, unlabelled, prior)
    return learn(_rows(positive, known), _rows(unlabelled, known), known, prior, rounds, rate, decay, seed)


def learn(p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], known: np.ndarray, prior: float,
          rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> Model:
    """Minimise the risk on positive and unlabelled documents, given as columns of ``known`` and first of each document."""
    n_unlabelled = len(u[1]) - 1
    w = np.zeros(len(known) + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v, rng = np.zeros_like(w), np.zeros_like(w), np.random.default_rng(seed)
    parts = max(1, n_unlabelled // 3_000)
    step = 0
    for _ in range(rounds // parts + 1):
        for chunk in np.array_split(rng.permutation(n_unlabelled), parts):
            step += 1
            _, step_by = risk(p, u, w, prior, chunk)
            step_by[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * step_by, 0.999 * v + 0.001 * step_by**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(known.astype(np.uint64), w[:-1], float(w[-1]))


def risk(p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], w: np.ndarray, prior: float,
         some: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The estimated risk of weights ``w`` and the step to descend by: the risk's gradient, or, where the part on clean
    documents is below zero, the gradient that raises this part. ``some``: of these unlabelled documents only."""
    g_p, g_u = _margins(p, w), _margins(u, w, some)
    # d/dg log(1 + exp(-g)) = -s(-g); d/dg log(1 + exp(g)) = s(g)
    clean = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    toxic = prior * np.logaddexp(0, -g_p).mean()
    push = _gradient(u, _sigmoid(g_u) / len(g_u), len(w), some) - prior * _gradient(p, _sigmoid(g_p) / len(g_p), len(w))
    if clean < 0:
        return float(toxic), -push
    return float(toxic + clean), push - prior * _gradient(p, _sigmoid(-g_p) / len(g_p), len(w))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _minhashes(values: np.ndarray) -> tuple[int, ...]:
    """Three minhashes of a document's features. Documents of like words often share all three, copies always do."""
    seeds = [np.uint64(0x9E3779B97F4A7C15 * i & 2**64 - 1) for i in (1, 2, 3)]
    return tuple(int(mix(values.astype(np.uint64) + s).min()) for s in seeds) if len(values) else ()


def _without_copies(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The first of the documents with the same three minhashes; else the words of one text with
    many near copies would look like words of all toxic texts."""
    return list(reversed({_minhashes(x): x for x in reversed(sets)}.values()))


def _select(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """The features most over-represented among the positives, by the G statistic of their counts.

    A feature of toxic text alone has a ratio of shares of 1 / prior. Those below a quarter of that follow a
    language or a topic and are left out, like those whose count may be chance (G below 16, four deviations).
    """
    p, in_p = np.unique(np.concatenate(positive), return_counts=True)
    u, in_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(u, p), len(u) - 1)
    other = np.where(u[at] == p, in_u[at], 0)
    expected = (other + 0.5) * len(positive) / (len(unlabelled) + 1)
    ratio = in_p / expected
    g = 2 * (in_p * np.log(ratio) - (in_p - expected))
    score = np.where((ratio >= max(1.5, 0.25 / prior)) & (g >= 16), g, 0)
    best = np.lexsort((p, -score))[:MAX_FEATURES]
    return np.sort(p[best[score[best] > 0]])


def _rows(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the known features of each document, and the first of each document."""
    kept = []
    for values in sets:
        at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        kept.append(at[known[at] == values] if len(known) else at[:0])
    first = np.zeros(len(kept) + 1, np.int64)
    np.cumsum([len(x) for x in kept], out=first[1:])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), first


def _margins(rows: tuple[np.ndarray, np.ndarray], w: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
    columns, first = rows
    sums = np.concatenate(([0.0], np.cumsum(w[columns])))
    g = sums[first[1:]] - sums[first[:-1]] + w[-1]
    return g if some is None else g[some]


def _gradient(rows: tuple[np.ndarray, np.ndarray], by: np.ndarray, n: int, some: np.ndarray | None = None) -> np.ndarray:
    columns, first = rows
    if some is not None:
        full = np.zeros(len(first) - 1)
        full[some] = by
        by = full
    out = np.bincount(columns, np.repeat(by, np.diff(first)), n)
    out[-1] = by.sum()
    return out


def _sampled(rows: DataFrame) -> DataFrame:
    """(toxic, doc_id, blob) of a bounded sample (toxic, doc_id, text): features of each row, without copies, written."""
    id_field = rows.schema["doc_id"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                values, first = features([x.as_py() for x in batch.column(2)[lo:hi]])
                sets = [values[i:j] for i, j in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], batch.column(1)[lo:hi],
                    pa.array([np.array(_minhashes(x), np.uint64).tobytes() for x in sets], pa.binary()),
                    pa.array([x.astype(np.uint32).tobytes() for x in sets], pa.binary())], ["toxic", "doc_id", "minhashes", "blob"])

    schema = T.StructType([T.StructField("toxic", T.BooleanType()), id_field, T.StructField("minhashes", T.BinaryType()),
                           T.StructField("blob", T.BinaryType())])
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    once = Window.partitionBy("toxic", "doc_id").orderBy(F.xxhash64("text"), "text")
    found = rows.withColumn("turn", F.row_number().over(once)).where("turn = 1").select("toxic", "doc_id", raw).mapInArrow(extract, schema)
    found = stage(found, "features")
    first = found.groupBy("toxic", "minhashes").agg(F.min("doc_id").alias("doc_id"))  # as many rows as the sample
    return found.join(F.broadcast(first), ["toxic", "minhashes", "doc_id"], "left_semi").drop("minhashes")


def _chosen(sample: DataFrame, positive: int, unlabelled: int, prior: float) -> np.ndarray:
    """What ``_select`` gives, with the features counted by tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist(), bool)
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)]
            values = np.concatenate([np.zeros(0, np.uint32), *sets])
            of_toxic = np.repeat(toxic, [len(x) for x in sets])
            found, at = np.unique(values, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int64)), *(pa.array(np.bincount(at[side], minlength=len(found)))
                                                     for side in (of_toxic, ~of_toxic))], ["feature", "x", "other"])

    counts = sample.select("toxic", "blob").mapInArrow(count, "feature long, x long, other long").groupBy("feature").agg(
        F.sum("x").alias("x"), F.sum("other").alias("other")).where("x > 0")
    expected = (F.col("other") + 0.5) * (positive / (unlabelled + 1))
    ratio = F.col("x") / expected
    best = counts.withColumn("ratio", ratio).withColumn("g", 2 * (F.col("x") * F.log(ratio) - (F.col("x") - expected))).where(
        (F.col("ratio") >= max(1.5, 0.25 / prior)) & (F.col("g") >= 16)).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES)
    return np.array(sorted(r.feature for r in best.select("feature").collect()), np.uint32)


def _columns(sample: DataFrame, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``_rows`` gives for the positives and for the others, in the order of the ids."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, first = _rows([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)], known)
            blobs = [columns[i:j].astype(np.uint16).tobytes() for i, j in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["toxic", "doc_id", "blob"])

    held = sample.select("toxic", "doc_id", "blob").mapInArrow(keep, sample.select("toxic", "doc_id", "blob").schema).toArrow().sort_by("doc_id")
    out = []
    for side in (True, False):
        blobs = held.filter(pc.equal(held.column("toxic"), side)).column("blob")
        sets = [np.frombuffer(x.as_buffer(), np.uint16) for x in blobs]
        first = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(x) for x in sets], out=first[1:])
        out.append((np.concatenate([np.zeros(0, np.uint16), *sets]).astype(np.int64), first))
    return out


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on confirmed toxic documents and unlabelled ones, neither of them held out.

    The sample has the ids with the smallest hashes, one row of each (the one with the smallest hash of its text):
    ``max_positive`` of the toxic labels and ``max_unlabelled`` of all documents; rows that share three minhashes count
    once. The driver sees ``MAX_FEATURES`` features and which of them each of these rows has. ``prior`` is
    the share of toxic documents, by default that of the labels learned from. Rows with null ids or labels are not
    learned from; without any positive the model is constant.
    """
    ship_package(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    if prior is None:
        n = known.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("t"), F.count("*").alias("n")).first()
        prior = (n.t or 0) / n.n if n.n else 0.0
    order = F.xxhash64(F.lit(3), "doc_id")
    ids = known.where(F.col("toxic") == 1).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive)
    other = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    drawn = ids.select("doc_id", F.lit(True).alias("toxic")).unionByName(other.select("doc_id", F.lit(False).alias("toxic")))
    sample = stage(_sampled(docs.select("doc_id", "text").join(F.broadcast(drawn), ["doc_id"]).select("toxic", "doc_id", "text")), "sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(True) and sizes.get(False) and 0 < prior < 1):
        return fit([], [], prior)
    chosen = _chosen(sample, sizes[True], sizes[False], prior)
    return learn(*_columns(sample, chosen), chosen, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row over its whole text; a null or empty text scores as one without features."""
    ship_package(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                g = model.margins(*features([x.as_py() for x in batch.column(1)[lo:hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(_sigmoid(g))], ["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")).mapInArrow(judge, schema)


def clean_rows(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    ship_package(docs.sparkSession)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            for lo, hi in slices(texts):
                g = model.margins(*features([x.as_py() or b"" for x in texts[lo:hi]]))
                yield batch.slice(lo, hi - lo).filter(pa.array(_sigmoid(g) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Repeated rows are scored each for itself, a null doc_id is kept (held_out is then null), an empty table gives an
    empty result. Needs (doc_id, text) and (doc_id, toxic); other columns are ignored.
    """
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
