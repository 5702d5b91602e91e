"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, from both ends of each. At every byte the two states together give a
probability for each language; the mean over all bytes of a text is the text's. Gates and candidate states are clipped
lines instead of sigmoid and tanh: the network is trained with what it is run with, and a step is a table look-up,
a product and a few element-wise operations for all windows of a batch at once.

Training: cross-entropy at every byte, gradients by backpropagation through time, Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import ship_package, slices, text_or_empty
from threadmine.session import lookup_join, stage

WINDOW, HIDDEN = 64, 8
# Bounds of the training sample: rows, and windows of each.
MAX_TRAIN, MAX_WINDOWS = 2_000, 4
UNKNOWN = "und"


@dataclass
class Model:
    """``tables`` and ``products``: what a byte and what the state before it add to update gate, reset gate and
    candidate, for either direction; ``out`` and ``bias``: from both states to the languages."""

    langs: list[str]
    tables: list[np.ndarray]
    products: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.products, self.out, self.bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 17) -> Model:
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    tables = [drawn(256, 3 * hidden, scale=0.5) for _ in range(2)]
    products = [drawn(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)]
    return Model(langs, tables, products, drawn(2 * hidden, len(langs), scale=0.1), np.zeros(len(langs), np.float32))


def _step(gates: np.ndarray, product: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state, update gate, reset gate, candidate and the candidate's product; ``gates`` is overwritten."""
    h = state.shape[1]
    moved = state @ product
    both = gates[:, :2 * h]
    both += moved[:, :2 * h]
    both *= np.float32(0.25)
    both += np.float32(0.5)
    np.clip(both, 0, 1, out=both)
    update, reset, candidate = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
    candidate += reset * moved[:, 2 * h:]
    np.clip(candidate, -1, 1, out=candidate)
    return state + update * (candidate - state), update, reset, candidate, moved[:, 2 * h:]


def label(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at every byte of ``data``, which the windows (longest first) cover."""
    hidden = len(model.products[0])
    logits = np.empty((len(data), len(model.langs)), np.float32)
    logits[:] = model.bias
    for way in range(2):
        table, product, out = model.tables[way], model.products[way], model.out[way * hidden:(way + 1) * hidden]
        state = np.zeros((len(starts), hidden), np.float32)
        for s in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -s, side="left"))  # windows longer than s
            at = starts[:n] + (s if way == 0 else lengths[:n] - 1 - s)
            state = _step(table[data[at]], product, state[:n])[0]
            logits[at] += state @ out
    logits -= logits.max(axis=1, keepdims=True, initial=-np.inf)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def windows(first: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, longest first, of the windows of texts that begin at ``first`` (and end at the next one)."""
    counts = -(-np.diff(first) // size)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first[owner] + number * size
    lengths = np.minimum(first[owner + 1] - starts, size)
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def pooled(model: Model, raws: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text; of an empty one all alike."""
    first = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) for r in raws], out=first[1:])
    each = label(model, np.frombuffer(b"".join(raws), np.uint8), *windows(first))
    sums = np.zeros((len(each) + 1, len(model.langs)))
    np.cumsum(each, axis=0, out=sums[1:])
    lengths = np.diff(first)[:, None]
    return np.where(lengths > 0, (sums[first[1:]] - sums[first[:-1]]) / np.maximum(lengths, 1), 1 / max(len(model.langs), 1))


def loss_and_gradient(model: Model, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes of windows (rows of ``data``, padded), and its gradient by parameter."""
    n, steps = data.shape
    hidden, kept, states = len(model.products[0]), [[], []], np.zeros((2, steps, n, len(model.products[0])), np.float32)
    inside = np.arange(steps)[:, None] < lengths[None, :]
    places = [np.tile(np.arange(steps)[:, None], (1, n)), lengths[None, :] - 1 - np.arange(steps)[:, None]]
    rows = np.arange(n)
    for way in range(2):
        state = np.zeros((n, hidden), np.float32)
        for s in range(steps):
            on = inside[s][:, None]
            x = data[rows, np.maximum(places[way][s], 0)]
            new, update, reset, candidate, moved = _step(model.tables[way][x], model.products[way], state)
            kept[way].append((x, on, state, update, reset, candidate, moved))
            state = np.where(on, new, state)
            states[way, np.where(inside[s], places[way][s], s), rows] = np.where(on, new, 0)
    both = np.concatenate(states, axis=2)
    logits = both @ model.out + model.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = max(int(inside.sum()), 1)
    loss = float(-(np.log(np.maximum(p[:, rows, labels], 1e-30)) * inside).sum() / total)
    p[:, rows, labels] -= 1
    error = p * (inside[:, :, None] / np.float32(total))
    d_out, d_bias = np.tensordot(both, error, ((0, 1), (0, 1))), error.sum((0, 1))
    d_states = error @ model.out.T
    d_tables, d_products = [], []
    for way in range(2):
        table, product = np.zeros_like(model.tables[way]), np.zeros_like(model.products[way])
        back = np.zeros((n, hidden), np.float32)
        for s in reversed(range(steps)):
            x, on, state, update, reset, candidate, moved = kept[way][s]
            back = back + np.where(on, d_states[np.maximum(places[way][s], 0), rows, way * hidden:(way + 1) * hidden], 0)
            d_new = np.where(on, back, 0)
            d_candidate = d_new * update * (np.abs(candidate) < 1)
            d_update = d_new * (candidate - state) * ((update > 0) & (update < 1)) * np.float32(0.25)
            d_reset = d_candidate * moved * ((reset > 0) & (reset < 1)) * np.float32(0.25)
            d_gates = np.concatenate([d_update, d_reset, d_candidate], axis=1)
            d_moved = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            np.add.at(table, x, d_gates)
            product += state.T @ d_moved
            back = np.where(on, d_new * (1 - update) + d_moved @ model.products[way].T, back)
        d_tables.append(table)
        d_products.append(product)
    return loss, [*d_tables, *d_products, d_out, d_bias]


def fit(raws: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = 6, batch: int = 128, rate: float = 0.01,
        seed: int = 23) -> Model:
    """Train on windows (at most ``WINDOW`` bytes each) and their languages."""
    langs = sorted(set(labels))
    model = new_model(langs, hidden)
    if len(langs) < 2:
        return model
    lengths = np.array([len(r) for r in raws], np.int64)
    data = np.zeros((len(raws), WINDOW), np.uint8)
    for i, r in enumerate(raws):
        data[i, :len(r)] = np.frombuffer(r, np.uint8)
    y = np.array([langs.index(x) for x in labels])
    rng, step, steps = np.random.default_rng(seed), 0, epochs * -(-len(raws) // batch)
    held = model.parameters()
    m, v = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for lo in range(0, len(raws), batch):
            some = order[lo:lo + batch]
            _, gradients = loss_and_gradient(model, data[some], lengths[some], y[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            step += 1
            speed = np.float32(rate * (1 - step / (steps + 1)) / (1 - 0.9**step) * np.sqrt(1 - 0.999**step))
            for p, g, a, b in zip(held, gradients, m, v):
                g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                a += np.float32(0.1) * (g - a)
                b += np.float32(0.001) * (g * g - b)
                p -= speed * a / (np.sqrt(b) + np.float32(1e-8))
    return model


def held_out() -> Column:
    """True for the quarter of the ids that nothing may be learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, max_train: int = MAX_TRAIN, max_windows: int = MAX_WINDOWS) -> Model:
    """Fit on a sample of the rows with a language that are not held out.

    The sample has ``max_train`` rows at most, of all languages in turn, by the smallest hashes of doc_id and text, and
    ``max_windows`` windows of each row at most, at places spread over the whole text. Only those windows leave
    the tasks. Rows with null ids are not learned from.
    """
    raw = text_or_empty().cast("binary")
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & (F.length(raw) > 0)).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(5), "doc_id", "text").alias("place"),
        raw.alias("raw"), F.length(raw).alias("size"))
    # Of a language with many rows only those below a place that some four times the wanted number reach are ordered.
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("place") / F.lit(2.0**64) + 0.5
    drawn = lookup_join(known, stage(rows, "languages"), ["lang"], ["place"]).where(share * F.col("n") < 4 * max_train)
    room = F.greatest(F.col("size") - WINDOW + 1, F.lit(1))
    places = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(max_windows - 1), F.floor((F.col("size") - 1) / WINDOW).cast("int"))),
        lambda i: F.substring(F.col("raw"), F.pmod(F.xxhash64("place", i), room).cast("int") + 1, F.lit(WINDOW)))
    turn = Window.partitionBy("lang").orderBy("place", "parts")
    sample = drawn.select("lang", "place", places.alias("parts")).withColumn("turn", F.row_number().over(turn)).where(
        F.col("turn") <= max_train).orderBy("turn", "lang").limit(max_train).select("lang", "parts").collect()
    pairs = [(bytes(p), r["lang"]) for r in sample for p in r["parts"]]
    return fit([p for p, _ in pairs], [x for _, x in pairs])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, over its whole text.

    score is the text's probability of lang_pred; equal ones go to the first language in code point order. A text
    that is null or has no letter is ``und`` with score 0, and so is every text where no language was learned.
    Bytes that are no UTF-8 are read like any others. Repeated rows are judged each for itself, a null doc_id is kept
    (held_out is then null), an empty table gives an empty result. Needs (doc_id, text); other columns are ignored.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights, and a row for each language learned

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                letters = batch.column(2)[lo:hi].to_pylist()
                if model.langs:
                    p = pooled(model, [x.as_py() for x in batch.column(1)[lo:hi]])
                    best = p.argmax(axis=1)
                    names = [model.langs[i] if known else UNKNOWN for i, known in zip(best, letters)]
                    scores = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                else:
                    names, scores = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", text_or_empty().cast("binary").alias("raw"), letter).mapInArrow(judge, schema).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
