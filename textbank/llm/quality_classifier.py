"""Quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network.

A term is a lower-cased word or a word's shape (its kinds of characters with runs
drawn together), hashed to a fixed number of rows. Each row has a sparse random
index vector; a term's own vector is the sum of the index vectors that stand
around it in the training texts, damped by how frequent it is. A document is
described by pooling its terms' vectors: their mean, the mean over different
terms, and the spread. A network with one hidden layer gives two logits, and a
temperature fitted on training documents kept out of its descent calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import map_texts, slices
from textbank.llm.wordhash import WHITESPACE, Words, mix

#: Rows for words and for shapes, length of a vector, non-zero entries of an index vector.
WORD_ROWS, SHAPE_ROWS, DIMENSION, NON_ZERO = 1 << 14, 1 << 11, 48, 6
#: Words on either side that count as around a word.
AROUND = 2
#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
MAX_ROWS = 8_000
HIDDEN, EPOCHS = 32, 250
#: One training row in so many sets the temperature.
CALIBRATION = 5


#: Bytes of text worked on at once: a word takes some hundred bytes of vectors.
AT_ONCE = 1 << 18


class Model(NamedTuple):
    vectors: np.ndarray  # rows x DIMENSION
    scale: np.ndarray  # 2 x features: mean and spread
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    rows = WORD_ROWS + SHAPE_ROWS
    out = np.zeros((rows, DIMENSION), np.float32)
    for _ in range(NON_ZERO):
        out[np.arange(rows), rng.integers(0, DIMENSION, rows)] += rng.choice([-1.0, 1.0], rows)
    return out


def terms(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, and the row of each word and of its shape."""
    words = Words(texts, WHITESPACE)
    lower = Words(texts, WHITESPACE, lower=True)
    kind = np.arange(256, dtype=np.uint8)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")
    signs = kind[words.data]
    opens = np.ones(len(signs), dtype=bool)
    opens[1:] = signs[1:] != signs[:-1]
    opens &= words.is_word
    # A polynomial hash of the signs that open a run, over the bytes of each word.
    rank = np.concatenate([[0], np.cumsum(opens)])
    base = np.uint64(0x9E3779B97F4A7C15)
    longest = int((words.end - words.start).max(initial=0)) + 1
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest, base, np.uint64)]))
    place = (rank[:-1] - np.repeat(rank[words.start], words.end - words.start)[np.cumsum(words.is_word) - 1] if len(words.start) else rank[:-1])
    value = np.where(opens, (signs.astype(np.uint64) + np.uint64(1)) * power[np.clip(place, 0, longest)], np.uint64(0))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    shape = mix(sums[words.end] - sums[words.start])
    return words, (lower.hashes % np.uint64(WORD_ROWS)).astype(np.int64), WORD_ROWS + (shape % np.uint64(SHAPE_ROWS)).astype(np.int64)


def _around(words: Words, word: np.ndarray, shape: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each word, the sum of the index vectors of the words and shapes around it in its document."""
    own = index[word] + index[shape]
    out = np.zeros_like(own)
    for k in range(1, AROUND + 1):
        same = words.doc[k:] == words.doc[:-k]
        out[k:] += own[:-k] * same[:, None]
        out[:-k] += own[k:] * same[:, None]
    return out


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    if len(heads):
        total[rows[heads]] += np.add.reduceat(values, heads, axis=0)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: pooled vectors and the logarithm of its number of words; zeros for a text without words."""
    words, word, shape = terms(texts)
    n = np.maximum(words.counts, 1)[:, None]
    out = []
    heads = words.first[:-1]
    filled = words.counts > 0

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.zeros((words.n_docs, values.shape[1]))
        if filled.any():
            sums[filled] = np.add.reduceat(values, heads[filled], axis=0)
        return sums

    for rows in (word, shape):
        v = vectors[rows]
        mean = total(v) / n
        spread = np.sqrt(np.maximum(total(v * v) / n - mean**2, 0))
        key = np.unique(words.doc * np.int64(WORD_ROWS + SHAPE_ROWS) + rows)
        doc = key // (WORD_ROWS + SHAPE_ROWS)
        different = np.zeros_like(mean)
        if len(key):
            starts = np.searchsorted(doc, np.flatnonzero(filled))
            different[filled] = np.add.reduceat(vectors[key % (WORD_ROWS + SHAPE_ROWS)], starts, axis=0)
        k = np.bincount(doc, minlength=words.n_docs)[:, None] if len(key) else np.zeros_like(n)
        out += [mean, spread, different / np.maximum(k, 1), np.log1p(k) - np.log1p(words.counts[:, None])]
    return np.concatenate([*out, np.log1p(words.counts[:, None])], axis=1).astype(np.float32)


def _logits(x: np.ndarray, m: Model) -> np.ndarray:
    h = np.maximum((x - m.scale[0]) / m.scale[1] @ m.w1 + m.b1, 0)
    return h @ m.w2 + m.b2


def _probability(logits: np.ndarray, temperature: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((logits[:, 1] - logits[:, 0]) / temperature, -40, 40)))


def fit(batches: Iterator[pa.RecordBatch]) -> Model:
    """A model from rows of (doc_id, text, label)."""
    pieces = [(p.column(1), p.column(2).to_numpy(zero_copy_only=False)) for p in slices(batches, most=AT_ONCE)]
    index = _index_vectors()
    total, count = np.zeros(index.shape), np.zeros(len(index))
    for texts, _ in pieces:
        words, word, shape = terms(texts)
        around = _around(words, word, shape, index)
        for rows in (word, shape):
            _add_rows(total, rows, around)
            count += np.bincount(rows, minlength=len(count))
    length = np.linalg.norm(total, axis=1, keepdims=True)
    damped = 1e-3 / (1e-3 + count / max(count.sum() / 2, 1))
    vectors = (total / np.maximum(length, 1e-9) * np.sqrt(damped)[:, None]).astype(np.float32)
    unseen = count == 0
    vectors[unseen] = 0
    rng = np.random.default_rng(5)
    width = 6 * DIMENSION + 3
    w1, w2 = rng.normal(0, width**-0.5, (width, HIDDEN)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2))
    m = Model(vectors, np.stack([np.zeros(width), np.ones(width)]), w1, np.zeros(HIDDEN), w2, np.zeros(2), 1.0)
    if not pieces:
        return m
    x = np.concatenate([pooled(texts, vectors) for texts, _ in pieces]).astype(np.float64)
    y = np.concatenate([labels for _, labels in pieces]).astype(np.int64)
    m = m._replace(scale=np.stack([x.mean(axis=0), x.std(axis=0) + 1e-3]))
    kept = np.arange(len(y)) % CALIBRATION == 0 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
    xs = (x - m.scale[0]) / m.scale[1]
    parameters = [m.w1, m.b1, m.w2, m.b2]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    train = np.flatnonzero(~kept)
    share = np.bincount(y[train], minlength=2)
    weight = np.sqrt(share.max() / np.maximum(share, 1))[y]
    step = 0
    for _ in range(EPOCHS if len(train) < 2000 else EPOCHS // 4):
        order = rng.permutation(train)
        for start in range(0, len(order), 256):
            at = order[start : start + 256]
            a = xs[at] * (rng.random(xs[at].shape) < 0.9)
            h = np.maximum(a @ parameters[0] + parameters[1], 0)
            z = h @ parameters[2] + parameters[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[at][:, None] / len(at)
            back = (p @ parameters[2].T) * (h > 0)
            gradients = [a.T @ back + 1e-3 * parameters[0], back.sum(axis=0), h.T @ p + 1e-3 * parameters[2], p.sum(axis=0)]
            step += 1
            for q, g, f, s in zip(parameters, gradients, first, second, strict=True):
                f += 0.1 * (g - f)
                s += 0.001 * (g * g - s)
                q -= 0.003 * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    m = m._replace(w1=parameters[0], b1=parameters[1], w2=parameters[2], b2=parameters[3])
    if kept.any():
        logits, target = _logits(x[kept], m), y[kept]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [-np.log(np.clip(np.where(target == 1, p := _probability(logits, t), 1 - p), 1e-9, 1)).mean() for t in grid]
        m = m._replace(temperature=float(grid[int(np.argmin(loss))]))
    return m


def train(sample: DataFrame) -> Model:
    """A model fitted by one task on sample (doc_id, text, label), whose rows MAX_ROWS bounds."""
    names = ("vectors", "scale", "w1", "b1", "w2", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit(batches)
        arrays = [np.ascontiguousarray(getattr(m, n), np.float32) for n in names]
        yield pa.record_batch([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([m.temperature], pa.float64())], names=[*names, "temperature"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    r = ordered.mapInArrow(run, ", ".join(f"{n} binary" for n in names) + ", temperature double").first()
    if r is None:  # no task had a row
        return fit(iter(()))
    width = 6 * DIMENSION + 3
    shapes = ((-1, DIMENSION), (2, width), (width, HIDDEN), (HIDDEN,), (HIDDEN, 2), (2,))
    return Model(*(np.frombuffer(r[n], np.float32).reshape(s) for n, s in zip(names, shapes, strict=True)), r["temperature"])


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text): the calibrated probability of quality 1.

    A null or empty text has the score of no words at all. Other columns are
    ignored; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return pa.record_batch([batch.column(0), pa.array(_probability(_logits(pooled(batch.column(1), m.vectors), m), m.temperature).astype(np.float64))], names=["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), piece, "doc_id long, score double", AT_ONCE)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = batch.column(batch.schema.get_field_index("text"))
        return batch.filter(pa.array(_probability(_logits(pooled(texts, m.vectors), m), m.temperature) >= threshold))

    return map_texts(docs, piece, docs.schema, AT_ONCE)
