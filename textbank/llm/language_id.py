"""Language ID by string kernels.

The blended-spectrum presence kernel of two texts counts the different n-grams,
of several lengths, that both have, scaled by how many each has. Landmark texts
give the Nystroem map of that kernel: a text is described by its kernel values
with the landmarks, whitened by the landmarks' own kernel matrix. One-versus-rest
ridge regression on that map is kernel ridge regression in its span. Kernel values
are products of a text's presence vector with the landmarks', so landmarks and
weights fold into one matrix, and a batch is scored by one sparse product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import map_texts, slices

#: Lengths of the n-grams in bytes, and places of a presence vector that they are hashed to.
NGRAMS, PLACES = (1, 2, 3, 4), 1 << 17
LANDMARKS, RIDGE = 96, 1e-3
#: Training documents, at most; chosen by a hash of the id.
MAX_ROWS = 3_000
#: Numbers gathered from a matrix at once, about.
AT_ONCE = 1 << 21
UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # PLACES x languages: landmarks, whitening and ridge weights in one
    mean: np.ndarray


class Presence:
    """Presence vectors of texts: in each row 1 / sqrt(k) at the k different places of its n-grams, else 0."""

    def __init__(self, texts: pa.Array):
        """ASCII letters are lower-cased, digits and white space each one sign."""
        table = np.arange(256, dtype=np.uint32)
        table[0x41:0x5B] += 0x20
        table[0x30:0x3A] = 0x30
        table[0x09:0x0E] = 0x20
        seen = np.zeros(PLACES, dtype=bool)
        own = []
        for text in texts:
            raw = text.as_buffer() if text.is_valid else b""
            data = table[np.frombuffer(raw, np.uint8)] if len(raw) else np.zeros(0, np.uint32)
            h = np.zeros(len(data), np.uint32)
            parts = []
            for n in range(1, max(NGRAMS) + 1):
                if len(data) < n:
                    break
                h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
                if n in NGRAMS:
                    parts.append((h * np.uint32(0x9E3779B1)) >> np.uint32(33 - PLACES.bit_length()))
            places = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            if len(places) > PLACES // 8:
                seen[:] = False
                seen[places] = True
                places = np.flatnonzero(seen).astype(np.uint32)
            else:
                places = np.unique(places)
            own.append(places)
        self.counts = np.array([len(p) for p in own], np.int64)
        self.places = np.concatenate(own) if own else np.zeros(0, np.uint32)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The product of all rows with a matrix of PLACES rows."""
        width = matrix.shape[1]
        out = np.zeros((len(self.counts), width))
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        row = 0
        while width and row < len(out):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + AT_ONCE // width, "right")) - 1)
            filled = row + np.flatnonzero(self.counts[row:stop])
            if len(filled):
                sums = np.add.reduceat(matrix[self.places[ends[row] : ends[stop]]], ends[filled] - ends[row], axis=0)
                out[filled] = sums / np.sqrt(self.counts[filled])[:, None]
            row = stop
        return out

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """The chosen rows as columns of a matrix."""
        out = np.zeros((PLACES, len(rows)), np.float32)
        ends = np.cumsum(self.counts)
        for k, i in enumerate(rows.tolist()):
            out[self.places[ends[i] - self.counts[i] : ends[i]], k] = self.counts[i] ** -0.5
        return out


def fit(batches: Iterator[pa.RecordBatch]) -> Model:
    """A model from rows of (doc_id, text, lang), of which the first of each language serve as landmarks in turn."""
    pieces, names = [], []
    for piece in slices(batches):
        pieces.append(Presence(piece.column(1)))
        names += piece.column(2).to_pylist()
    if not names:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0))
    languages = sorted(set(names))
    y = np.array([languages.index(n) for n in names])
    turn = np.zeros(len(y), np.int64)
    for c in range(len(languages)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.lexsort((y, turn))[:LANDMARKS]
    first = np.cumsum([0, *(len(p.counts) for p in pieces)])
    marks = np.empty((PLACES, len(chosen)), np.float32)
    for p, a, b in zip(pieces, first[:-1], first[1:], strict=True):
        at = np.flatnonzero((chosen >= a) & (chosen < b))
        marks[:, at] = p.dense(chosen[at] - a)
    own = np.concatenate([p.times(marks) for p in pieces])
    values, vectors = np.linalg.eigh((own[chosen] + own[chosen].T) / 2)
    good = values > 1e-8 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    z = own @ white
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each class weighs the same, so that frequent languages do not win ties.
    share = np.bincount(y, minlength=len(languages))
    w = (1.0 / share[y])[:, None]
    mean_z, mean_t = (w * z).sum(axis=0) / w.sum(), (w * targets).sum(axis=0) / w.sum()
    zc = z - mean_z
    gram = zc.T @ (w * zc)
    beta = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), zc.T @ (w * (targets - mean_t)))
    return Model(languages, (marks @ (white @ beta)).astype(np.float32), mean_t - mean_z @ beta)


def sample(docs: DataFrame, train: Column, most: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, lang of at most `most` documents with a language and a text that meet train; only their ids are broadcast.

    An id with several texts counts with the first in order, so `most` bounds the rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("own")).select("doc_id", "own.text", "own.lang")


def train(rows: DataFrame) -> Model:
    """A model fitted by one task on rows (doc_id, text, lang), whose number MAX_ROWS bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit(batches)
        arrays = (pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary()) for a, t in ((m.weights, np.float32), (m.mean, np.float64)))
        yield pa.record_batch([pa.array([m.languages], pa.list_(pa.string())), *arrays], names=["languages", "weights", "mean"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "lang")
    r = ordered.mapInArrow(run, "languages array<string>, weights binary, mean binary").first()
    if r is None:  # no task had a row
        return fit(iter(()))
    n = len(r["languages"])
    weights = np.frombuffer(r["weights"], np.float32) if n else np.zeros(0, np.float32)
    return Model(list(r["languages"]), weights.reshape(PLACES, n), np.frombuffer(r["mean"], np.float64) if n else np.zeros(0))


def language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, margins (by language, in the model's order) for each row of docs (doc_id, text).

    score is the softmax of the winner's margin. A null text, or one without a
    letter, is "und" with score 0, as is every text if the model has learned
    nothing. Ties go to the language first in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        text = batch.column(1)
        names, scores, margins = [], [], []
        letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_pylist()
        value = Presence(text).times(m.weights) + m.mean
        for i, v in enumerate(value):
            known = letters[i] and len(v)
            best = int(v.argmax()) if known else -1
            names.append(m.languages[best] if known else UNDETERMINED)
            scores.append(float(1 / np.exp(4 * (v - v[best])).sum()) if known else 0.0)
            margins.append(v.tolist())
        return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "margins"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), piece, "doc_id long, lang_pred string, score double, margins array<double>")
