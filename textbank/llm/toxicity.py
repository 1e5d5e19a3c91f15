"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, hashed to rows of an embedding
table, so a misspelling shares most rows with the word it comes from. The
vectors of a passage's words are averaged and a linear softmax tells toxic from
not; table and softmax are trained jointly in numpy. A text is as toxic as its
worst passage: a few words in a long text must not be averaged away. Because the
softmax is linear, scoring needs one number a table row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import map_texts, slices
from textbank.llm.wordhash import Words

#: ASCII characters that end a word: all but letters and digits.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
NGRAMS = (3, 4, 5, 6)
BUCKETS, DIMENSION = 1 << 18, 12
#: Words in a passage; passages overlap by half.
PASSAGE = 12
#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
MAX_ROWS = 12_000


def _ngram_hashes(words: Words) -> list[np.ndarray]:
    """For each n, the table row of the n bytes from each byte of the batch; other bytes than a word's count as one separator."""
    data = np.where(words.is_word, words.data, 0x20).astype(np.uint32)
    out, h = [], np.zeros(len(data) + 1, np.uint32)
    padded = np.concatenate([data, np.full(max(NGRAMS) + 1, 0x20, np.uint32)])
    h = np.zeros(len(data) + 1, np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        h = (h ^ padded[n - 1 : n + len(data)]) * np.uint32(0x01000193) + np.uint32(n)
        if n in NGRAMS:
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def _bag_sizes(words: Words) -> np.ndarray:
    length = words.end - words.start
    return sum(np.maximum(length + 3 - n, 0) for n in NGRAMS)


def _word_scores(words: Words, score: np.ndarray) -> np.ndarray:
    """Mean over each word's n-grams, with its two ends, of the score of their rows."""
    total = np.zeros(len(words.start))
    for n, rows in zip(NGRAMS, _ngram_hashes(words), strict=True):
        sums = np.concatenate([[0.0], np.cumsum(score[rows], dtype=np.float64)])
        end = np.maximum(words.end + 2 - n, words.start - 1)
        total += sums[end] - sums[words.start - 1]
    return total / np.maximum(_bag_sizes(words), 1)


def _bags(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of the chosen words, end to end, and their number for each."""
    parts, counts = [], []
    for n, rows in zip(NGRAMS, _ngram_hashes(words), strict=True):
        k = np.maximum(words.end[chosen] - words.start[chosen] + 3 - n, 0)
        at = np.repeat(words.start[chosen] - 1 - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        parts.append((np.repeat(np.arange(len(chosen)), k), rows[at]))
        counts.append(k)
    word = np.concatenate([p[0] for p in parts])
    rows = np.concatenate([p[1] for p in parts])
    return rows[np.argsort(word, kind="stable")], sum(counts)


def _passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every passage, in order; a document without words has one empty passage."""
    n = np.diff(first)
    k = np.maximum((2 * n - 1) // PASSAGE, 1)
    doc = np.repeat(np.arange(len(n)), k)
    start = (np.arange(len(doc)) - (np.cumsum(k) - k)[doc]) * (PASSAGE // 2) + first[doc]
    return start, np.minimum(start + PASSAGE, first[doc + 1]), doc


def _worst(word_scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the mean word score of its worst passage, and where that passage starts and ends."""
    start, end, doc = _passages(first)
    sums = np.concatenate([[0.0], np.cumsum(word_scores)])
    mean = (sums[end] - sums[start]) / np.maximum(end - start, 1)
    heads = np.searchsorted(doc, np.arange(len(first) - 1))
    best = np.maximum.reduceat(mean, heads) if len(doc) else np.zeros(0)
    at = np.flatnonzero(mean == best[doc])
    at = at[np.unique(doc[at], return_index=True)[1]]
    return best, start[at], end[at]


def _fresh(words: Words) -> np.ndarray:
    """Per word, 1 unless it repeats the word before it in its document; a word said over and over counts once."""
    out = np.ones(len(words.hashes), np.float32)
    out[1:] = words.hashes[1:] != words.hashes[:-1]
    out[words.first[:-1][words.counts > 0]] = 1
    return out


def fit(batches: Iterator[pa.RecordBatch], epochs: int = 80, warm: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Score per table row and bias, from rows of (doc_id, text, label)."""
    labels, counts, tokens, fresh_words = [], [], [], []
    known, rows, sizes = np.zeros(0, np.uint64), [], []
    for piece in slices(batches):
        words = Words(piece.column(1), _SEPARATORS, lower=True)
        labels.append(piece.column(2).to_numpy(zero_copy_only=False))
        counts.append(words.counts)
        tokens.append(words.hashes)
        fresh_words.append(_fresh(words))
        unique, at = np.unique(words.hashes, return_index=True)
        fresh = ~np.isin(unique, known)
        r, k = _bags(words, at[fresh])
        known = np.concatenate([known, unique[fresh]])
        rows.append(r), sizes.append(k)
    if not labels or not len(known):
        return np.zeros(BUCKETS), -9.0
    y = np.concatenate(labels).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    order = np.argsort(known)
    token = order[np.searchsorted(known[order], np.concatenate(tokens))].astype(np.int32)
    tokens.clear()
    fresh = np.concatenate(fresh_words)
    rows, sizes = np.concatenate(rows).astype(np.int32), np.concatenate(sizes)
    begin = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, DIMENSION)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIMENSION, 2)).astype(np.float32), np.zeros(2)
    seen_t, seen_o, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(2, 1e-8)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    n_words = np.maximum(np.diff(first), 1)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))
    sign = np.array([-1.0, 1.0])
    inverse = 1.0 / np.maximum(sizes, 1)
    for epoch in range(epochs):
        score = table @ (out[:, 1] - out[:, 0])
        word = np.add.reduceat(np.append(score[rows], 0), np.minimum(begin, len(rows))) * inverse
        word[sizes == 0] = 0
        if epoch < warm:  # whole texts first, until the worst passages mean something
            logit = np.bincount(doc, word[token] * fresh, len(y)) / n_words * 20
            share = (weight / n_words * 20)[doc] * fresh
            at, owner = token, doc
        else:
            logit, start, end = _worst(word[token] * fresh, first)
            logit = logit * PASSAGE
            k = end - start
            place = np.repeat(start - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            owner = np.repeat(np.arange(len(y)), k)
            at, share = token[place], (weight / np.maximum(k, 1) * PASSAGE)[owner] * fresh[place]
        p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -40, 40)))
        error = p - y
        # Gradients: of the two outputs with opposite signs, through words to rows.
        g_word = np.bincount(at, error[owner] * share, len(sizes)) * inverse
        used = np.flatnonzero(g_word)
        k = sizes[used]
        place = np.repeat(begin[used] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        g_row = np.bincount(rows[place], np.repeat(g_word[used], k), BUCKETS).astype(np.float32)
        hit = np.flatnonzero(g_row)
        pooled = g_row[hit] @ table[hit]
        g_out = pooled[:, None] * sign
        g_table = g_row[hit, None] * (out[:, 1] - out[:, 0])
        seen_t[hit] += (g_table**2).mean(axis=1)
        seen_o += g_out**2
        g_bias = (error * weight).sum() * sign
        seen_b += g_bias**2
        table[hit] -= 0.1 * g_table / np.sqrt(seen_t[hit])[:, None]
        out -= (0.1 * g_out / np.sqrt(seen_o)).astype(np.float32)
        bias -= 0.1 * g_bias / np.sqrt(seen_b)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64) * PASSAGE, float(bias[1] - bias[0])


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Scores per table row and bias, fitted by one task on sample (doc_id, text, label), whose rows MAX_ROWS bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, bias = fit(batches)
        yield pa.record_batch([pa.array([score.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["score", "bias"])

    ordered = sample.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text"))
    row = ordered.mapInArrow(run, "score binary, bias double").first()
    if row is None:  # no task had a row
        return fit(iter(()))
    return np.frombuffer(row["score"], np.float32), row["bias"]


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score, worst (the words of the worst passage) for each row of docs (doc_id, text).

    score is the probability that the text is toxic; a null or empty text has
    the score of no words at all. Other columns are ignored; repeated rows give
    repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, bias = shared.value
        words = Words(batch.column(1), _SEPARATORS, lower=True)
        logit, start, end = _worst(_word_scores(words, table) * _fresh(words), words.first)
        blob = words.data.tobytes()
        worst = [b" ".join(blob[x:y] for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)).decode() for a, b in zip(start, end, strict=True)]
        return pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit + bias, -30, 30)))), pa.array(worst, pa.string())], names=["doc_id", "score", "worst"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), piece, "doc_id long, score double, worst string")
