"""Words of a batch of texts as numpy arrays, without a Python loop over words.

A batch's texts lie in one UTF-8 buffer. Words are the runs of bytes outside a
separator set; each gets a 64-bit hash of its bytes, taken eight at a time. A run
of k words gets one by doubling: hashes of two neighbouring runs are combined to
that of the longer one. Every step scrambles, so no arrangement of few different
bytes or words cancels out, as it does in sums of powers modulo 2**64. Another
seed gives another hash of words and runs, and both together 128 bits. Equal
words and runs have equal hashes everywhere, in any process.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space and \x09-\x0D.
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: A word of more bytes is hashed by itself.
LONG_WORD = 256
_EIGHT = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEFT = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a stands for, followed by what b stands for."""
    return mix(a * _LEFT + b)


def fold(h: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each group h[first[i]:first[i + 1]], of its members in order and their number."""
    counts = np.diff(first)
    out = mix(counts.astype(np.uint64) ^ np.uint64(seed))
    filled = np.flatnonzero(counts)
    h = mix(h ^ np.uint64(seed))
    group = np.repeat(np.arange(len(filled)), counts[filled])
    left = counts[filled]
    while len(h) > len(filled):
        # Neighbours join in pairs; the last of an odd number waits for the next round.
        begin = np.cumsum(left) - left
        place = np.arange(len(h)) - begin[group]
        heads = np.flatnonzero(place % 2 == 0)
        paired = place[heads] + 1 < left[group[heads]]
        new = h[heads]
        new[paired] = join(new[paired], h[heads[paired] + 1])
        h, group, left = new, group[heads], (left + 1) // 2
    out[filled] = join(out[filled], h)
    return out


class Words:
    """Words of a batch of documents.

    doc: document index of each word; first: index of each document's first
    word, with the total at the end; start, end: byte range of each word in data;
    is_word: per byte of data; hashes: uint64 per word.
    """

    def __init__(self, texts: pa.Array, separators: bytes = WHITESPACE, lower: bool = False):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        lo, hi = int(offsets[0]), int(offsets[-1])
        body = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        if texts.null_count:
            lengths = np.where(np.asarray(texts.is_null()), 0, lengths)
            assert int(lengths.sum()) == hi - lo, "a null text holds bytes"
        table = np.arange(256, dtype=np.uint8)
        if lower:
            table[0x41:0x5B] += 0x20
        inside = np.ones(256, dtype=bool)
        inside[np.frombuffer(separators, np.uint8)] = False
        # One separator before each document keeps words of neighbours apart.
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = np.full(int(at[-1]) + 1, separators[0], dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[at] = False
        data[keep] = table[body]
        is_word = inside[data]
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        self.data, self.is_word, self.start, self.end = data, is_word, edge[0::2], edge[1::2]
        self.n_docs = n
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.counts = np.diff(self.first)
        self._levels: dict[tuple[int, int], np.ndarray] = {}

    @property
    def hashes(self) -> np.ndarray:
        return self.word_hashes()

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """uint64 hash of each word's bytes."""
        have = self._levels.get((seed, 1))
        if have is not None:
            return have
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data), "<u8", padded, strides=(1,))
        h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 ^ seed))
        at = np.arange(len(length))
        for k in range(0, LONG_WORD, 8):
            at = at[length[at] > k]
            if not len(at):
                break
            short = np.minimum(length[at] - k, 8).astype(np.uint64)
            h[at] = join(h[at], eight[self.start[at] + k] & (_EIGHT >> (np.uint64(64) - short * np.uint64(8))))
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
            h[i] = int.from_bytes(digest.digest(), "little")
        self._levels[seed, 1] = h
        return h

    def codes(self) -> np.ndarray:
        """A number per word that is equal for equal words of the batch, by their bytes and not by their hash."""
        blob = self.data.tobytes()
        table: dict[bytes, int] = {}
        return np.fromiter((table.setdefault(blob[a:b], len(table)) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)), dtype=np.int64, count=len(self.start))

    def _doubled(self, k: int, seed: int) -> np.ndarray:
        """Hashes of the k words from every index that has as many after it in the batch; k is a power of two."""
        if (seed, k) not in self._levels:
            half = self._doubled(k // 2, seed) if k > 2 else self.word_hashes(seed)
            self._levels[seed, k] = join(half[: max(0, len(half) - k // 2)], half[k // 2 :])
        return self._levels[seed, k]

    def runs(self, k: int, at: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """uint64 hash of the k words from each index in `at` (default: from every index that has k words after it in the batch)."""
        at = np.arange(max(0, len(self.start) - k + 1)) if at is None else at
        out, place = None, 0
        for bit in range(k.bit_length() - 1, -1, -1):
            if k >> bit & 1:
                part = (self._doubled(1 << bit, seed) if bit else self.word_hashes(seed))[at + place]
                out = part if out is None else join(out, part)
                place += 1 << bit
        return out

    def run_starts(self, k: int) -> np.ndarray:
        """Indices from which k words of one document follow."""
        i = np.arange(len(self.hashes))
        return i[i + k <= self.first[self.doc + 1]]

    def sequence_hashes(self, seed: int = 0) -> np.ndarray:
        """uint64 per document, of its whole sequence of words."""
        return fold(self.word_hashes(seed), self.first, seed)
