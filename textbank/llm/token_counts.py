"""Edit-aware token counts.

A document's pre-tokens lie in the leaves of a segment tree that sums characters
and tokens. An edit finds its place by descending the tree, matches the pattern
anew from the last boundary that the edit cannot move to the first old boundary
it meets again behind the edit, counts the tokens of only those pre-tokens, and
updates the sums above them. The pre-tokens of all texts of a slice are counted
together before their trees are built.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbank.llm.bpe import KEPT_PIECES, Encoder, Known, encoder, merge_one
from textbank.llm.common import map_texts

EDIT = "array<struct<start:int,length:int,replacement:string>>"
#: Characters behind a match that may have decided it, so that it depends on no edit beyond them.
AHEAD = 2
#: Pre-tokens that a leaf holds on average before more leaves share them.
FULL = 4


class Counter:
    """Lengths in characters and in tokens of the pre-tokens of texts, for whole slices at once."""

    def __init__(self, coder: Encoder):
        self.coder, self.known = coder, Known()

    def _matched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of lengths, end to end, and how many numbers each text has there."""
        found: list[str] = []
        ends = [0]
        for text in texts:
            found += self.coder.find(text)
            ends.append(len(found))
        pairs = np.empty((len(found), 2), np.int32)
        pairs[:, 0] = np.fromiter(map(len, found), np.int32, len(found))
        pairs[:, 1] = self.coder.piece_counts(found)
        return pairs.reshape(-1), 2 * np.diff(ends)

    def sizes(self, texts: list[str]) -> list[np.ndarray]:
        """For each text an array of (characters, tokens) of its pre-tokens."""
        chunks, ends, whole = self.coder.chunked(texts)
        fresh = list({c for c in chunks if c not in self.known.code})
        if len(fresh) + len(self.known.code) > KEPT_PIECES and self.known.code:
            self.known = Known()
            fresh = list(set(chunks))
        self.known.add(fresh, *self._matched(fresh))
        code = self.known.code
        pairs, n = self.known.ids(np.array([code[c] for c in chunks], dtype=np.int64))
        at = np.concatenate([[0], np.cumsum(n)])[ends]
        out = [pairs[a:b].reshape(-1, 2) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if whole:
            pairs, n = self._matched([texts[i] for i in whole])
            end = np.cumsum(n).tolist()
            for i, a, b in zip(whole, [0, *end], end, strict=False):
                out[i] = pairs[a:b].reshape(-1, 2)
        return out

    def tokens(self, piece: str) -> int:
        """Number of ids of one pre-token."""
        code = self.coder.pieces.code.get(piece)
        if code is not None:
            return int(self.coder.pieces.count[code])
        raw = piece.encode()
        return 1 if raw in self.coder.ranks.rank else len(merge_one(self.coder.ranks, raw))


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(encoder(path, pattern))


class CountedText:
    """A text with its token count, kept up to date under edits."""

    def __init__(self, text: str, count: Counter, sizes: np.ndarray | None = None):
        self.text, self.count, self.reencoded = text, count, 0
        self._build(count.sizes([text])[0] if sizes is None else sizes)

    def _build(self, sizes: np.ndarray) -> None:
        """The tree over pre-tokens of these sizes, one a leaf."""
        n = len(sizes)
        self.width = 1 << max(0, n - 1).bit_length()
        #: (characters, tokens) of the pre-tokens of leaves that hold several.
        self.several: dict[int, list[tuple[int, int]]] = {}
        sums = np.zeros((2 * self.width, 2), np.int64)
        sums[self.width : self.width + n] = sizes
        k = self.width // 2
        while k:
            np.add(sums[2 * k : 4 * k : 2], sums[2 * k + 1 : 4 * k : 2], out=sums[k : 2 * k])
            k //= 2
        self.chars, self.tokens = sums[:, 0].tolist(), sums[:, 1].tolist()

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at `at`, or the last with any, and the character it starts with."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if before + self.chars[k] <= at and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.width, before

    def _held(self, first: int, end: int) -> list[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens of these leaves, in order."""
        out: list[tuple[int, int]] = []
        for leaf in range(first, end):
            if leaf in self.several:
                out += self.several[leaf]
            elif self.chars[self.width + leaf]:
                out.append((self.chars[self.width + leaf], self.tokens[self.width + leaf]))
        return out

    def _put(self, first: int, end: int, sizes: list[tuple[int, int]]) -> None:
        """Gives these leaves the pre-tokens; if they are too many, leaves around share them, and beyond that the tree grows."""
        while len(sizes) > FULL * (end - first):
            if end - first == self.width:
                self._build(np.array(sizes, np.int64))
                return
            block = 2
            while first // block * block + block < end or block <= end - first:
                block *= 2
            lower = first // block * block
            sizes = [*self._held(lower, first), *sizes, *self._held(end, lower + block)]
            first, end = lower, lower + block
        share = -(-len(sizes) // (end - first))
        for i, leaf in enumerate(range(first, end)):
            own = sizes[i * share : (i + 1) * share]
            self.several.pop(leaf, None)
            if len(own) > 1:
                self.several[leaf] = own
            self.chars[self.width + leaf] = sum(c for c, _ in own)
            self.tokens[self.width + leaf] = sum(t for _, t in own)
        a, b = (self.width + first) // 2, (self.width + end - 1) // 2
        while a:
            for k in range(a, b + 1):
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            a, b = a // 2, b // 2

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces `length` characters from `start`, both cut to the text."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        length = min(max(length, 0), total - start)
        # A match that ends AHEAD characters or more before the edit saw nothing of it.
        first, begin = self._leaf(max(start - AHEAD, 0))
        last, stop = self._leaf(start + length)
        end, stop = last + 1, stop + self.chars[self.width + last]
        old = self._held(first, end)
        tail, shift = start + length, len(replacement) - length
        self.text = self.text[:start] + replacement + self.text[tail:]
        more = 1
        while True:
            window = self.text[begin : stop + shift]
            # Old boundaries behind the edit, in the window's places; matching may stop at one.
            places = np.cumsum([c for c, _ in old]) + begin
            boundaries = {p - begin + shift: i + 1 for i, p in enumerate(places.tolist()) if p >= tail}
            done: list[tuple[int, int]] = []
            used, rest = 0, None
            for piece in self.count.coder.find(window):
                done.append((len(piece), self.count.tokens(piece)))
                used += len(piece)
                # What the window's end may have decided is not settled.
                if used in boundaries and used + AHEAD <= len(window):
                    rest = old[boundaries[used] :]
                    break
            if rest is not None or stop >= total:
                break
            while more and end < self.width:
                stop += self.chars[self.width + end]
                old += self._held(end, end + 1)
                end += 1
                more -= 1
            more = end - first
        self.reencoded += len(done)
        self._put(first, end, done + (rest or []))


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_before, n_tokens, n_pieces, n_reencoded, edited for each row of docs (doc_id, text, edits).

    edits is an array of (start, length, replacement) in characters, applied in
    order, each to the text that the ones before it left; null means none, and a
    null edit or field counts as 0 or the empty string. n_before and n_tokens count
    tokens before and after, n_pieces the pre-tokens of the text before and
    n_reencoded those matched again; edited is the text after the edits. A null
    text is empty. Repeated rows give repeated rows, other columns are ignored.
    The pattern must match every character and decide a match by at most AHEAD
    characters behind it.
    """

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path, pattern)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        before, after, pieces, again, edited = [], [], [], [], []
        for text, edits, sizes in zip(texts, batch.column(2).to_pylist(), count.sizes(texts), strict=True):
            counted = CountedText(text, count, sizes)
            before.append(counted.n_tokens)
            pieces.append(len(sizes))
            for e in edits or ():
                if e:
                    counted.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            after.append(counted.n_tokens)
            again.append(counted.reencoded)
            edited.append(counted.text)
        long = pa.int64()
        return pa.record_batch([batch.column(0), pa.array(before, long), pa.array(after, long), pa.array(pieces, long), pa.array(again, long), pa.array(edited, pa.string())], names=["doc_id", "n_before", "n_tokens", "n_pieces", "n_reencoded", "edited"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDIT).alias("edits"))
    return map_texts(rows, piece, "doc_id long, n_before long, n_tokens long, n_pieces long, n_reencoded long, edited string")
