"""Byte-level BPE encoding and decoding with a given table of ranks.

Each pre-token (a match of the split pattern) is merged on its own. A segment
tree over its byte positions holds, in each leaf, the rank of the pair that
starts there, and in its root the leftmost pair of least rank. A merge changes
the leaves of the pair, of its dead right half and of the live neighbour on the
left, so it costs three point updates of logarithmic length. Short pre-tokens
are merged many at a time, one row of a numpy tree each; long ones one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import map_texts

#: Widths of the numpy trees; a longer pre-token gets a tree of its own.
WIDTHS = (4, 8, 16, 32, 64)
#: Distinct strings whose ids a worker keeps; beyond it the worker starts afresh.
KEPT_PIECES = 150_000
_BEFORE_SPACE = regex.compile(r"(?s) ?[^ ]+| ").findall
_TWO_SPACES = regex.compile(r"\s\s").search
#: Pre-tokens merged at once, few enough that their trees stay in a processor's cache.
ROWS = 2048
_NONE = np.int32(1 << 24)


class Tokens:
    """The bytes of each id of a rank table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            token[r] = t
        self.lengths = np.array([len(t) for t in token], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.blob = np.frombuffer(b"".join(token), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, end to end."""
        n = self.lengths[ids]
        at = np.repeat(self.ends[ids] - np.cumsum(n), n) + np.arange(int(n.sum()))
        return self.blob[at]


class Ranks(Tokens):
    """A rank table with the id of each pair of tokens that may merge."""

    def __init__(self, path: str):
        super().__init__(path)
        pairs: dict[tuple[int, int], int] = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        self.pairs = pairs
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        # An open hash table of the pairs for numpy.
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self._mask = np.int64(size - 1)
        self._keys, self._ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        keys = np.array([a << 24 | b for a, b in pairs], dtype=np.int64)
        ranks = np.array(list(pairs.values()), dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] < 0
            self._keys[slot[free]] = keys[free]
            placed = self._keys[slot] == keys
            self._ranks[slot[placed]] = ranks[placed]
            keys, ranks, slot = keys[~placed], ranks[~placed], (slot[~placed] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(35)) & self._mask

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NONE where it does not merge."""
        keys = a.astype(np.int64) << np.int64(24) | b
        slot = self._slot(keys)
        held = self._keys[slot]
        while (open_ := np.flatnonzero((held != keys) & (held >= 0))).size:
            slot[open_] = (slot[open_] + 1) & self._mask
            held[open_] = self._keys[slot[open_]]
        return self._ranks[slot]


@lru_cache(maxsize=4)
def tokens(path: str) -> Tokens:
    return Tokens(path)


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    return Ranks(path)


def merge_one(ranks: Ranks, piece: bytes) -> list[int]:
    """Ids of one pre-token of any length, by a tree in a list."""
    n = len(piece)
    width = 1 << max(0, n - 1).bit_length()
    none = (1 << 62, 0)
    ids = [int(ranks.byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    get = ranks.pairs.get
    for i in range(n - 1):
        if (r := get((ids[i], ids[i + 1]))) is not None:
            tree[width + i] = (r, i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, leaf: tuple[int, int]) -> None:
        k = width + i
        tree[k] = leaf
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] != none:
        r, i = tree[1]
        j = after[i]
        k = after[j]
        ids[i], ids[j], after[i] = r, -1, k
        put(j, none)
        if k < n:
            before[k] = i
            s = get((r, ids[k]))
            put(i, none if s is None else (s, i))
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            s = get((ids[h], r))
            put(h, none if s is None else (s, h))
    return [x for x in ids if x >= 0]


def merge_many(ranks: Ranks, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens of at most `width` bytes, end to end, and their number for each."""
    done = [_merge_rows(ranks, pieces[i : i + ROWS], width) for i in range(0, len(pieces), ROWS)]
    return (np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])) if done else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _merge_rows(ranks: Ranks, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, rows)
    column = np.arange(width)
    live = column < lengths[:, None]
    ids = np.full((rows, width), -1, np.int32)
    ids[live] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    # Each row has one spare column on either side, so that a missing neighbour needs no test: its id is -1 and forms no pair.
    span = width + 2
    own = np.full((rows, span), -1, np.int32)
    own[:, 1:-1] = ids
    after = np.tile(np.minimum(np.arange(span) + 1, span - 1), (rows, 1))
    after[np.arange(rows), lengths] = span - 1
    before = np.tile(np.maximum(np.arange(span) - 1, 0), (rows, 1))
    # A leaf holds rank * width + position, so that the least is the leftmost of least rank.
    none = np.int32(int(_NONE) * width)
    tree = np.full((rows, 2 * width), none, np.int32)
    two = live[:, 1:]
    leaf = ranks.pair(ids[:, :-1][two], ids[:, 1:][two])
    tree[:, width : 2 * width - 1][two] = np.minimum(leaf * np.int32(width) + np.broadcast_to(column[:-1].astype(np.int32), two.shape)[two], none)
    k = width // 2
    while k:
        np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
        k //= 2
    flat_ids, flat_after, flat_before, flat_tree = own.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
    active = np.arange(rows)
    while True:
        root = tree[active, 1]
        going = root < none
        active, root = active[going], root[going]
        if not len(active):
            break
        base, node = active * span, active * (2 * width)
        i, r = root % width + 1, root // width
        j = flat_after[base + i]
        k = flat_after[base + j]
        h = flat_before[base + i]
        flat_ids[base + i] = r
        flat_ids[base + j] = -1
        flat_after[base + i] = k
        flat_before[base + k] = i
        spare = flat_ids[base + k]
        pairs = ranks.pair(np.concatenate([r, flat_ids[base + h]]), np.concatenate([spare, r]))
        n = len(active)
        leaf_at = np.concatenate([i, np.maximum(h, 1), j]) - 1
        leaf = np.full(3 * n, none, np.int32)
        leaf[: 2 * n] = np.minimum(pairs * np.int32(width) + leaf_at[: 2 * n].astype(np.int32), none)
        node = np.concatenate([node, node, node])
        level = width + leaf_at
        # A row without a left neighbour has h = 0; its second update repeats the first.
        first = np.flatnonzero(h == 0)
        level[n + first], leaf[n + first] = level[first], leaf[first]
        flat_tree[node + level] = leaf
        size = width
        while size > 1:
            level >>= 1
            size >>= 1
            child = node + 2 * level
            flat_tree[node + level] = np.minimum(flat_tree[child], flat_tree[child + 1])
    own = own[:, 1:-1]
    kept = own >= 0
    return own[kept], kept.sum(axis=1)


class Known:
    """Ids of strings met before: a code for each string; first and count place its ids in flat."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.code)
        while n + len(keys) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(keys)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(keys)] = counts
        self.used += len(ids)
        self.code.update(zip(keys, range(n, n + len(keys)), strict=True))

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes, end to end, and their number for each."""
        n = self.count[codes]
        total = np.cumsum(n)
        at = np.repeat(self.first[codes] - (total - n), n) + np.arange(int(n.sum()))
        return self.flat[at], n


class Encoder:
    """Ids of texts; keeps what it has met, up to KEPT_PIECES strings of either kind.

    A text is cut before each space, which a match of the pattern never crosses
    as long as no white space stands before it; a chunk met before needs no
    further work. A text where two white-space characters meet is matched whole.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pieces, self.chunks = Known(), Known()

    def _merge(self, pieces: list[str]) -> None:
        """Adds pre-tokens that are not known yet."""
        raw = [p.encode() for p in pieces]
        groups: dict[int, list[int]] = {w: [] for w in (1, *WIDTHS, 0)}
        for i, b in enumerate(raw):
            groups[1 if b in self.ranks.rank else next((w for w in WIDTHS if len(b) <= w), 0)].append(i)
        for width, members in groups.items():
            own = [raw[i] for i in members]
            if width == 1:
                ids, n = np.array([self.ranks.rank[b] for b in own], np.int64), np.ones(len(own), np.int64)
            elif width:
                ids, n = merge_many(self.ranks, own, width) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            else:
                each = [merge_one(self.ranks, b) for b in own]
                ids, n = np.array([x for e in each for x in e], np.int64), np.array([len(e) for e in each], np.int64)
            self.pieces.add([pieces[i] for i in members], ids, n)

    def _pieces(self, found: list[str]) -> np.ndarray:
        fresh = list({p for p in found if p not in self.pieces.code})
        if len(fresh) + len(self.pieces.code) > KEPT_PIECES and self.pieces.code:
            self.pieces = Known()
            fresh = list(set(found))
        self._merge(fresh)
        return np.array([self.pieces.code[p] for p in found], dtype=np.int64)

    def piece_counts(self, found: list[str]) -> np.ndarray:
        """Number of ids of each pre-token."""
        codes = self._pieces(found)
        return self.pieces.count[codes]

    def _matched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by the pattern, end to end, and their number for each."""
        found: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            found += self.find(text)
            ends[i + 1] = len(found)
        codes = self._pieces(found)  # may start self.pieces afresh
        ids, n = self.pieces.ids(codes)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[ends])

    def chunked(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[int]]:
        """Chunks of all texts that may be cut before spaces, where each text's end, and the texts that must be matched whole."""
        chunks: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        whole = []
        for i, text in enumerate(texts):
            if text and _TWO_SPACES(text):
                whole.append(i)
            elif text:
                chunks += text.replace(" ", "\0 ").split("\0") if "\0" not in text else _BEFORE_SPACE(text)
            ends[i + 1] = len(chunks)
        return chunks, ends, whole

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and their number for each; a null text has none."""
        chunks, ends, whole = self.chunked(texts)
        fresh = list({c for c in chunks if c not in self.chunks.code})
        if len(fresh) + len(self.chunks.code) > KEPT_PIECES and self.chunks.code:
            self.chunks = Known()
            fresh = list(set(chunks))
        self.chunks.add(fresh, *self._matched(fresh))
        code = self.chunks.code
        ids, n = self.chunks.ids(np.array([code[c] for c in chunks], dtype=np.int64))
        counts = np.diff(np.concatenate([[0], np.cumsum(n)])[ends])
        if whole:
            more, m = self._matched([texts[i] for i in whole])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            extra = np.concatenate([[0], np.cumsum(m)])
            place = {i: more[extra[k] : extra[k + 1]] for k, i in enumerate(whole)}
            ids = np.concatenate([place.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))])
            counts[whole] = m
        return ids, counts


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load(path), pattern)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs (doc_id, text).

    path names a file of base64 tokens and ranks that executors can read; pattern
    splits the text. No special token is added or recognised. A null or empty
    text has an empty array. Repeated rows give repeated rows.
    """

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path, pattern).encode(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), lists(ids, counts)], names=["doc_id", "ids"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), piece, "doc_id long, ids array<int>")


def _decoded(table: Tokens, ids: np.ndarray, counts: np.ndarray, nulls: list[bool] | None = None) -> pa.Array:
    """The bytes of each list of ids."""
    body = table.decode(ids).tobytes()
    sizes = np.concatenate([[0], np.cumsum(table.lengths[ids])])
    ends = sizes[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return pa.array([None if nulls and nulls[i] else body[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))], pa.binary())


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode and decode in one pass, so that a task needs one Python worker and not two: doc_id, ids, decoded."""

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path, pattern).encode(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), lists(ids, counts), _decoded(load(path), ids, counts)], names=["doc_id", "ids", "decoded"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), piece, "doc_id long, ids array<int>, decoded binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with a column decoded: the bytes of its ids (empty for none, null for null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for start in range(0, batch.num_rows, 512):
                part = column.slice(start, 512)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([batch.column(0).slice(start, 512), part, _decoded(tokens(path), ids, counts, part.is_null().to_pylist())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
