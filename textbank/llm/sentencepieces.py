"""SentencePiece encoding and decoding with a given pair-merging model.

A text is marked: its spaces become whitespace markers, and one more stands
before it. No piece of such a model holds a marker behind another character, so
no merge crosses from a word into the marker behind it, and each marked word
(markers and what follows up to the next marker, or to a control character that
no piece joins to another) is segmented on its own. A task
keeps a table of the distinct marked words it has met, segments each of them
once, and joins the ids back by position in numpy. The table is bounded: a task
that has met KEPT_CHUNKS words starts a new one, so vocabulary and corpus may
grow and the task's memory does not. No rows are shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbank.llm.bpe import Known, lists
from textbank.llm.common import BATCH_ROWS, map_texts

MARK = "▁"
#: Distinct marked words whose ids a task keeps, and their characters; beyond either the task starts afresh.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 1 << 23
#: Characters up to which a marked word's pairs stand in a list; those of a longer one stand in a heap.
SHORT = 48


class Pieces:
    """Pieces, scores and special ids of a model file.

    Models with user-defined or unused pieces, with a normalisation table or
    with another treatment of whitespace than a marker put in front are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind, trained = model.normalizer_spec, model.SentencePiece, model.trainer_spec
        if trained.model_type != trained.BPE or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: only pair-merging models without user-defined and unused pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or trained.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only models that keep the text and put a marker in front are supported")
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        # Pieces of equal score merge from the left, so that they share a rank.
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in self.id.values()}, reverse=True))}
        self.rank = {p: order[model.pieces[i].score] for p, i in self.id.items()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.bos, self.eos = (next(i for i, p in enumerate(model.pieces) if p.piece == name) for name in (trained.bos_piece, trained.eos_piece))
        #: Whether marked words can be segmented on their own.
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.id)
        joined = {c for p in self.id if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in map(chr, range(32)) if c not in joined))
        self.chunks = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        token = [p.piece.replace(MARK, " ").encode() if p.type == kind.NORMAL else b"" for p in model.pieces]
        token[self.unknown] = trained.unk_surface.encode()
        for b, i in self.byte.items():
            token[i] = bytes([b])
        self.token, self.marked = token, np.array([p.type == kind.NORMAL and p.piece.startswith(MARK) for p in model.pieces])
        self.is_byte, self.is_control = np.zeros(len(token), bool), np.array([p.type == kind.CONTROL for p in model.pieces])
        self.is_byte[list(self.byte.values())] = True
        self.lengths = np.array([len(t) for t in token], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.blob = np.frombuffer(b"".join(token), np.uint8)

    def _merged(self, parts: list[str]) -> list[str]:
        """parts after all merges, for few of them: the best of all pairs is looked up in a list."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """parts after all merges, by a heap of pairs; a part that is gone is empty."""
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # A pair whose parts have changed since is longer now, or its left part is gone.
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return parts

    def segment(self, chunk: str) -> list[int]:
        """Ids of one marked word: the pair of the best piece merges first, the leftmost of equal ones."""
        parts = self._merged(list(chunk)) if len(chunk) <= SHORT else self._merged_long(list(chunk))
        out: list[int] = []
        for p in parts:
            if p:
                own = self.id.get(p)
                if own is not None:
                    out.append(own)
                elif self.byte:
                    out += [self.byte[b] for b in p.encode()]
                else:
                    out.append(self.unknown)
        return out

    def decode_one(self, ids: list[int]) -> str:
        """Text of any ids: control ids are silent, a run of byte ids is read as UTF-8, and the marker in front goes."""
        out: list[str] = []
        run = bytearray()
        front = True  # no text and no marker in front so far
        for x in ids:
            if self.is_byte[x]:
                run += self.token[x]
                continue
            if run:
                out.append(lenient(run))
                run = bytearray()
                front = False
            if self.is_control[x]:
                continue
            text = self.token[x].decode()
            if front and self.marked[x]:
                text = text[1:]
            out.append(text)
            front = False
        return "".join(out) + lenient(run)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Text of each list of ids, end to end in ids; lists whose control ids stand at their ends only are read at once."""
        n = self.lengths[ids]
        at = np.repeat(self.ends[ids] - np.cumsum(n), n) + np.arange(int(n.sum()))
        body, sizes = self.blob[at].tobytes(), np.concatenate([[0], np.cumsum(n)])
        out = []
        end = 0
        for c in counts.tolist():
            start, end = end, end + c
            first, last = start + (c > 0 and ids[start] == self.bos), end - (c > 0 and ids[end - 1] == self.eos)
            text = None
            if first < last and not (self.is_control[ids[first:last]].any() or self.is_byte[ids[first]]):
                try:
                    text = body[sizes[first] + bool(self.marked[ids[first]]) : sizes[last]].decode()
                except UnicodeDecodeError:
                    pass
            out.append(self.decode_one(ids[start:end].tolist()) if text is None else text)
        return out


def lenient(raw: bytes | bytearray) -> str:
    """raw as UTF-8; each byte that begins no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + n]).decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Ids of texts by a table of distinct marked words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known, self.chars = pieces, Known(), 0

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.pieces.chunks(marked) if self.pieces.apart else [marked]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, end to end, and their number for each; a null text counts as empty."""
        found: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            found += self.chunks(text)
            ends[i + 1] = len(found)
        fresh = list({c for c in found if c not in self.known.code})
        if self.known.code and (len(fresh) + len(self.known.code) > KEPT_CHUNKS or self.chars > KEPT_CHARS):
            self.known, self.chars = Known(), 0
            fresh = list(set(found))
        self.chars += sum(map(len, fresh))
        new = [self.pieces.segment(c) for c in fresh]
        self.known.add(fresh, np.array([x for ids in new for x in ids], np.int32), np.array([len(x) for x in new], np.int64))
        code = self.known.code
        ids, n = self.known.ids(np.array([code[c] for c in found], np.int64))
        bounds = np.concatenate([[0], np.cumsum(n)])[ends]
        counts = np.diff(bounds) + 2
        out = np.empty(len(ids) + 2 * len(texts), np.int32)
        last = np.cumsum(counts)
        inner = np.ones(len(out), bool)
        inner[last - 1] = inner[last - counts] = False
        out[inner], out[last - counts], out[last - 1] = ids, self.pieces.bos, self.pieces.eos
        return out, counts


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int, with begin and end ids) for each row of docs (doc_id, text).

    path names a model file that executors can read. A null or empty text has
    the begin and the end id only. Other columns are ignored, repeated rows give
    repeated rows, an empty table gives none.
    """

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), lists(*encoder(path).encode(batch.column(1).to_pylist()))], names=["doc_id", "ids"])

    return map_texts(_texts(docs), piece, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with a column decoded: the text of its ids ('' for none, null for null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(start, BATCH_ROWS)
                part = rows.column(1)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = load(path).decode(ids, part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                nulls = part.is_null().to_pylist()
                yield pa.record_batch([rows.column(0), part, pa.array([None if gone else t for t, gone in zip(texts, nulls, strict=True)], pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode and decode in one pass: doc_id, n_tokens, packed, decoded.

    packed has the ids as training files have them, little-endian unsigned 32-bit
    integers end to end. Odd rows are treated as by encode.
    """

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path).encode(batch.column(1).to_pylist())
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
        packed = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.record_batch([batch.column(0), pa.array(counts), packed, pa.array(load(path).decode(ids, counts), pa.string())], names=["doc_id", "n_tokens", "packed", "decoded"])

    return map_texts(_texts(docs), piece, "doc_id long, n_tokens long, packed binary, decoded string")
