"""Substring dedup by difference-cover anchors.

A document's words are hashed in short runs, but only where the word's place
modulo PERIOD is in COVER. Two equal windows of 50 words, wherever they start,
both have such a run at one and the same offset: every difference modulo PERIOD
is one of two members of COVER. So a window can only repeat if one of its
anchors does, and only windows around repeated anchors are extended to all 50
words and traced to the first document that has them. Equal windows and equal
texts are told by two independent 64-bit hashes of every word and of their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import cut, map_texts
from textbank.llm.wordhash import WHITESPACE, Words

#: Words in a window.
WINDOW = 50
#: A perfect difference set, each non-zero difference modulo 31 once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words in an anchor. A window has PERIOD anchor places in a row.
ANCHOR = WINDOW - PERIOD + 1
#: Seed of the second hash of words, windows and texts.
_SECOND = 0x5851F42D4C957F2D


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Anchors of each text that has a window, and one row for its whole sequence of words, whose place is negative: a second hash of it."""
    words = Words(batch.column(1), WHITESPACE)
    doc_id = batch.column(0).to_numpy(zero_copy_only=False)
    at = words.run_starts(ANCHOR)
    place = at - words.first[words.doc[at]]
    chosen = np.isin(place % PERIOD, COVER) & (words.counts[words.doc[at]] >= WINDOW)
    at, place = at[chosen], place[chosen]
    long = np.flatnonzero(words.counts >= WINDOW)
    h = np.concatenate([words.runs(ANCHOR, at), words.sequence_hashes()[long]]).view(np.int64)
    doc = np.concatenate([words.doc[at], long])
    second = words.sequence_hashes(_SECOND)[long].view(np.int64)
    place = np.concatenate([place, second | np.int64(-(1 << 63))])
    return pa.record_batch([pa.array(h), pa.array(doc_id[doc].astype(np.int64)), pa.array(place)], names=["h", "doc_id", "place"])


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows around the repeated anchors (column places) of each text that is no copy (column copies)."""
    words = Words(batch.column(1), WHITESPACE)
    doc_id = batch.column(0).to_numpy(zero_copy_only=False)
    version = words.sequence_hashes().view(np.int64)
    places = batch.column(2)
    n_places = places.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), n_places)
    anchor = places.flatten().to_numpy(zero_copy_only=False) + words.first[doc]
    source = np.array([v not in c for v, c in zip(version.tolist(), batch.column(3).to_pylist(), strict=True)], dtype=bool)
    anchor, doc = anchor[source[doc]], doc[source[doc]]
    anchor, doc = anchor[anchor < words.first[doc + 1]], doc[anchor < words.first[doc + 1]]
    # A window [s, s + 50) holds the anchor [q, q + 20) if q - 30 <= s <= q.
    steps = np.zeros(len(words.hashes) + 2, np.int64)
    np.add.at(steps, np.maximum(anchor - (WINDOW - ANCHOR), words.first[doc]), 1)
    np.add.at(steps, anchor + 1, -1)
    at = np.flatnonzero(np.cumsum(steps)[: len(words.hashes)] > 0)
    at = at[at + WINDOW <= words.first[words.doc[at] + 1]]
    doc = words.doc[at]
    return pa.record_batch(
        [pa.array(words.runs(WINDOW, at).view(np.int64)), pa.array(words.runs(WINDOW, at, _SECOND).view(np.int64)), pa.array(doc_id[doc].astype(np.int64)), pa.array(version[doc]), pa.array((at - words.first[doc]).astype(np.int32))],
        names=["h", "h2", "doc_id", "version", "start"],
    )


def _remove(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text without the words that the marks of its version name: all of a copy, or 50 from each start."""
    words = Words(batch.column(1), WHITESPACE)
    version = words.sequence_hashes().view(np.int64)
    steps = np.zeros(len(words.hashes) + WINDOW + 1, np.int64)
    for d, marks in enumerate(batch.column(2).to_pylist()):
        for m in marks or ():
            if m["version"] == version[d]:
                a = words.first[d]
                at = a + np.array(m["starts"] or [], dtype=np.int64)
                ends = at + WINDOW
                if m["copy"]:
                    at, ends = np.array([a]), np.array([words.first[d + 1]])
                np.add.at(steps, at, 1)
                np.add.at(steps, ends, -1)
    gone = np.cumsum(steps)[: len(words.hashes)] > 0
    blob = words.data.tobytes()
    kept, spans = [], []
    for d in range(batch.num_rows):
        a, b = words.first[d], words.first[d + 1]
        mask = gone[a:b]
        keep = np.flatnonzero(~mask) + a
        kept.append(b" ".join([blob[x:y] for x, y in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]).decode())
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        spans.append([{"first": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2], strict=True)])
    removed = np.concatenate([[0], np.cumsum(gone)])
    n_removed = removed[words.first[1:]] - removed[words.first[:-1]]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    carried = range(3, batch.num_columns)
    return pa.record_batch([batch.column(0), pa.array(words.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.string()), pa.array(spans, kind), *(batch.column(i) for i in carried)], names=["doc_id", "n_words", "n_removed", "kept", "removed", *(batch.schema.names[i] for i in carried)])


def substring_dedup(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), removed (spans of word numbers) for each row of docs (doc_id, text).

    A word goes if a window over it also starts in a document of smaller doc_id.
    Null and empty texts, texts of fewer than 50 words and rows without an id
    lose nothing, and such rows are no source. Rows that share an id never cost
    each other words. Columns named in carry go along, other columns are ignored.
    """
    more = [docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    sound = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    anchors = map_texts(sound, _anchors, "h long, doc_id long, place long").withColumn("kind", F.least("place", F.lit(0)))
    repeated = cut(anchors.groupBy("h", "kind").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select("h", "kind", "first_doc"))
    hits = anchors.join(repeated, ["h", "kind"])
    copied = (F.col("place") < 0) & (F.col("first_doc") < F.col("doc_id"))
    suspects = cut(hits.groupBy("doc_id").agg(F.collect_set(F.when(copied, F.col("h"))).alias("copies"), F.collect_set(F.when(F.col("place") >= 0, F.col("place").cast("int"))).alias("places")))

    # A copy loses all its words, and what it has, the first of its kind has too.
    near = sound.join(suspects.where(F.size("places") > 0), "doc_id").select("doc_id", "text", "places", "copies")
    windows = map_texts(near, _windows, "h long, h2 long, doc_id long, version long, start int")
    first = cut(windows.groupBy("h", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select("h", "h2", "first_doc"))
    flagged = windows.join(first, ["h", "h2"]).where("first_doc < doc_id").groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"), F.lit(False).alias("copy"))
    copies = suspects.select("doc_id", F.explode("copies").alias("version"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    marks = cut(flagged.unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("version", "starts", "copy")).alias("marks")))
    rows = docs.join(marks, "doc_id", "left").select("doc_id", "text", "marks", *(f"carried_{i}" for i in range(len(carry))))
    kinds = "".join(f", carried_{i} {rows.schema[f'carried_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    found = map_texts(rows, _remove, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:long,end:long>>" + kinds)
    return found.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})


#: The contract's rows of op10 in DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i)
), f AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g), cov AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT win.doc_id, win.i FROM win JOIN f ON win.g = f.g WHERE f.first_doc < win.doc_id), unnest(generate_series(i, i + 49)) AS t(p)
), r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
