"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths are read off one running sum of word
hashes in numpy. Windows of equal hash are compared word by word, so a collision
cannot count as a repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textbank.llm.common import map_texts
from textbank.llm.wordhash import WHITESPACE, Words

#: n-gram length -> largest share of word characters that repeated n-grams may cover.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 8: 0.22, 10: 0.20}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"
)


def _covered(words: Words, code: np.ndarray, n: int) -> np.ndarray:
    """Per word of the batch: inside a window of n words that its document has twice or more."""
    out = np.zeros(len(code), dtype=bool)
    at = words.run_starts(n)
    if not len(at):
        return out
    h = words.runs(n, at)
    doc = words.doc[at]
    order = np.lexsort((h, doc))
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    left, right = at[order[:-1]][same], at[order[1:]][same]
    if len(left):
        offsets = np.arange(n)
        equal = (code[left[:, None] + offsets] == code[right[:, None] + offsets]).all(axis=1)
        left, right = left[equal], right[equal]
        steps = np.zeros(len(code) + 1, dtype=np.int64)
        for side in (left, right):
            hit = np.unique(side)
            steps[hit] += 1
            steps[hit + n] -= 1
        out = np.cumsum(steps[:-1]) > 0
    return out


def _per_doc(words: Words, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[words.first[1:]] - sums[words.first[:-1]]


def _score(piece: pa.RecordBatch) -> pa.RecordBatch:
    texts = piece.column(1)
    words = Words(texts, WHITESPACE)
    n_words = words.counts.astype(np.int64)
    # Code points: bytes that do not continue a UTF-8 sequence.
    heads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = heads[words.end] - heads[words.start]
    word_chars = _per_doc(words, chars)
    symbol = np.isin(words.data, np.frombuffer(SYMBOLS, np.uint8))
    signs = np.concatenate([[0], np.cumsum(symbol, dtype=np.int64)])
    n_symbols = _per_doc(words, signs[words.end] - signs[words.start])
    code = words.codes()
    repeat5 = _per_doc(words, _covered(words, code, 5))
    ngram_chars = np.stack([_per_doc(words, chars * _covered(words, code, n)) for n in NGRAM_LIMITS], axis=1) if len(texts) else np.zeros((0, len(NGRAM_LIMITS)), np.int64)
    dup_lines, line_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.encode().split(b"\n") if x.strip()]
            if len(set(lines)) < len(lines):
                seen: set[bytes] = set()
                for line in lines:
                    if line in seen:
                        dup_lines[i] += 1
                        line_chars[i] += sum(len(w.decode()) for w in line.split())
                    seen.add(line)
    failed = (n_words < 10) | (100 * repeat5 > 20 * n_words)
    bad = line_chars > LINE_LIMIT * word_chars
    for k, limit in enumerate(NGRAM_LIMITS.values()):
        bad |= ngram_chars[:, k] > limit * word_chars
    return pa.record_batch(
        [piece.column(0), *map(pa.array, (n_words, word_chars, n_symbols, dup_lines, repeat5, failed, ~failed & ~bad, line_chars)), pa.array(list(ngram_chars), pa.list_(pa.int64()))],
        names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_ngram_chars"],
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Repetition figures and a verdict per row of docs (doc_id, text).

    A null or empty text has no words and fails the base rules. Every row gives
    one row, repeated ids too. Other columns are ignored.
    """
    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), _score, SCHEMA)


def _sql() -> str:
    limits = " AND ".join(f"coalesce(max(a.chars) FILTER (a.n = {n}), 0) <= CAST({limit} AS DOUBLE) * any_value(length(array_to_string(d.w, '')))" for n, limit in NGRAM_LIMITS.items())
    lengths = ", ".join(f"({n})" for n in NGRAM_LIMITS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (VALUES {lengths}) AS t(n), unnest(generate_series(1, len(w) - n + 1)) AS u(i)
), cov AS (
  SELECT DISTINCT doc_id, n, p FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM win), unnest(generate_series(i, i + n - 1)) AS v(p) WHERE c > 1
), a AS (SELECT doc_id, n, count(*) AS k, sum(length(w[p])) AS chars FROM cov JOIN d USING (doc_id) GROUP BY 1, 2), l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dl AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM l WHERE r > 1 GROUP BY 1),
s AS (
  SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, CAST(any_value(length(array_to_string(d.w, ''))) AS BIGINT) AS word_chars, CAST(any_value(len(regexp_extract_all(d.text, '[#*$%&|<>]'))) AS BIGINT) AS n_symbols,
    CAST(coalesce(any_value(dl.n), 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(max(a.k) FILTER (a.n = 5), 0) AS BIGINT) AS n_repeat_words,
    coalesce(any_value(dl.chars), 0) <= CAST({LINE_LIMIT} AS DOUBLE) * any_value(length(array_to_string(d.w, ''))) AND {limits} AS fine
  FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN dl ON dl.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND fine AS kept FROM s
"""


#: The contract's rows of op5 in DuckDB SQL.
SQL = _sql()
