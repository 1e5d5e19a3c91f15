"""Divergence of sources within a language, by smoothed term shares in exact integers.

Texts are read once: tasks count terms by language and source and hand on what
they have counted whenever it grows large, so that Spark shuffles counts and not
words. Terms of a language get ids in blocks of about BLOCK_TERMS by a hash.
Within a block each source is two sorted arrays, term ids and counts. Sources
are dealt into groups of about BLOCK_SOURCES, and a task holds the arrays of two
such groups in one block of terms, whatever the size of vocabulary, source or
corpus. There every unordered pair of sources meets once: a galloping search
intersects the two arrays, and the overlap, the terms of either side alone and
their number price the pair in both directions; terms that neither has cost the
same each and are counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbank.llm.common import cut, small

UNIT = 1_000_000_000
MIN_DOCS, MAX_RANK = 3, 200
#: Terms of a block, sources of a group; a task holds at most about 2 * BLOCK_SOURCES arrays of BLOCK_TERMS.
BLOCK_TERMS, BLOCK_SOURCES = 4096, 32
#: Counts that a task gathers before it hands them on.
KEPT_COUNTS = 800_000
#: Parts of a group whose terms are ranked apart before they are ranked together.
RANK_PARTS = 32
#: Ids of the shorter array that are looked up at once.
PIECE = 256
# The term pattern on UTF-8: bytes from 0x80 on belong to characters from 0x80 on.
_TERMS = re.compile(rb"[a-z\x80-\xff]+").findall
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, lang_n, docs and own, the source and n of each source with the term: occurrences in the language and in a source, and documents with it; nulls are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}
        most = 0  # at least as many as are kept

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                in_docs = held[lang, source]
                terms = list(own)
                for i in range(0, len(terms), 20_000):
                    part = terms[i : i + 20_000]
                    yield pa.record_batch(
                        [
                            pa.array([lang] * len(part), pa.string()),
                            pa.array([source] * len(part), pa.string()),
                            pa.array([t.decode() for t in part], pa.string()),
                            pa.array([own[t] for t in part], pa.int64()),
                            pa.array([in_docs[t] for t in part], pa.int64()),
                        ],
                        names=["lang", "source", "term", "n", "docs"],
                    )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = _TERMS(text.translate(_LOWER))
                once = set(found)
                n.setdefault((lang, source), Counter()).update(found)
                held.setdefault((lang, source), Counter()).update(once)
                most += len(once)
                if most > KEPT_COUNTS:
                    most = sum(map(len, n.values()))
                    if most > KEPT_COUNTS // 2:
                        yield from counted()
                        n, held, most = {}, {}, 0
        yield from counted()

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = docs.select(plain("lang"), plain("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # Tasks have added up what they can; dealt by language and term once, both sums need no other shuffle.
    each = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return each.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("own"))


def share(n: Column, all_: Column) -> Column:
    """1 + floor(UNIT * n / all_) for n <= all_ < 9 * 10^15, in longs, three digits at a time; null if all_ is 0."""
    by = F.nullif(all_, F.lit(0))
    div = lambda a: F.call_function("div", a, by)
    whole, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        whole, rest = whole * 1000 + div(rest * 1000), (rest * 1000) % by
    return whole + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, all_: int) -> np.ndarray:
    """share, for an array."""
    whole, rest = np.zeros(len(n), np.int64), n.astype(np.int64)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // all_
        rest %= all_
    return whole + 1


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Place in long, at or behind which each id of short would stand; both are sorted.

    The ids of short go in pieces; for each the window in long doubles from where
    the last piece ended until it reaches the piece's last id.
    """
    out, start = np.empty(len(short), np.int64), 0
    for i in range(0, len(short), PIECE):
        piece = short[i : i + PIECE]
        step = end = PIECE
        end += start
        while end < len(long) and long[end - 1] < piece[-1]:
            step *= 2
            end += step
        out[i : i + PIECE] = start + np.searchsorted(long[start:end], piece)
        start = int(out[min(i + PIECE, len(short)) - 1])
    return out


def priced(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int, int]:
    """Sums of a against b and of b against a over the terms that either has, and the number of these terms.

    Each is (sorted term ids, counts, all counts plus the number of terms).
    """
    swapped = len(a[0]) > len(b[0])
    (ids_a, p, all_p), (ids_b, q, all_q) = (b, a) if swapped else (a, b)
    p, q = shares(p + 1, all_p), shares(q + 1, all_q)
    p0, q0 = (int(shares(np.ones(1, np.int64), x)[0]) for x in (all_p, all_q))
    at = gallop(ids_a, ids_b)
    both = at < len(ids_b)
    both[both] = ids_b[at[both]] == ids_a[both]
    at = at[both]
    only_b = np.ones(len(ids_b), bool)
    only_b[at] = False
    there = back = 0
    for x, y in ((p[both], q[at]), (p[~both], np.int64(q0)), (np.int64(p0), q[only_b])):
        square = (x - y) ** 2
        there += int((square // y).sum())
        back += int((square // x).sum())
    n = len(ids_a) + len(ids_b) - len(at)
    return (back, there, n) if swapped else (there, back, n)


def _pairs(arrays: DataFrame) -> DataFrame:
    """lang, a, b, there, back, n for the pairs a < b of sources in a block of terms; arrays has a copy of a source's arrays for each group that its own meets."""

    def meet(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).combine_chunks()
        lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
        own = sorted(zip(get("source").to_pylist(), get("part").to_pylist(), range(table.num_rows), strict=True))
        ids, n, all_ = get("ids"), get("n"), get("all").to_pylist()
        flat = lambda x, i: x[i].values.to_numpy(zero_copy_only=False)
        held = {i: (flat(ids, i), flat(n, i), all_[i]) for *_, i in own}
        out = [(a, b, *priced(held[i], held[j])) for x, (a, part, i) in enumerate(own) for b, other, j in own[x + 1 :] if low == high or part != other]
        names = ["a", "b", "there", "back", "n"]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["lang", *names])

    return arrays.groupBy("lang", "block", "low", "high").applyInArrow(meet, "lang string, a string, b string, there long, back long, n long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, max_rank: int = MAX_RANK) -> DataFrame:
    """lang, source, part, item, value, rank for each group (lang, source) of docs (lang, source, text).

    Part 'pair' has every other source of the language with the divergence of the
    group from it, part 'term' the max_rank terms that the group has more of than
    its language, by what they add to the divergence from it. Terms count if
    min_docs rows of the language have them. Null text, lang or source counts as
    '', repeated rows each count, equal values rank by item in UTF-8 order.
    Columns of docs other than these three are ignored; an empty table gives no
    row, a language without terms pairs of value 0.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(plain("lang"), plain("source")).distinct()

    by_lang = cut(term_counts(docs).where(F.col("docs") >= min_docs).drop("docs"))
    terms = small(cut(by_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_all"))))
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / BLOCK_TERMS))
    # The join below is a broadcast unless there are very many languages, so that terms are dealt by block and not by language.
    numbered = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    vocabulary = cut(by_lang.join(terms, "lang").withColumn("block", block).withColumn("id", numbered))
    kept = vocabulary.select("lang", "term", "block", "id", "lang_n", F.inline("own"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = (
        groups.join(totals, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .join(sources, "lang")
        .select("lang", "source", count("terms").alias("terms"), (count("n") + count("terms")).alias("all"), (count("lang_all") + count("terms")).alias("lang_all"), F.ceil(F.col("sources") / BLOCK_SOURCES).alias("parts"))
    )
    groups = cut(groups.withColumn("p0", share(F.lit(1).cast("long"), F.col("all"))).withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts"))))

    # The shares within the group and the language, then the terms that stand out.
    p, q = share(F.col("n") + 1, F.col("all")), share(F.col("lang_n") + 1, F.col("lang_all"))
    own = kept.join(small(groups.select("lang", "source", "all", "lang_all")), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    of_terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value"))

    # Each source's arrays in every block, empty ones too, a copy for each group of sources that its own meets.
    own_arrays = kept.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("terms") / BLOCK_TERMS) - 1))
    arrays = groups.where("terms > 0").select("lang", "source", "all", "part", "parts", blocks.alias("block")).join(own_arrays, ["lang", "source", "block"], "left")
    ids, n = (F.coalesce(F.col(f"x.{c}"), F.array().cast(f"array<{kind}>")).alias(name) for c, kind, name in (("id", "int", "ids"), ("n", "long", "n")))
    arrays = arrays.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    arrays = arrays.select("lang", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "source", "part", "all", ids, n)
    found = _pairs(arrays).groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("there", "back", "n")])
    side = lambda x: groups.select("lang", F.col("source").alias(x), "terms", F.col("p0").alias(f"{x}0"))
    pairs = side("a").join(side("b").drop("terms"), "lang").where("a < b").join(found, ["lang", "a", "b"], "left")
    neither = F.col("terms") - count("n")
    value = lambda c, x, y: count(c) + count(neither * price(F.col(x), F.col(y)))
    rows = F.array(
        F.struct(F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value("there", "a0", "b0").alias("value")),
        F.struct(F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), value("back", "b0", "a0").alias("value")),
    )
    of_pairs = pairs.select("lang", F.inline(rows))

    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    # The best terms of each of many parts of a group first, so that no task sorts all terms of a group.
    best = of_terms.withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))).withColumn("rank", rank("deal")).where(F.col("rank") <= max_rank).drop("deal")
    return of_pairs.withColumn("rank", rank()).unionByName(best.withColumn("rank", rank()).where(F.col("rank") <= max_rank))


#: The contract's rows of op13 in DuckDB SQL.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM w),
t AS MATERIALIZED (SELECT row, lang, source, unnest(terms) AS term FROM w),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
big AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM n GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 1)::HUGEINT) // (coalesce(big.n, 0) + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN big ON big.lang = g.lang AND big.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), l AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + v.v) AS q
  FROM n JOIN v USING (lang) GROUP BY lang, term, v.v
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), tops AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - l.q) * (p.p - l.q)) // l.q)::BIGINT AS value
  FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops) QUALIFY part = 'pair' OR rank <= 200
"""
