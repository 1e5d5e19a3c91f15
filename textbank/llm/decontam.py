"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A window of an item is contained in a document only if its rarest shingle of
three words is, so that shingle is the whole necessary prefix under an order by
rarity. Texts are read once for the places of the windows' shingles; of these,
only prefixes are joined. A match fixes where the window would lie, which the
document's length must allow, and the words there are compared with the windows,
so equal hashes of different shingles do no harm. Only DataFrame functions are
used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.llm.common import cut, small

#: Words in a window; an item with fewer words is one window.
WINDOW = 13
#: Words in a shingle; a shorter window is one shingle.
SHINGLE = 3
#: A document is contaminated if 1 / HIT_SHARE of its words are hit.
HIT_SHARE = 20
#: ASCII characters that end a word, after lower-casing.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased and nothing else changed; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def windows(items: DataFrame) -> DataFrame:
    """item_id, window (array of words): every window of every item, each once per item."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, WINDOW))).alias("window"))
        .distinct()
    )


def shingles(w: Column, k: int) -> Column:
    """Array of (at, token): the hash of the k words from each place of w."""
    places = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: i + k <= F.size(w))
    return F.transform(places, lambda i: F.struct(i.alias("at"), _token([F.get(w, i + j) for j in range(k)]).alias("token")))


def _token(row: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(row)), *row)


def _marks(docs: DataFrame, wanted: DataFrame, kinds: list[int]) -> DataFrame:
    """Places of wanted shingles: doc_id, version, n (words), at, token, and one row more for each row of docs (lead).

    docs has doc_id, version and the words w, which are read once; kinds are the lengths of shingles.
    """
    w = F.col("w")
    columns = [w if j == 0 else F.slice(w, j + 1, F.size(w)) for j in range(max(kinds))]
    row = docs.select("doc_id", "version", F.size("w").alias("n"), F.posexplode_outer(F.arrays_zip(*columns)).alias("at", "x"))
    first = F.coalesce("at", F.lit(0)) == 0
    word = [F.col("x").getField(f) for f in row.schema["x"].dataType.names]
    tokens = [F.when(word[k - 1].isNotNull(), _token(word[:k])) for k in kinds]
    if len(kinds) == 1:
        row = row.select("doc_id", "version", "n", "at", tokens[0].alias("token"), first.alias("lead"))
    else:
        own = F.array(*[F.struct(t.alias("token"), (first & F.lit(i == 0)).alias("lead")) for i, t in enumerate(tokens)])
        row = row.select("doc_id", "version", "n", "at", F.inline(own))
    return row.join(wanted.withColumn("known", F.lit(True)), "token", "left").where("known OR lead")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted array), hit_starts, contaminated for each row of docs.

    docs has doc_id and text, items has item_id and text; other columns are
    ignored. Null and empty texts have no words: such a document gets zeros, such
    an item no window. Rows that share a doc_id are told apart by their text and
    each gets its own row; items that share an id count once. Of a document only
    places are gathered, never more than it has words for each length of window.
    """
    own = cut(windows(items))
    wins = cut(own.select("window").distinct().withColumn("window_id", F.monotonically_increasing_id()).withColumn("k", F.size("window")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.version") == F.col(f"{y}.version"))

    # Windows of fewer than three words are one shingle of their own length.
    kinds = sorted(r[0] for r in wins.select(F.least("k", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    of_window = F.coalesce(*[F.when(F.least("k", F.lit(SHINGLE)) == k, shingles(F.col("window"), k)) for k in kinds])
    placed = cut(wins.select("window_id", "k", F.inline(of_window)))

    # Where each shingle of a window occurs in the documents, and how often; one that none has rules its windows out.
    wanted = small(cut(placed.select("token").distinct()))
    marks = cut(_marks(docs.select("doc_id", "version", words(F.col("text")).alias("w")), wanted, kinds))
    counts = cut(marks.where("known").groupBy("token").agg(F.count("*").alias("n")))
    prefixes = (
        placed.join(counts, "token", "left")
        .groupBy("window_id", "k")
        .agg(F.min_by(F.struct("token", "at"), F.struct("n", "token", "at")).alias("rarest"), F.count("n").alias("held"), F.count("*").alias("all"))
        .where("held = all")
        .select("k", "rarest.token", F.col("rarest.at").alias("offset"))
        .distinct()
    )

    # A prefix fixes where its window would start, which the document's length must allow.
    start = F.col("at") - F.col("offset")
    possible = marks.where("known").join(small(cut(prefixes)), "token").where((start >= 0) & (start + F.col("k") <= F.col("n")))
    possible = cut(possible.groupBy("doc_id", "version", "k").agg(F.collect_set(start).alias("starts")))
    keys = small(cut(possible.select("doc_id", "version").distinct()))
    some = docs.alias("d").join(keys.alias("p"), same("d", "p"), "left_semi").distinct()
    at = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice(F.col("w"), s + 1, F.col("k")).alias("window")))
    some = some.alias("d").join(possible.alias("p"), same("d", "p")).select("d.doc_id", "d.version", "k", "starts", words(F.col("text")).alias("w"))
    # The words there must be those of a window.
    verified = cut(some.select("doc_id", "version", F.inline(at)).join(small(wins), "window").select("doc_id", "version", "start", "k", "window_id"))

    spans = verified.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "k"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    end = lambda x: x["start"] + x["k"]
    hit = F.aggregate(
        "spans",
        zero,
        lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["hit"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["start"]))).alias("hit")),
        lambda a: a["hit"],
    )
    spans = spans.select("doc_id", "version", hit.alias("n_hit"), F.array_distinct(F.transform("spans", lambda x: x["start"])).alias("hit_starts"))
    holders = own.join(wins, "window").select("window_id", "item_id")
    named = verified.select("doc_id", "version", "window_id").distinct().join(holders, "window_id").groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = spans.alias("s").join(named.alias("i"), same("s", "i")).select("s.doc_id", "s.version", "n_hit", "hit_starts", "item_ids")
    return (
        marks.where("lead")
        .alias("m")
        .join(found.alias("f"), same("m", "f"), "left")
        .select(
            "m.doc_id",
            F.greatest("n", F.lit(0)).cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("hit_starts", F.array().cast("array<int>")).alias("hit_starts"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))
    )


#: The contract's rows of op8 in DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM win), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d, sizes, unnest(generate_series(1, len(w) - k + 1)) AS t(i)
), m AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + k - 1)) AS t(p) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN its USING (doc_id)
"""
