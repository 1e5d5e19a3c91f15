"""N-gram Jaccard join by set-relation skipping.

Documents of one set form a class; a set stands in the index lists of its rarest
shingles only, as many as a set of similarity 0.8 must share one of. An entry
knows its position, how many shared shingles stand before it and its set's size.

First each list's hub, its entry of least position, is compared with the list.
What is highly similar to the hub belongs to its component, and no pair within a
component is looked at. The other pairs of a list are found by blocks: entries of
like size and position form a block with bounds of its own, and pairs of blocks
whose bounds allow no link are skipped before any entry of them is read. The
answers of such sets are derived from those of their hub: what each shares with
the hub bounds what they share with each other, often from both sides, and only
pairs that the bounds leave open are compared shingle by shingle. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textbank.llm.common import cut, map_texts, slices, small
from textbank.llm.wordhash import WHITESPACE, Words, fold

#: Words in a shingle.
SHINGLE = 5
#: Buckets of the shingle counts by which rarity is judged, and rows that they travel in. The size is fixed: 4 MB.
BUCKETS, PARTS = 1 << 20, 256
#: Partners of a set that one task compares with it at a time, about; entries of a block, about.
PARTNERS, BLOCK = 512, 256
_SET_SEED = 0x1FB21C651E98DF25


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of document and hash, and the index of each document's first, with the end."""
    words = Words(texts, WHITESPACE, lower=True)
    at = words.run_starts(SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    h = np.concatenate([words.runs(SHINGLE, at), words.sequence_hashes()[short]])
    doc = np.concatenate([words.doc[at], short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each bucket, over all documents; 4 MB whatever their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for piece in slices(batches):
            total += np.bincount(_bucket(_shingles(piece.column(1))[0]), minlength=BUCKETS)
        parts = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).reshape(PARTS, -1)
        yield pa.record_batch([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, TaskContext.get().partitionId() % 64, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "salt", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // PARTS, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, np.int32)
        return pa.table({"part": [key[0].as_py()], "counts": pa.array([np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()], pa.binary())}).cast(pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    parts = docs.mapInArrow(count, "part int, salt int, counts binary")
    parts = parts.groupBy("part", "salt").applyInArrow(add, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    found = parts.orderBy("part").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int32) for r in found]) if found else np.zeros(BUCKETS, np.int32)


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), set_1 and set_2 (hashes of the set), prefix (its rarest shingles in order), last (count of the last of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = _shingles(batch.column(1))
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        rarity = shared.value[_bucket(h)]
        order = np.lexsort((h.view(np.int64), rarity, doc))
        length = n - (4 * n + 4) // 5 + 1
        kept = order[np.arange(len(h)) - first[doc] < length[doc]]
        length = np.where(n > 0, length, 0)
        ends = np.concatenate([[0], np.cumsum(length)])
        last = np.zeros(len(n), np.int32)
        last[n > 0] = rarity[kept[ends[1:][n > 0] - 1]]
        sets = [pa.array(x.view(np.int64)) for x in set_hashes(h, first)]
        return pa.record_batch(
            [batch.column(0), pa.array(n.astype(np.int64)), *sets, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[kept].view(np.int64))), pa.array(last)],
            names=["doc_id", "n", "set_1", "set_2", "prefix", "last"],
        )

    return map_texts(docs, piece, "doc_id long, n long, set_1 long, set_2 long, prefix array<long>, last int")


def set_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    return fold(h, first), fold(h, first, _SET_SEED)


def _sets(docs: DataFrame) -> DataFrame:
    """set_1, set_2, the columns after doc_id and text, and the whole set of shingles as packed 64-bit numbers in order."""
    more = docs.columns[2:]

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = _shingles(batch.column(1))
        sets = [pa.array(x.view(np.int64)) for x in set_hashes(h, first)]
        return pa.record_batch([*sets, *batch.columns[2:], pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["set_1", "set_2", *more, "shingles"])

    return map_texts(docs, piece, f"set_1 long, set_2 long, {', '.join(f'{c} long' for c in more)}, shingles binary")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared (shingles in common), linked for the pairs (a, b) of nodes of sets (node, shingles).

    Pairs of one a go to tasks in parts of about PARTNERS; each part gets a's set once, in front of its partners' sets.
    """
    parts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")))
    pairs = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    none = F.lit(None).cast("long")
    own = parts.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), none.alias("b"), "shingles")
    theirs = pairs.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "shingles")
    rows = own.unionByName(theirs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            at, shared, linked = [], [], []
            for i, (b, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                y = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    x = y.copy()
                    continue
                found = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[found] == y).sum())
                at.append(i)
                shared.append(common)
                linked.append(180 * common >= 80 * (len(x) + len(y)))
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([own.column(0), own.column(1), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])

    return rows.mapInArrow(run, "a long, b long, shared long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """node, component (least node it is linked with) for the nodes of links (a, b), by alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").where("b <> m")
        edges = cut(joined.select("b", "m").toDF("a", "b").unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) with b < a are stars: no a has two b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component) with the links (a, b) between nodes added: whole components are joined, not their nodes anew."""
    of = component.toDF("a", "x")
    ends = links.join(of, "a", "left").join(of.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    joined = components(ends)
    own = component.unionByName(joined.select("node", F.col("node").alias("component")).join(component, "node", "left_anti"))
    new = own.join(joined.toDF("component", "new"), "component", "left")
    return cut(new.select("node", F.coalesce("new", "component").alias("component")))


def _possible(x: str, y: str) -> Column:
    """Whether two entries of one list can be of sets that are similar enough; of each side's columns only sizes, positions and counts count.

    9 * overlap >= 4 * (sizes) is asked for. Shingles before the entry that both
    have are shared shingles of both; of the set whose prefix ends first, no
    shingle of the prefix outside the lists is in the other set.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "n") + c(y, "n")
    here = F.least(c(x, "before"), c(y, "before")) + 1 + F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) - 1
    x_first = F.struct(c(x, "last"), c(x, "last_token")) <= F.struct(c(y, "last"), c(y, "last_token"))
    cap = F.when(x_first, c(x, "cap")).otherwise(c(y, "cap"))
    return (5 * F.least(c(x, "n"), c(y, "n")) >= 4 * F.greatest(c(x, "n"), c(y, "n"))) & (9 * here >= 4 * total) & (9 * cap >= 4 * total)


def _first_common(x: str, y: str) -> Column:
    """Whether two entries of one list can be of similar sets whose first common shingle, in the order of prefixes, is the list's.

    A pair need only be met there. No shingle before it, of either set, is in the
    other; of the set whose prefix ends first, neither is any outside the lists.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "n") + c(y, "n")
    left = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    x_first = F.struct(c(x, "last"), c(x, "last_token")) <= F.struct(c(y, "last"), c(y, "last_token"))
    cap = F.when(x_first, c(x, "cap") - c(x, "before")).otherwise(c(y, "cap") - c(y, "before"))
    return (5 * F.least(c(x, "n"), c(y, "n")) >= 4 * F.greatest(c(x, "n"), c(y, "n"))) & (9 * left >= 4 * total) & (9 * cap >= 4 * total)


def _blocks(entries: DataFrame) -> DataFrame:
    """entries with their block: sizes within a sixth of a doubling, positions within an eighth of the prefix, and a share of the list by node where that would be more than BLOCK entries."""
    size = F.floor(F.log2("n") * 6)
    position = F.floor(8 * F.col("pos") / F.greatest(F.floor(F.col("n") / 5) + 1, F.col("pos") + 1))
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / BLOCK))
    return entries.withColumn("block", F.xxhash64(size, position, share, "outer"))


def _derived(x: str, y: str) -> tuple[Column, Column]:
    """Least and greatest number of shingles that two entries of one list can have in common, from what each shares with the list's hub; null if not known."""
    c = lambda side, name: F.col(f"{side}.{name}")
    known = c(x, "shared").isNotNull() & c(y, "shared").isNotNull()
    low = F.when(known, c(x, "shared") + c(y, "shared") - c(x, "hub_n"))
    high = F.when(known, F.least(c(x, "shared"), c(y, "shared")) + F.least(c(x, "n") - c(x, "shared"), c(y, "n") - c(y, "shared")))
    return low, high


def _rest(entries: DataFrame) -> DataFrame:
    """a, b, sure: pairs of entries in one list and two components that can be linked; sure if they are by what they share with the list's hub.

    entries has token, node, n, pos, before, cap, last, last_token, component, k
    (entries of the list), outer (not of its largest component), hub_n, shared.
    """
    entries = cut(_blocks(entries))
    outside = F.max(F.col("n") - F.col("shared"))
    blocks = entries.groupBy("token", "block", "outer").agg(
        F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("pos").alias("first"), F.max(F.col("cap") - F.col("before")).alias("cap"),
        F.max("shared").alias("shared"), outside.alias("outside"), (F.count("shared") == F.count("*")).alias("known"), F.min("component").alias("low"), F.max("component").alias("high"),
    )
    blocks = cut(blocks)
    c = lambda side, name: F.col(f"{side}.{name}")
    least = c("x", "n_least") + c("y", "n_least")
    # The most that any two entries of the blocks can share: by position, by the lists they stand in, by the hub.
    by_place = F.least(c("x", "n_most") - c("x", "first"), c("y", "n_most") - c("y", "first"))
    by_hub = F.least(c("x", "shared"), c("y", "shared")) + F.least(c("x", "outside"), c("y", "outside"))
    sizes = (5 * c("x", "n_most") >= 4 * c("y", "n_least")) & (5 * c("y", "n_most") >= 4 * c("x", "n_least"))
    bounds = (9 * by_place >= 4 * least) & (9 * F.greatest(c("x", "cap"), c("y", "cap")) >= 4 * least) & (~(c("x", "known") & c("y", "known")) | (9 * by_hub >= 4 * least))
    apart = (c("x", "low") != c("y", "low")) | (c("x", "high") != c("y", "high")) | (c("x", "low") != c("x", "high"))
    met = blocks.where("outer").alias("x").join(blocks.alias("y"), (c("x", "token") == c("y", "token")) & sizes & bounds & apart)
    met = met.select(c("x", "token").alias("token"), c("x", "block").alias("x_block"), c("y", "block").alias("y_block"))
    left = entries.where("outer").withColumnRenamed("block", "x_block").join(met, ["token", "x_block"])
    low, high = _derived("x", "y")
    total = c("x", "n") + c("y", "n")
    same = (c("x", "token") == c("y", "token")) & (c("x", "y_block") == c("y", "block")) & (c("x", "component") != c("y", "component")) & (~c("y", "outer") | (c("x", "node") < c("y", "node")))
    found = left.alias("x").join(entries.alias("y"), same & _first_common("x", "y") & (high.isNull() | (9 * high >= 4 * total)))
    return cut(found.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.max(F.coalesce(9 * low >= 4 * total, F.lit(False))).alias("sure")))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    Sets are linked if 100 * intersection >= 80 * union, and component_id is the
    least doc_id that links lead to. Null and empty texts have no set, are linked
    with nothing and are their own component. A row without an id (null) has the
    component_id of rows that have an id and the same set, null if there are none,
    and links nothing. Equal sets are one class however often they occur; they are
    told by 128 bits. Rows that share an id are linked only if their sets are.
    Other columns are ignored, repeated rows give repeated rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(_prefixes(docs, shingle_counts(docs)))
    classes = cut(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_1", "set_2").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))

    # Entries of the lists, of one document for each class; only lists of two classes or more matter.
    nodes = rows.join(classes, ["set_1", "set_2", "doc_id"])
    entries = nodes.select("node", "n", "last", F.element_at("prefix", -1).alias("last_token"), F.size("prefix").alias("length"), F.posexplode("prefix").alias("pos", "token"))
    lists = cut(entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token"))
    entries = cut(entries.join(lists, "token").dropDuplicates(["token", "node"]))
    own = Window.partitionBy("node")
    entries = cut(
        entries.withColumn("before", F.row_number().over(own.orderBy("pos")) - 1)
        .withColumn("cap", F.count("*").over(own) + F.col("n") - F.col("length"))
        .select("token", "node", "n", "pos", "before", "cap", "last", "last_token")
    )

    def compared(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        involved = cut(involved.join(classes, "node").select("doc_id", "node", F.col("set_1").alias("own_1"), F.col("set_2").alias("own_2")))
        sets = _sets(docs.join(small(involved), "doc_id").select("doc_id", "text", "node", "own_1", "own_2")).where("set_1 = own_1 AND set_2 = own_2")
        return cut(_overlaps(pairs.select("a", "b"), cut(sets.select("node", "shingles").dropDuplicates(["node"]))))

    # First, each list's entries against its hub.
    hubs = cut(entries.groupBy("token").agg(F.min(F.struct("pos", "n", "node", "before", "cap", "last", "last_token")).alias("hub"))).select("token", "hub.*")
    stars = hubs.alias("x").join(entries.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & _possible("x", "y"))
    stars = compared(cut(stars.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()))
    links = stars.where("linked").select("a", "b")

    component = components(links)

    # Then every pair of a list that lies in two components: sets outside a list's largest component against the list.
    labelled = cut(entries.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")))
    largest = labelled.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("m"), F.sum("k").alias("k"))
    largest = largest.where("m > 1").join(hubs.select("token", F.col("node").alias("hub"), F.col("n").alias("hub_n")), "token")
    open_ = labelled.join(cut(largest.select("token", "largest", "k", "hub", "hub_n")), "token").withColumn("outer", F.col("component") != F.col("largest"))
    open_ = open_.withColumns({"a": F.least("node", "hub"), "b": F.greatest("node", "hub")}).join(stars.select("a", "b", "shared"), ["a", "b"], "left")
    rest = _rest(open_.withColumn("shared", F.when(F.col("node") == F.col("hub"), F.col("n")).otherwise(F.col("shared"))).drop("a", "b", "hub", "largest"))
    rest = cut(rest.join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = cut(compared(rest.where("NOT sure")).where("linked").select("a", "b").unionByName(rest.where("sure").select("a", "b")))
        if not more.isEmpty():
            component = _merged(component, more)

    # Only linked classes have another component than their own.
    members = cut(component.join(classes, "node").select("node", "doc_id", "component"))
    least = small(cut(members.groupBy("component").agg(F.min("doc_id").alias("component_id"))))
    linked = members.join(least, "component").select("node", "component_id")
    answer = cut(classes.join(linked, "node", "left").select("set_1", "set_2", F.coalesce("component_id", "doc_id").alias("component_id")))
    found = rows.where("n > 0").select("doc_id", "set_1", "set_2", F.col("n").alias("n_shingles")).join(answer, ["set_1", "set_2"], "left").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: The contract's rows of op7 in DuckDB SQL: all linked pairs by shared shingles, then reachability.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
