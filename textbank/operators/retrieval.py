"""Retrieval: vector top-k, lexical reranking, rank fusion, cross-link expansion, rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from textbank.functions.text import distinct_tokens, matches, strip, text_or_empty
from textbank.operators.common import cut, small

#: Words of a query that name a kind of figure.
KIND_SYNONYMS = {
    "histogram": "histogram",
    "bar": "bar",
    "scatter": "scatter",
    "scatterplot": "scatter",
    "boxplot": "boxplot",
    "box": "boxplot",
    "line": "line",
    "pie": "pie",
    "diagram": "diagram",
}
#: Words that tell formulas apart.
MATH_WORDS = (
    "sigma", "mu", "alpha", "beta", "lambda", "theta", "chi", "rho", "nu", "sqrt", "sum", "integral", "mean", "median", "mode", "variance",
    "deviation", "probability", "proportion", "correlation", "regression", "interval", "score", "statistic", "frequency", "midpoint", "quartile",
    "percentile", "factorial", "combination", "permutation", "expected",
)
#: What marks a query as one about a picture, and as one about a calculation.
VISUAL = (
    r"graph|chart|figure|histogram|scatter|boxplot|box plot|bar (chart|graph)|pie chart|plot\b|table\b|distribution shape|skew|axis|axes|trend|outlier"
)
COMPUTATIONAL = (
    r"formula|calculat|comput|solve|equation|how (do|to) .*(find|work out)|standard deviation|variance|probability|confidence interval|test statistic"
    r"|z[- ]?score|t[- ]?score|p[- ]?value|[=√∑∫^]|sqrt|x_bar|mu\b|sigma\b"
)
#: Columns that carry matchable text, by kind of list.
FIELDS = {
    "text": ("text", "section_title", "chapter_title"),
    "formula": ("formula_latex", "formula_plain", "concept_label", "context_sentence"),
    "figure": ("figure_kind", "caption", "description"),
    "table": ("table_summary", "table_markdown", "headers"),
}


#: Queries and rows in a block: 512 * 4096 similarities take 16 MB.
QUERY_BLOCK, ROW_BLOCK = 512, 4096
#: Blocks of queries that are broadcast, counted first; more of them are joined by a shuffle.
MOST_BLOCKS = 64
#: Rows of a bucket, and of a cell or part of what all meet, that a task holds at a time.
BUCKET_HELD, HELD = 4096, 16384


def _units(vectors: pa.Array) -> np.ndarray:
    """Vectors, none of them null or of another length than the first, as rows of length one in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(exact: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, greatest first, of equals the first."""
    n, width = exact.shape
    if width <= k or np.isnan(exact).any():
        return np.argsort(-exact, axis=1, kind="stable")[:, :k]
    least = np.partition(exact, width - k, axis=1)[:, width - k]
    row, place = np.nonzero(exact >= least[:, None])
    order = np.lexsort((place, -exact[row, place], row))
    row, place = row[order], place[order]
    return place[np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < k].reshape(n, k)


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding has a length other than zero and no null inside."""
    e = F.col("embedding")
    return rows.where(F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull()) & F.exists(e, lambda x: x != 0), F.lit(False)))


def _met_by_all(queries: DataFrame, rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """query_id, _id, exact: the k best of each block of rows for every query that has its values of `by`; queries are few enough to be sent to all tasks."""
    table = queries.toArrow().combine_chunks()
    keys, told = list(zip(*(table[c].to_pylist() for c in by), strict=True)), {}
    for i, key in enumerate(keys):
        told.setdefault(key, []).append(i)
    column = lambda c, at: pa.concat_arrays(table[c].take(pa.array(at)).chunks)
    sent = rows.sparkSession.sparkContext.broadcast({key: (column("query_id", at), _units(column("embedding", at))) for key, at in told.items()})
    kind = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("_id", rows.schema["_id"].dataType), StructField("exact", DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by), strict=True))
            start = 0
            for i in range(1, batch.num_rows + 1):
                if i < batch.num_rows and i - start < ROW_BLOCK and marks[i] == marks[start]:
                    continue
                query_ids, x = sent.value.get(marks[start], ((), ()))
                part = batch.slice(start, i - start)
                ids = part.column(0)
                if len(x):
                    by_id = pc.sort_indices(ids)
                    y, ids = _units(part.column(part.schema.get_field_index("embedding")))[by_id.to_numpy()], ids.take(by_id)
                for at in range(0, len(x), QUERY_BLOCK):
                    exact = np.round(x[at : at + QUERY_BLOCK] @ y.T, 12)
                    top = _top(exact, k)
                    own = np.repeat(np.arange(len(exact)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(own + at)), ids.take(pa.array(top.reshape(-1))), pa.array(exact[own, top.reshape(-1)])], names=["query_id", "_id", "exact"])
                start = i

    return rows.sortWithinPartitions(*by).mapInArrow(best, kind)


def vector_topk(queries: DataFrame, rows: DataFrame, k: int = 5, scope: tuple[str, ...] = (), pre_filter: bool = True) -> DataFrame:
    """query_id, _id, similarity, rank: the k rows most similar to each query, exactly.

    queries has query_id, embedding and the scope columns; rows has _id, embedding
    and them. With pre_filter the scope limits what is ranked, else it filters the
    k best of all. Rows and queries without a usable vector are left out, and only
    vectors of one length meet. Ties go to the smaller _id. Up to MOST_BLOCKS blocks
    of queries go to every task, and the rows stay where they are, of which a block
    at a time meets a block of queries in one matrix product; more queries visit the
    parts of the rows. Only the k best of a block or part go on.
    """
    inner = scope if pre_filter else ()
    by = [*inner, "width"]
    usable = lambda frame, key: _usable(frame).select(key, *inner, "embedding", F.size("embedding").alias("width")).dropna(subset=by)
    q, r = cut(usable(queries, "query_id")), usable(rows, "_id")
    if q.count() <= MOST_BLOCKS * QUERY_BLOCK:
        found = _met_by_all(q, r, by, k)
    else:
        # Parts of a scope hold about HELD rows at most.
        parts = F.lit(-(-r.count() // HELD) or 1)
        none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
        held = r.select(*by, F.pmod(F.xxhash64("_id"), parts).cast("int").alias("part"), F.lit(0).alias("side"), none(q, "query_id"), "_id", "embedding")
        asked = q.select(*by, F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), F.lit(1).alias("side"), "query_id", none(r, "_id"), "embedding")
        found = nearest_held(held.unionByName(asked).repartition(*by, "part").sortWithinPartitions(*by, "part", "side", "_id"), [*by, "part"], k)
    own = Window.partitionBy("query_id").orderBy(F.desc("exact"), "_id")
    ranked = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    if scope and not pre_filter:
        ranked = ranked.join(queries.select("query_id", *scope), "query_id").join(rows.select("_id", *scope), ["_id", *scope], "left_semi")
    return ranked.select("query_id", "_id", F.round("exact", 6).alias("similarity"), "rank")


def nearest_held(met: DataFrame, keys: list[str], k: int) -> DataFrame:
    """query_id, _id, exact: for each query of a group the k most similar of its vectors, ties to the smaller _id.

    met has the keys of a group, side (0 a vector, 1 a query), query_id, _id and embedding, and lies and is sorted by
    keys, side and _id. A task holds the vectors of one group at a time and makes no row for a pair that is not among the best.
    """
    out = StructType([StructField("query_id", met.schema["query_id"].dataType), StructField("_id", met.schema["_id"].dataType), StructField("exact", DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, ids = None, [], []
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            marks = list(zip(*(get(c).to_pylist() for c in (*keys, "side")), strict=True))
            start = 0
            for i in range(1, batch.num_rows + 1):
                if i < batch.num_rows and marks[i] == marks[start] and i - start < QUERY_BLOCK:
                    continue
                if marks[start][:-1] != key:
                    key, own, ids = marks[start][:-1], [], []
                x = _units(get("embedding").slice(start, i - start))
                if marks[start][-1] == 0:
                    own.append(x)
                    ids.append(get("_id").slice(start, i - start))
                elif own:
                    if len(own) > 1:
                        own, ids = [np.concatenate(own)], [pa.concat_arrays(ids)]
                    exact = np.round(x @ own[0].T, 12)
                    top = _top(exact, k)  # vectors are in order of _id
                    row = np.repeat(np.arange(len(x)), top.shape[1])
                    at = top.reshape(-1)
                    yield pa.RecordBatch.from_arrays([get("query_id").slice(start, i - start).take(pa.array(row)), ids[0].take(pa.array(at)), pa.array(exact[row, at])], names=["query_id", "_id", "exact"])
                start = i

    return met.mapInArrow(best, out)


def approximate_topk(queries: DataFrame, rows: DataFrame, k: int = 5, planes: int | None = None, tables: int = 16, seed: int = 17) -> DataFrame:
    """query_id, _id, similarity, rank among candidates that share a bucket of random hyperplanes with the query.

    Every row is indexed in each of `tables` tables under the signs of its dot
    products with `planes` random directions; a query looks into its own bucket of
    each and those that differ in one sign. Candidates are scored exactly, in their
    bucket, of which a task holds BUCKET_HELD at a time, and only a bucket's best go
    on. More tables find more. Without planes given there is one for each doubling
    of the rows beyond 32, so that buckets keep their size as the rows grow. Vectors
    of another width than most are not met.
    """
    r, q = _usable(rows).select("_id", "embedding"), _usable(queries).select("query_id", "embedding")
    found = r.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width, n = (found["w"], found["count"]) if found else (0, 0)
    r, q = (x.where(F.size("embedding") == width) for x in (r, q))
    if planes is None:
        planes = max(2, int(np.log2(max(n, 1) / 32)) + 1)

    def dealt(vectors: DataFrame, flip: bool) -> DataFrame:
        """vectors, once for each bucket."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(seed)
            normals = [rng.standard_normal((width, planes)) for _ in range(tables)]
            for batch in batches:
                x = _units(batch.column(1))
                bits = np.stack([(x @ own >= 0) @ (1 << np.arange(planes)) for own in normals], axis=1)
                own = bits + (np.arange(tables) << planes)
                if flip:
                    own = np.concatenate([own, *(own ^ (1 << i) for i in range(planes))], axis=1)
                ends = np.arange(len(x) + 1, dtype=np.int32) * own.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(own.reshape(-1).astype(np.int64)))], names=[*batch.schema.names, "buckets"])

        out = vectors.mapInArrow(of, StructType([*vectors.schema, StructField("buckets", ArrayType(LongType()))]))
        return out.select(*vectors.columns, F.explode("buckets").alias("bucket"))

    index, probe = dealt(r, False), dealt(q, True)
    # Buckets of many rows, such as the copies of a vector, are split.
    large = small(cut(dealt(r, False).groupBy("bucket").count().where(F.col("count") > BUCKET_HELD).select("bucket", F.ceil(F.col("count") / BUCKET_HELD).cast("int").alias("parts"))))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    held = index.join(large, "bucket", "left").select("bucket", F.pmod(F.xxhash64("_id"), parts).cast("int").alias("part"), F.lit(0).alias("side"), none(q, "query_id"), "_id", "embedding")
    asked = probe.join(large, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("side"), "query_id", none(r, "_id"), "embedding")
    met = held.unionByName(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side", "_id")
    once = nearest_held(met, ["bucket", "part"], k).repartition("query_id").groupBy("query_id", "_id").agg(F.max("exact").alias("exact"))
    own = Window.partitionBy("query_id").orderBy(F.desc("exact"), "_id")
    return once.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "_id", F.round("exact", 6).alias("similarity"), "rank")


def classify_intent(query: Column) -> Column:
    """visual, computational or conceptual; visual wins."""
    return F.when(matches(query, VISUAL), "visual").when(matches(query, COMPUTATIONAL), "computational").otherwise("conceptual")


def rerank(ranked: DataFrame, alpha: float = 0.5) -> DataFrame:
    """ranked (query, kind, rank from 1, _id and the text columns of its kind) with lexical, blended and new_rank.

    The blend is alpha times the linearly scaled vector rank and 1 - alpha times
    the share of the query's tokens found, with extra for shared mathematical
    words of formulas and a named kind of figure. Lists of one row stay as they
    are; ties keep their order. With a column query_id lists are told apart by it,
    as two queries may have one text; else by the query's text.
    """
    here = set(ranked.columns)
    text = F.coalesce(
        *[F.when(F.col("kind") == kind, F.concat_ws(" ", *[c for c in fields if c in here])) for kind, fields in FIELDS.items() if any(c in here for c in fields)],
        F.lit(""),
    )
    q, d = distinct_tokens(F.col("query")), distinct_tokens(text)
    shared = F.array_intersect(q, d)
    named = F.array_compact(F.transform(q, lambda t: reduce(lambda w, kv: w.when(t == kv[0], kv[1]), list(KIND_SYNONYMS.items())[1:], F.when(t == "histogram", "histogram"))))
    bonus = F.when(F.col("kind") == "formula", 0.25 * F.least(F.size(F.array_intersect(shared, F.array(*map(F.lit, MATH_WORDS)))), F.lit(2))).otherwise(0.0)
    if "figure_kind" in here:
        bonus = F.when((F.col("kind") == "figure") & F.array_contains(named, F.lower("figure_kind")), 0.5).otherwise(bonus)
    lexical = F.when(F.size(q) > 0, F.size(shared) / F.size(q) + F.coalesce(bonus, F.lit(0.0))).otherwise(0.0)
    own = Window.partitionBy("query_id" if "query_id" in here else "query", "kind")
    n = F.count("*").over(own)
    out = ranked.withColumn("lexical", F.round(lexical, 6)).withColumn("blended", F.when(n < 2, F.lit(None)).otherwise(F.round(alpha * (n - (F.col("rank") - 1)) / n + (1 - alpha) * lexical, 6)))
    return out.withColumn("new_rank", F.row_number().over(own.orderBy(F.desc_nulls_last("blended"), "rank")))


def fuse(lists: DataFrame, constant: int = 60) -> DataFrame:
    """query_group, _id, score, rank from ranked lists (query_group, list_no, rank from 1, _id): reciprocal rank fusion.

    Blank ids are skipped and a list's second copy of an id counts too, as each
    place adds 1 / (constant + rank). Ties go to the id seen first.
    """
    scored = (
        lists.where(F.col("_id").isNotNull() & (F.trim(F.col("_id").cast("string")) != ""))
        .groupBy("query_group", "_id")
        .agg(F.sum(1.0 / (constant + F.col("rank"))).alias("exact"), F.min(F.struct("list_no", "rank")).alias("seen"))
    )
    own = Window.partitionBy("query_group").orderBy(F.desc(F.round("exact", 12)), "seen", "_id")
    return scored.select("query_group", "_id", F.round("exact", 8).alias("score"), F.row_number().over(own).alias("rank"))


def expand_to_parents(hits: DataFrame, chunks: DataFrame, known: DataFrame, limit: int = 2) -> DataFrame:
    """query_group, _id, place: chunks that specialist hits come from and that are not known yet, first hits first.

    hits has query_group, hit_rank, parent_chunk_id; chunks _id; known query_group, _id.
    """
    wanted = (
        hits.where("parent_chunk_id IS NOT NULL")
        .groupBy("query_group", F.col("parent_chunk_id").alias("_id"))
        .agg(F.min("hit_rank").alias("hit_rank"))
        .join(known.select("query_group", "_id"), ["query_group", "_id"], "left_anti")
        .join(chunks.select("_id").distinct(), "_id", "left_semi")
    )
    own = Window.partitionBy("query_group").orderBy("hit_rank", "_id")
    return wanted.withColumn("place", F.row_number().over(own)).where(F.col("place") <= limit).select("query_group", "_id", "place")


def cap_per_kind(fused: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The best rows of each query_group and kind, as many as caps allows the kind."""
    own = Window.partitionBy("query_group", "kind").orderBy("rank", "_id")
    cap = reduce(lambda w, kv: w.when(F.col("kind") == kv[0], kv[1]), list(caps.items())[1:], F.when(F.col("kind") == next(iter(caps)), next(iter(caps.values()))))
    return fused.withColumn("place", F.row_number().over(own)).where(F.col("place") <= F.coalesce(cap, F.lit(0)))


def fan_out(queries: DataFrame, k: int = 8) -> DataFrame:
    """query_group, query_id, kind, k: which lists each query is run on, by its intent.

    Text gets max(2, k / n) rows for each of a group's n queries; computational
    queries also 3 formulas, visual ones 3 figures and 2 tables.
    """
    n = F.count("*").over(Window.partitionBy("query_group"))
    intent = classify_intent(F.col("query"))
    pair = lambda kind, count: F.struct(F.lit(kind).alias("kind"), count.cast("int").alias("k"))
    text = pair("text", F.greatest(F.lit(2), F.floor(F.lit(k) / n)))
    routes = F.when(intent == "computational", F.array(text, pair("formula", F.lit(3)))).when(intent == "visual", F.array(text, pair("figure", F.lit(3)), pair("table", F.lit(2)))).otherwise(F.array(text))
    return queries.select("query_group", "query_id", routes.alias("routes")).select("query_group", "query_id", F.inline("routes"))


def widen_scope(scoped: DataFrame, unscoped: DataFrame, queries: DataFrame) -> DataFrame:
    """scoped results, and the unscoped ones of queries that have none."""
    empty = queries.select("query_id").join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    return scoped.unionByName(unscoped.join(empty, "query_id", "left_semi"))


def render(rows: DataFrame, label: Column, text: Column, cap: int = 400, limit: int = 8) -> DataFrame:
    """query_group, block: one numbered line a row, in rank order, each text cut to cap characters."""
    line = F.struct(F.col("rank"), F.concat(F.lit("["), label, F.lit("] "), F.substring(F.coalesce(text, F.lit("")), 1, cap)).alias("line"))
    return rows.where(F.col("rank") <= limit).groupBy("query_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("block"))


#: The line above the rendered rows of each kind.
KIND_HEADINGS = {
    "formula": "KEY FORMULAS (verbatim from the textbook — base computations on these exact forms):",
    "figure": "FIGURES FROM THE TEXTBOOK (write data-interpretation questions that reference these):",
    "table": "TABLES FROM THE TEXTBOOK (write questions that require reading these):",
}


def render_kind(rows: DataFrame, kind: str) -> DataFrame:
    """query_group, block: the formulas, figures or tables of each group in order of rank, each in its kind's own form, under its heading.

    rows has query_group, rank and the columns of the kind's index; of these any
    may be missing or null.
    """
    own = lambda c: text_or_empty(F.col(c)) if c in rows.columns else F.lit("")
    full = lambda c, other: F.when(c != "", c).otherwise(other)
    place = F.concat(F.lit("(Ch"), full(own("chapter_num"), F.lit("?")), F.lit(", p."), full(own("page"), F.lit("?")), F.lit(")"))
    if kind == "formula":
        context = F.substring(own("context_sentence"), 1, 160)
        line = F.concat(F.lit("- "), full(own("concept_label"), F.lit("formula")), F.lit(": "), full(own("formula_latex"), own("formula_plain")), F.when(context != "", F.concat(F.lit("   ("), context, F.lit(")"))).otherwise(""))
    elif kind == "figure":
        named = full(own("figure_kind"), F.lit("figure"))
        axis = F.when(own("axis_summary") != "", F.concat(F.lit(" — "), own("axis_summary"))).otherwise("")
        line = F.concat(F.lit("- ["), named, F.lit("] "), full(own("caption"), F.concat(named, F.lit(" "), place)), axis, F.lit("\n  Description: "), F.substring(own("description"), 1, 280))
    else:
        line = F.concat(F.lit("- "), full(own("table_summary"), F.lit("table")), F.lit(" "), place, F.lit("\n"), F.array_join(F.slice(F.split(strip(own("table_markdown")), "\n"), 1, 8), "\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query_group").agg(F.concat(F.lit(KIND_HEADINGS[kind] + "\n"), F.array_join(lines, "\n")).alias("block"))


def union_first_seen(results: DataFrame) -> DataFrame:
    """One row for each query_group and _id of several result lists: the first by list_no and rank."""
    own = Window.partitionBy("query_group", "_id").orderBy("list_no", "rank")
    return results.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")


#: Pivots that vectors are dealt to.
PIVOTS = 64


def similar_pairs(rows: DataFrame, scope: str | None, threshold: float) -> DataFrame:
    """a, b, similarity: rows of one scope, or of all, with a < b whose cosine reaches threshold; every such pair.

    rows has _id, embedding and the scope column. A vector belongs to the nearest
    of PIVOTS vectors, which are chosen by a hash of the id, and visits the cells
    of others only where the triangle inequality of angles allows a partner; of two
    cells the rows of one visit the other, which are as many for each cell. A cell
    is split into parts of about HELD rows; a task holds one part and compares it
    with itself and its visitors in matrix products, so no row is made for a pair
    that is not similar. Rows without a usable vector are in no pair; all vectors
    have one length.
    """
    rows = _usable(rows).select("_id", (F.col(scope) if scope else F.lit(0)).cast("string").alias("scope"), "embedding").where("scope IS NOT NULL")
    chosen = rows.select("_id", "embedding").orderBy(F.xxhash64("_id"), "_id").limit(PIVOTS).collect()
    if not chosen:
        return rows.select(F.col("_id").alias("a"), F.col("_id").alias("b"), F.lit(0.0).alias("similarity")).where("false")
    pivots = _units(pa.array([r["embedding"] for r in chosen], pa.list_(pa.float64())))
    reach = 2 * np.arccos(np.clip(threshold, -1, 1)) + 1e-9
    id_kind, n = rows.schema["_id"].dataType, len(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = np.arange(n)
        for batch in batches:
            angle = np.arccos(np.clip(_units(batch.column(2)) @ pivots.T, -1, 1))
            home = angle.argmin(axis=1)[:, None]
            ahead = (cell - home) % n  # a row visits the half of the cells behind its own, going round
            chosen = (angle - angle.min(axis=1, keepdims=True) <= reach) & ((ahead * 2 < n) | ((ahead * 2 == n) & (home < cell)))
            cells = [np.flatnonzero(r).astype(np.int32).tolist() for r in chosen]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home[:, 0].astype(np.int32)), pa.array(cells, pa.list_(pa.int32()))], names=["_id", "scope", "embedding", "home", "cells"])

    dealt = rows.mapInArrow(deal, StructType([*rows.schema, StructField("home", IntegerType()), StructField("cells", ArrayType(IntegerType()))]))
    # Few rows, counted, so that visitors are shuffled once and not for the join as well.
    parts = small(cut(dealt.groupBy("scope", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / HELD).alias("parts"))))
    own_part = F.pmod(F.xxhash64("_id"), "parts")
    at_home = dealt.withColumn("cell", F.col("home")).join(parts, ["scope", "cell"]).select("scope", "cell", own_part.alias("part"), F.lit(0).alias("visits"), "_id", "embedding")
    visits = dealt.select("scope", "home", F.explode("cells").alias("cell"), "_id", "embedding").join(parts, ["scope", "cell"])
    visits = visits.withColumn("from", F.when(F.col("cell") == F.col("home"), own_part + 1).otherwise(0)).where("from < parts")
    visits = visits.select("scope", "cell", F.explode(F.sequence(F.col("from"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("visits"), "_id", "embedding")
    met = at_home.unionByName(visits).repartition("scope", "cell", "part").sortWithinPartitions("scope", "cell", "part", "visits")
    kind = StructType([StructField("a", id_kind), StructField("b", id_kind), StructField("similarity", DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(x: np.ndarray, own: pa.Array, y: np.ndarray, ids: pa.Array, itself: bool = False) -> pa.RecordBatch:
            exact = np.round(x @ y.T, 12)
            v, h = np.nonzero(np.triu(exact >= threshold, 1) if itself else exact >= threshold)
            a, b = own.take(pa.array(v)), ids.take(pa.array(h))
            first = pc.less(a, b)
            return pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(exact[v, h])], names=["a", "b", "similarity"])

        key, held, ids = None, [], []
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            marks = list(zip(*(get(c).to_pylist() for c in ("scope", "cell", "part", "visits")), strict=True))
            start = 0
            for i in range(1, batch.num_rows + 1):
                if i < batch.num_rows and marks[i] == marks[start] and i - start < QUERY_BLOCK:
                    continue
                if marks[start][:3] != key:
                    key, held, ids = marks[start][:3], [], []
                x, own = _units(get("embedding").slice(start, i - start)), get("_id").slice(start, i - start)
                if marks[start][3] and len(held) > 1:
                    held, ids = [np.concatenate(held)], [pa.concat_arrays(ids)]
                for y, others in zip(held, ids, strict=True):
                    yield near(x, own, y, others)
                if not marks[start][3]:
                    yield near(x, own, x, own, True)
                    held.append(x)
                    ids.append(own)
                start = i

    return met.mapInArrow(compare, kind)


def routed_retrieve(queries: DataFrame, indexes: dict[str, DataFrame], k: int = 8, constant: int = 60, expand: int = 2) -> DataFrame:
    """query_group, kind, _id, score, place: the whole of retrieval for groups of queries.

    queries has query_group, query_id, query, embedding and chapter_num; indexes has
    for each of text, formula, figure and table its rows (_id, embedding,
    chapter_num, parent_chunk_id). Each query runs on the lists its intent asks for,
    each kind's lists are fused, capped, and parents of specialist rows that are
    not among the text rows are added.
    """
    routes = fan_out(queries, k)
    pieces = []
    for kind, rows in indexes.items():
        wanted = routes.where(F.col("kind") == kind).join(queries.select("query_group", "query_id", "embedding", "chapter_num"), ["query_group", "query_id"])
        top = vector_topk(wanted.select(F.struct("query_group", "query_id").alias("query_id"), "embedding", "chapter_num"), rows, max(k, 3), ("chapter_num",))
        top = top.select(F.col("query_id.query_group").alias("query_group"), F.col("query_id.query_id").alias("query_id"), "_id", "rank")
        top = top.join(wanted.select("query_group", "query_id", "k"), ["query_group", "query_id"]).where("rank <= k")
        lists = top.select("query_group", F.col("query_id").alias("list_no"), "_id", "rank")
        pieces.append(fuse(lists, constant).withColumn("kind", F.lit(kind)))
    fused = cap_per_kind(reduce(lambda a, b: a.unionByName(b), pieces), {"text": k, "formula": 5, "figure": 3, "table": 2})
    own = fused.select("query_group", "kind", "_id", "score", "place")
    parents = reduce(lambda a, b: a.unionByName(b), [r.select(F.lit(kind).alias("kind"), "_id", "parent_chunk_id") for kind, r in indexes.items() if kind != "text"])
    hits = own.where("kind <> 'text'").join(parents, ["kind", "_id"]).select("query_group", F.col("place").alias("hit_rank"), "parent_chunk_id")
    more = expand_to_parents(hits, indexes["text"], own.where("kind = 'text'").select("query_group", "_id"), expand)
    return own.unionByName(more.select("query_group", F.lit("parent").alias("kind"), "_id", F.lit(0.0).alias("score"), "place"))


def marking_context(chunks: DataFrame, similar: DataFrame, specialist: DataFrame, k: int = 5) -> DataFrame:
    """query_group, source, _id, place: chunks of several queries once each, k at most, three similar questions, and the specialist rows."""
    first = union_first_seen(chunks)
    place = F.row_number().over(Window.partitionBy("query_group").orderBy("list_no", "rank", "_id"))
    own = first.withColumn("place", place).where(F.col("place") <= k).select("query_group", F.lit("chunk").alias("source"), "_id", "place")
    alike = similar.where("rank <= 3").select("query_group", F.lit("question").alias("source"), "_id", F.col("rank").alias("place"))
    return own.unionByName(alike).unionByName(specialist.select("query_group", F.lit("specialist").alias("source"), "_id", "place"))


def route_by_level(rows: DataFrame) -> DataFrame:
    """_id, kind, k: which specialist lists a question of a level draws on: L3 five formulas, L4 three figures and two tables."""
    pair = lambda kind, k: F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"))
    routes = F.when(F.col("bloom_level") == "L3", F.array(pair("formula", 5))).when(F.col("bloom_level") == "L4", F.array(pair("figure", 3), pair("table", 2)))
    return rows.select("_id", F.inline(routes))
