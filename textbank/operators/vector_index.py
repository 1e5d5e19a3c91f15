"""An index of vectors by cells, searched best cell first until a number of candidates is met."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from textbank.operators.common import cut
from textbank.operators.retrieval import _units, _usable, nearest_held

#: Cells of an index at most, which bounds what a task and the driver hold of it; vectors of a cell that a task holds at a time.
MOST_CELLS, HELD = 4096, 4096


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """_id, embedding and cell (the nearest pivot) of the usable vectors of the pivots' width."""
    rows = _usable(rows).select("_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") == pivots.shape[1])
    kind = StructType([*rows.schema, StructField("cell", IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_units(batch.column(1)) @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["_id", "embedding", "cell"])

    return rows.mapInArrow(deal, kind)


def write_index(rows: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes an index of rows (_id, embedding) at path: every usable vector once, sorted by cell.

    Pivots are vectors chosen by a hash of the id, as many as the root of the
    number of rows, MOST_CELLS at most. Vectors without a length and those of
    another width than most are not indexed.
    """
    usable = _usable(rows).select("_id", F.col("embedding").cast("array<float>").alias("embedding"))
    width = usable.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        raise ValueError("no row has a vector to index")
    n = min(cells or math.isqrt(width["count"]) + 1, MOST_CELLS)
    chosen = usable.where(F.size("embedding") == width["w"]).orderBy(F.xxhash64("_id"), "_id").limit(n)
    pivots = chosen.select("embedding").collect()
    rows.sparkSession.createDataFrame([(i, list(r[0])) for i, r in enumerate(pivots)], "cell int, embedding array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    _dealt(rows, _pivots(rows.sparkSession, path)).repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/vectors")


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
    return _units(pa.array([r["embedding"] for r in found], pa.list_(pa.float32())))


def extend_index(rows: DataFrame, path: str) -> None:
    """Adds rows whose ids the index lacks, one of each id, to the cells that there are; adding them again changes nothing."""
    spark = rows.sparkSession
    known = spark.read.parquet(f"{path}/vectors").select("_id")
    new = cut(_dealt(rows.dropDuplicates(["_id"]).join(known, "_id", "left_anti"), _pivots(spark, path)))
    new.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("append").parquet(f"{path}/vectors")


def search_index(queries: DataFrame, path: str, k: int = 5, candidates: int | None = 1000) -> DataFrame:
    """query_id, _id, similarity, rank: the k most similar of about `candidates` vectors, those of the cells nearest to the query.

    queries has query_id and embedding. A query looks into whole cells, the
    nearest pivot first, until they hold `candidates` vectors or there is no cell
    left, so that a number as large as the index gives the exact answer, and so
    does none (all cells); ties go to the smaller _id. Only the numbers of vectors by cell are gathered. Each
    vector is shuffled once, to its cell, of which a task holds HELD at a time.
    """
    spark = queries.sparkSession
    vectors, pivots = spark.read.parquet(f"{path}/vectors"), _pivots(spark, path)
    sizes = np.zeros(len(pivots), np.int64)
    for r in vectors.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    q = _usable(queries).select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") == pivots.shape[1])
    kind = StructType([*q.schema, StructField("cell", IntegerType())])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-(_units(batch.column(1)) @ pivots.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, place = np.nonzero((before < (math.inf if candidates is None else candidates)) & (sizes[order] > 0))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(order[row, place].astype(np.int32))], names=["query_id", "embedding", "cell"])

    parts = F.element_at(F.lit(np.maximum(-(-sizes // HELD), 1).astype(int).tolist()), F.col("cell") + 1)
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    held = vectors.select("cell", F.pmod(F.xxhash64("_id"), parts).cast("int").alias("part"), F.lit(0).alias("side"), none(q, "query_id"), "_id", "embedding")
    asked = q.mapInArrow(visit, kind).select("cell", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), F.lit(1).alias("side"), "query_id", none(vectors, "_id"), "embedding")
    met = held.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "_id"))
    return nearest_held(met, ["cell", "part"], k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "_id", F.round("exact", 6).alias("similarity"), "rank")
