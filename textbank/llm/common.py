"""What the operators of this subpackage share: reading, cutting lineage, Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python task turns into numpy arrays at once; a longer text is taken alone and whole.
SLICE_BYTES = 1 << 19
#: Texts that Spark sends to a Python task in one Arrow batch.
BATCH_ROWS = 512
#: Rows of fixed width up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder.

    The shuffle files that led to it are no longer needed and go at once. On a
    cluster spark.checkpoint.dir must name the folder; a session of one machine
    without it gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for frames made under it
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is. Count something cut, or it runs twice."""
    return F.broadcast(df) if df.count() <= max_rows else df


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; -1 for a null id, which is thus in no held-out part."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(-1))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `most` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def map_texts(df: DataFrame, per_slice: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, most: int = SLICE_BYTES) -> DataFrame:
    """per_slice over df in slices of whole texts, in Arrow, without a shuffle. Sets the session's Arrow batches to BATCH_ROWS if they are larger: texts are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most=most):
            yield per_slice(piece)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` labelled documents, chosen by a hash of the id.

    labels has doc_id and the label column; train is a condition on doc_id. A doc_id
    with several labels counts with the least, one with several texts with the
    first in order, so `most` bounds the rows. Only ids and labels of the sample,
    whose number it bounds too, are broadcast.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("long").alias("label"))
        .where(train & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
