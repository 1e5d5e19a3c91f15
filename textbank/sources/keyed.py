"""A table that is unique by a key, in hash buckets, of which a write touches only those it has rows for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textbank.operators.common import cut
from textbank.sources.tables import upsert

#: The partition column says into how many buckets keys are dealt, so that a table is never read or written by another number.
_BUCKET = "bucket_of_"
BUCKETS = 64


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  Spark's own classes differ between its clients
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the table, or nothing if it was never written."""
    rows = _there(spark, path)
    return None if rows is None else rows.drop(*[c for c in rows.columns if c.startswith(_BUCKET)])


def upsert_keyed(rows: DataFrame, path: str, key: str = "_id", order: str | None = None, buckets: int = BUCKETS) -> None:
    """Puts the rows in place of those of the same key; other buckets keep their files.

    Of several rows of a key the one greatest in `order` counts, or without an
    order any. Writing the same rows again changes nothing, so a repeated or
    interrupted write is made good by another. The number of buckets is fixed by
    the first write. Rows of a null key are one key.
    """
    spark = rows.sparkSession
    table = _there(spark, path)
    name = next((c for c in table.columns if c.startswith(_BUCKET)), None) if table is not None else f"{_BUCKET}{buckets}"
    rest = [c for c in rows.columns if c != key]
    if order is None:
        new = rows.dropDuplicates([key])
    else:
        new = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r_")).select(key, "r_.*").select(*rows.columns)
    new = cut(new.withColumn(name, _bucket(key, int(name.removeprefix(_BUCKET)))))
    if table is not None:
        touched = [r[0] for r in new.select(name).distinct().collect()]
        # Cut, as the files that are read here are replaced by the write.
        new = cut(upsert(table.where(F.col(name).isin(touched)).select(*new.columns), new, key))
    new.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def upsert_batches(path: str, key: str = "_id", order: str | None = None, buckets: int = BUCKETS):  # noqa: ANN201
    """A foreachBatch function that keeps a table unique by key; the number of a batch does not matter, nor that one comes twice."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_keyed(batch, path, key, order, buckets)

    return write
