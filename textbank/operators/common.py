"""What operators share: lineage cut in the cluster's own folder, and joins that are broadcast only after counting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of fixed width up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 512


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the shared checkpoint folder that the session names; a session of one machine may have a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows. Count something cut, or it runs twice."""
    return F.broadcast(df) if df.count() <= most else df


def short_batches() -> None:
    """Sets the session's Arrow batches to TEXT_ROWS if they are larger: a worker holds a whole batch of texts several times over."""
    spark, key = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)
