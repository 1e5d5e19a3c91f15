"""Set operations within groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_with_previous(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n_shared: different words that a turn shares with the one before it."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("before", before).where("before IS NOT NULL").select("conv_id", "turn", F.size(F.array_intersect(words(F.col("text")), words(F.col("before")))).alias("n_shared"))


def ranked_in(docs: DataFrame, group: str, most: int) -> DataFrame:
    """query_id, _id, lang, rank: the longest documents of each group."""
    own = Window.partitionBy(group).orderBy(F.desc("n_chars"), "doc_id")
    return docs.select(F.col(group).alias("query_id"), F.col("doc_id").alias("_id"), "lang", F.row_number().over(own).alias("rank")).where(F.col("rank") <= most)
