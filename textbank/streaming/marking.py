"""Marking of submissions as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from textbank.operators import marking
from textbank.operators.chunking import embed
from textbank.operators.common import cut
from textbank.sources.keyed import read_keyed, upsert_keyed

OBJECTIVE = ("mcq", "true_false")
#: Columns of an outcome.
OUTCOME = ("_id", "auto_mark", "is_flagged", "is_marked", "auto_feedback")


def _embedded(rows: DataFrame, text: str, name: str, embedder: Callable[[list[str]], list] | None) -> DataFrame:
    """rows with a vector of the text column under name; null without an embedder."""
    if embedder is None:
        return rows.withColumn(name, F.lit(None).cast("array<float>"))
    return embed(rows.withColumn("text", F.coalesce(text, F.lit(""))), embedder).withColumnRenamed("embedding", name).drop("text")


def _replies(rows: DataFrame, marker: Callable[[dict], str]) -> DataFrame:
    """rows with raw, what the marker says of each row that has not the route HIGH, and reason, why it could not say it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, reason = [], []
            for row in pdf[["question_text", "answer_text", "rubric", "max_marks", "route"]].to_dict("records"):
                said = why = None
                if row["route"] != "HIGH":
                    try:
                        said = marker(row)
                    except Exception as e:  # noqa: BLE001  a service fails in its own ways
                        why = str(e) or type(e).__name__
                raw.append(said)
                reason.append(why)
            yield pdf.assign(raw=raw, reason=reason)

    return rows.mapInPandas(run, StructType([*rows.schema, StructField("raw", StringType()), StructField("reason", StringType())]))


def mark(submissions: DataFrame, questions: DataFrame, marker: Callable[[dict], str], embedder: Callable[[list[str]], list] | None = None) -> DataFrame:
    """The outcome (OUTCOME) of each submission (_id, question_id, answer_text).

    questions has _id, question_text, question_type, correct_answer, model_answer,
    rubric and max_marks. Objective answers are held against their key; others are
    scored by keywords and similarity, and what does not get full marks by that
    goes to the marker, a function of one row that returns its reply. A submission
    of an unknown question, or one that the marker fails on, is marked as failed.
    Questions are joined by key; of repeated submissions one counts.
    """
    rows = submissions.select("_id", "question_id", "answer_text").dropDuplicates(["_id"])
    q = questions.select(F.col("_id").alias("question_id"), "question_text", "question_type", "correct_answer", "model_answer", F.coalesce("rubric", F.lit("")).alias("rubric"), F.col("max_marks").cast("double").alias("max_marks"), F.lit(True).alias("known"))
    joined = rows.join(q, "question_id", "left")
    known = F.coalesce("known", F.lit(False))
    kind = F.coalesce("question_type", F.lit(""))
    lost = marking.failed_outcome(joined.where(~known).select("_id", F.lit("question not found").alias("reason")))

    objective = marking.mark_objective(joined.where(known & kind.isin(*OBJECTIVE)))
    right = F.when(F.col("key").isNull(), "No answer key.").when(F.col("correct"), "Correct.").otherwise("Not correct.")
    of_key = marking.outcome(objective.withColumns({"route": F.col("marking_route"), "confidence": F.when(F.col("key").isNull(), 0.0).otherwise(1.0), "auto_feedback": right}))

    open_ = joined.where(known & ~kind.isin(*OBJECTIVE)).drop("known")
    vectors = _embedded(_embedded(open_, "answer_text", "answer_embedding", embedder), "model_answer", "model_embedding", embedder)
    replied = cut(_replies(marking.pre_score(vectors).drop("answer_embedding", "model_embedding"), marker))  # the marker is asked once
    failed = marking.failed_outcome(replied.where("reason IS NOT NULL").select("_id", "reason"))
    of_marker = marking.outcome(marking.mark_subjective(replied.where("reason IS NULL")))
    return lost.unionByName(of_key).unionByName(of_marker).unionByName(failed).select(*OUTCOME)


def mark_batches(path: str, questions: DataFrame, marker: Callable[[dict], str], embedder: Callable[[list[str]], list] | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that marks what is not marked yet and puts the outcomes into the keyed table at path.

    What the table has is not marked again, so a batch that comes twice asks no
    marker and changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        done = read_keyed(batch.sparkSession, path)
        rows = batch if done is None else batch.join(done.select("_id"), "_id", "left_anti")
        upsert_keyed(mark(cut(rows), questions, marker, embedder), path, buckets=buckets)

    return write


def mark_stream(submissions: DataFrame, questions: DataFrame, path: str, checkpoint: str, marker: Callable[[dict], str], embedder: Callable[[list[str]], list] | None = None, buckets: int = 64) -> DataStreamWriter:
    """The writer of a stream that marks submissions into the table at path; questions are static and joined anew for each batch."""
    return submissions.writeStream.foreachBatch(mark_batches(path, questions, marker, embedder, buckets)).option("checkpointLocation", checkpoint)
