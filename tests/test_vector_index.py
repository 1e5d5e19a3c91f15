"""An index of vectors: exact with all candidates, recall with a part of them, extended, and odd vectors."""

import pytest
from pyspark.sql import functions as F

from textbank.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("_id"), "embedding").cache()


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["_id"], r["similarity"]) for r in frame.collect())


def test_recall(spark, vectors, tmp_path, monkeypatch):
    """2,000 vectors without any structure: 1,400 candidates hold at least 0.95 of the five nearest, all of them all."""
    monkeypatch.setattr(vector_index, "HELD", 20)
    q = vectors.where("_id % 50 = 0").withColumnRenamed("_id", "query_id")
    exact = rows(retrieval.vector_topk(q, vectors, 5))
    vector_index.write_index(vectors, f"{tmp_path}/all")
    assert rows(vector_index.search_index(q, f"{tmp_path}/all", 5, 10**6)) == exact
    some = rows(vector_index.search_index(q, f"{tmp_path}/all", 5, 1400))
    found = {(a, c) for a, _, c, _ in some} & {(a, c) for a, _, c, _ in exact}
    assert len(found) >= 0.95 * len(exact)


def test_extension(spark, vectors, tmp_path):
    q = vectors.where("_id % 100 = 0").withColumnRenamed("_id", "query_id")
    vector_index.write_index(vectors.where("_id % 3 = 1"), f"{tmp_path}/i")
    for _ in range(2):
        vector_index.extend_index(vectors.where("_id % 3 < 2").unionByName(vectors.where("_id = 0")), f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/vectors").count() == vectors.where("_id % 3 < 2").count()
    assert rows(vector_index.search_index(q, f"{tmp_path}/i", 3, 10**6)) == rows(retrieval.vector_topk(q, vectors.where("_id % 3 < 2"), 3))


def test_odd_vectors(spark, tmp_path):
    schema = "_id long, embedding array<float>"
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0]), (7, [1.0, None]), (8, [2.0, 0.0])], schema)
    vector_index.write_index(frame, f"{tmp_path}/i")
    q = spark.createDataFrame([(10, [3.0, 0.0]), (11, None), (12, [1.0]), (13, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert rows(vector_index.search_index(q, f"{tmp_path}/i", 2, 100)) == [(10, 1, 1, 1.0), (10, 2, 8, 1.0)]
    with pytest.raises(ValueError, match="no row"):
        vector_index.write_index(frame.where("_id > 2 AND _id < 6"), f"{tmp_path}/none")
