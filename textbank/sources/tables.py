"""Reading, writing and maintaining tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbank.functions.text import safe_csv

#: A page of a book.
PAGE = "book_id string, page int, text string, table_texts array<string>, image_texts array<string>"
#: A golden set: queries with the pages or strings that answers must have.
GOLDEN = "book_id string, queries array<struct<query:string,chapter_num:int,expect:struct<pages:array<int>,contains:array<string>>>>"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages from parquet or JSON by their schema, or text files, each of which is one page."""
    if kind == "text":
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("book_id"), F.lit(1).alias("page"), F.col("value").alias("text"), F.array().cast("array<string>").alias("table_texts"), F.array().cast("array<string>").alias("image_texts"))
    return spark.read.schema(PAGE).format(kind).load(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """book_id, query_id, query, chapter_num, pages, contains; a file without queries is an error."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True).select("book_id", F.posexplode("queries").alias("query_id", "q")).select("book_id", "query_id", "q.query", "q.chapter_num", F.col("q.expect.pages").alias("pages"), F.col("q.expect.contains").alias("contains"))
    if rows.isEmpty():
        raise ValueError(f"{path} has no queries")
    return rows


def scan(rows: DataFrame, predicate: str, columns: list[str]) -> DataFrame:
    """Columns of the rows that meet a predicate; both reach the files' scan."""
    return rows.where(predicate).select(*columns)


def metrics(rows: DataFrame, texts: list[str], vectors: list[str] = (), keep: list[str] = ("_id",)) -> DataFrame:
    """Lengths of the texts and widths of the vectors, without either."""
    return rows.select(*keep, *[F.coalesce(F.length(c), F.lit(0)).alias(f"{c}_length") for c in texts], *[F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0)).alias(f"{c}_width") for c in vectors])


def write_csv(rows: DataFrame, path: str) -> None:
    """rows as CSV with a header, safe to open as a spreadsheet."""
    kinds = dict(rows.dtypes)
    rows.select(*[safe_csv(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns]).write.mode("overwrite").csv(path, header=True)


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Each table that has rows as JSON files under its name."""
    for name, rows in tables.items():
        if not rows.isEmpty():
            rows.write.mode("overwrite").json(f"{path}/{name}")


def restore(spark: SparkSession, path: str, schemas: dict[str, str], target: str) -> list[str]:
    """Replaces the tables of target by those dumped under path, and names them; what is missing or empty there stays."""
    done = []
    for name, schema in schemas.items():
        try:
            rows = spark.read.schema(schema).json(f"{path}/{name}")
            empty = rows.isEmpty()
        except Exception as e:  # noqa: BLE001  Spark's own classes differ between its clients
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        if not empty:
            rows.write.mode("overwrite").parquet(f"{target}/{name}")
            done.append(name)
    return done


def append_new(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to append: with a vector, one of each _id, of ids that target lacks."""
    return rows.where(F.size("embedding") > 0).dropDuplicates(["_id"]).join(target.select("_id"), "_id", "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: str = "_id") -> DataFrame:
    """target with the rows in place of those of the same key."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def refresh(rows: DataFrame, path: str, by: str = "book_id", of: list[str] | None = None) -> None:
    """Replaces the partitions of a table that the rows belong to, and no others; of those named in `of`, which were built anew, the ones without rows go."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if of:
        spark = rows.sparkSession
        left = {r[0] for r in rows.where(F.col(by).isin(of)).select(F.col(by).cast("string")).distinct().collect()}
        for value in set(map(str, of)) - left:
            jvm = spark.sparkContext._jvm
            escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={escaped}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def roll_back(rows: DataFrame, book_hash: str, since: str) -> DataFrame:
    """Without what a book got at or after an instant."""
    return rows.where(~F.coalesce((F.col("book_hash") == book_hash) & (F.col("created_at") >= F.lit(since).cast("timestamp")), F.lit(False)))


def delete_book(rows: DataFrame, book_id: str | None = None, book_hash: str | None = None) -> DataFrame:
    """Without the rows of a book, by id, hash or both; without a criterion nothing goes."""
    match = F.lit(True)
    if book_id is None and book_hash is None:
        return rows
    if book_id is not None:
        match = match & (F.col("book_id") == book_id)
    if book_hash is not None:
        match = match & (F.col("book_hash") == book_hash)
    return rows.where(~F.coalesce(match, F.lit(False)))


def cascade(dead: DataFrame, children: dict[str, tuple[DataFrame, str]], quizzes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """children (rows, name of their key) without rows of dead ids (_id), and quizzes without these ids in question_ids."""
    rest = {name: rows.join(dead.select(F.col("_id").alias(key)), key, "left_anti") for name, (rows, key) in children.items()}
    lines = quizzes.select(F.col("_id").alias("quiz_"), F.posexplode("question_ids").alias("pos", "q")).join(dead.select(F.col("_id").alias("q")), "q", "left_anti")
    kept = lines.groupBy("quiz_").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]).alias("kept_"))
    out = quizzes.join(kept, quizzes["_id"] == kept["quiz_"], "left").withColumn("question_ids", F.coalesce("kept_", F.array().cast(quizzes.schema["question_ids"].dataType))).drop("quiz_", "kept_")
    return rest, out


def resume_points(chunks: DataFrame) -> DataFrame:
    """book_hash, last_page, n_chunks: where to go on without a checkpoint."""
    return chunks.groupBy("book_hash").agg(F.max("page_end").alias("last_page"), F.count("*").alias("n_chunks"))


def back_fill(rows: DataFrame, cache: DataFrame, column: str, needs) -> DataFrame:  # noqa: ANN001
    """_id and the new value of a column where it needs one, the cache (_id = sha1 of the old value, value) has it, and it differs."""
    todo = rows.where(needs(F.col(column))).withColumn("key_", F.sha1(F.col(column).cast("binary")))
    return todo.join(cache.select(F.col("_id").alias("key_"), "value"), "key_").where(F.col("value") != F.col(column)).select("_id", F.col("value").alias(column))
