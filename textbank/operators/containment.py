"""Which texts contain which strings, by automata of all strings at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textbank.operators.common import cut, small

#: Characters of the strings in one automaton.
BLOCK_CHARS = 1 << 21


def automaton(strings: Iterable[tuple[int, str]]):  # noqa: ANN201
    """Finds the numbers of all strings in a text in one pass over it."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for no, s in strings:
        found.add_word(s, no)
    if len(found):
        found.make_automaton()
    return found


def _held(finder, text: str | None) -> set[int]:  # noqa: ANN001
    return {no for _, no in finder.iter(text)} if text and len(finder) else set()


def containment(needles: DataFrame, docs: DataFrame, key: str = "query_id") -> DataFrame:
    """The key and _id of each needle (key, needle) and document (_id, text) that contains it, in any case, once each.

    A needle may have any length; blank and null ones are in nothing, nor is
    anything in a null text. Repeated rows of either side count once, a null key
    or _id is a value like others. Needles of up to BLOCK_CHARS characters in all,
    which are counted first, go to every task as one automaton and the documents
    are not moved. More of them are dealt into blocks; a document goes to a task
    for each block, and needles and documents meet there by block and part, so
    that a task holds one block and streams its documents, whatever their number.
    """
    spark = docs.sparkSession
    needles = cut(needles.select(key, F.lower(F.col("needle").cast("string")).alias("needle")).where(F.length(F.trim("needle")) > 0).distinct())
    strings = cut(needles.select("needle").distinct().withColumn("no", F.monotonically_increasing_id()))
    chars = strings.agg(F.sum(F.length("needle"))).first()[0] or 0
    kind = StructType([StructField("_id", docs.schema["_id"].dataType), StructField("no", strings.schema["no"].dataType)])
    texts = docs.select("_id", F.lower(F.col("text").cast("string")).alias("text"))

    def hits(ids: pa.Array, texts: pa.Array, finder) -> pa.RecordBatch:  # noqa: ANN001
        at, nos = [], []
        for i, text in enumerate(texts.to_pylist()):
            own = _held(finder, text)
            at += [i] * len(own)
            nos += own
        return pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(nos, pa.int64())], names=["_id", "no"])

    if chars <= BLOCK_CHARS:
        every = [(r["no"], r["needle"]) for r in strings.collect()]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = automaton(every)
            for batch in batches:
                yield hits(batch.column(0), batch.column(1), finder)

        found = texts.mapInArrow(scan, kind)
    else:
        blocks = -(-chars // BLOCK_CHARS)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        none = F.lit(None).cast(kind["_id"].dataType)
        own = strings.select(F.pmod(F.xxhash64("needle"), F.lit(blocks)).cast("int").alias("block"), spread(parts).alias("part"), F.lit(0).alias("side"), "no", none.alias("_id"), F.col("needle").alias("text"))
        dealt = texts.select(spread(blocks).alias("block"), F.pmod(F.xxhash64("_id", "text"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("no"), "_id", "text")
        met = own.unionByName(dealt).repartition("block", "part").sortWithinPartitions("block", "part", "side")

        def scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, strings_, finder = None, [], None
            for batch in batches:
                get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
                marks = list(zip(get("block").to_pylist(), get("part").to_pylist(), get("side").to_pylist(), strict=True))
                start = 0
                for i in range(1, batch.num_rows + 1):
                    if i < batch.num_rows and marks[i] == marks[start]:
                        continue
                    block, part, side = marks[start]
                    if (block, part) != last:
                        last, strings_, finder = (block, part), [], None
                    ids, text, nos = (get(c).slice(start, i - start) for c in ("_id", "text", "no"))
                    if side == 0:
                        strings_ += zip(nos.to_pylist(), text.to_pylist(), strict=True)
                    else:
                        finder = finder or automaton(strings_)
                        yield hits(ids, text, finder)
                    start = i

        found = met.mapInArrow(scan_blocks, kind)
    named = small(cut(needles.join(strings, "needle").select("no", key)))
    return found.join(named, "no").select(key, "_id").distinct()
