"""Building the indexes of books step by step: what an enricher and an embedder have said before is not asked again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.operators import indexes
from textbank.operators.chunking import embed
from textbank.operators.common import cut
from textbank.operators.folds import numbered

#: Entries that an enricher sees in one call.
CALL = 10


@dataclass(frozen=True)
class Kind:
    """How one index is built: its entries (before those of one id are told apart, if a column is enriched), that column, what a reply says of it, what stands in its place, and the text to embed.

    fallback maps each enriched column to what it is without a reply; parse gives
    batch_id, i and the columns of said, in the order of fallback.
    """

    build: Callable[[DataFrame], DataFrame]
    text: Callable[[], Column]
    enriched: str | None = None
    parse: Callable[[DataFrame], DataFrame] | None = None
    said: tuple[str, ...] = ()
    fallback: tuple[tuple[str, str, Callable[[], Column]], ...] = ()


def _of(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


KINDS = {
    "formulas": Kind(
        indexes.formula_entries, lambda: indexes.formula_text(*_of("concept_label", "formula_plain", "context_sentence")), "formula_latex", indexes.parse_enrichment, ("label", "plain", "variables"),
        (("concept_label", "string", lambda: F.lit("")), ("formula_plain", "string", lambda: F.col("formula_latex")), ("variables", "map<string,string>", lambda: F.create_map().cast("map<string,string>"))),
    ),
    "tables": Kind(
        lambda chunks: indexes.table_entries(chunks).withColumn("headers", indexes.headers(F.col("table_markdown"))), lambda: indexes.table_text(*_of("table_summary", "headers", "table_markdown")), "table_markdown", indexes.parse_summaries, ("summary",),
        (("table_summary", "string", lambda: F.substring(F.array_join("headers", ", "), 1, 200)),),
    ),
    "figures": Kind(
        indexes.figure_entries, lambda: indexes.figure_text(*_of("figure_kind", "caption", "description")), "description", indexes.parse_kinds, ("kind", "axis_summary"),
        (("figure_kind", "string", lambda: F.lit("other")), ("axis_summary", "string", lambda: F.lit(""))),
    ),
    "exercises": Kind(indexes.build_exercises, lambda: indexes.exercise_text(*_of("label", "stem", "options", "math_text", "table_markdown", "figure_desc"))),
}


def kind_of(index: str) -> Kind:
    if index not in KINDS:
        raise ValueError(f"no index is called {index!r}; there are {', '.join(KINDS)}")
    return KINDS[index]


def cache_key(index: str, normal: Column) -> Column:
    """Entries of one normal form share what was said of them."""
    return F.concat(F.lit(f"{index}:"), F.sha1(normal.cast("binary")))


def ask_about(missing: DataFrame, texts: DataFrame, index: str, ask: Callable[[list[str]], str], size: int = CALL) -> DataFrame:
    """_id and payload (JSON) of what an enricher says of the missing (_id), in numbered calls of `size` texts; of the texts (_id, text) of one id the least is sent.

    ask gets the texts of a call, numbered from 1 in its reply; a call that fails
    or cannot be read adds nothing, so that a later build asks again. Each call is
    made once, in whichever task holds it. Ids alone are numbered, so that a text
    is shuffled twice: to its number and to its call.
    """
    kind = kind_of(index)
    placed = numbered(missing.select("_id", F.lit(0).alias("all_")), ["all_"], ["_id"], "place_")
    calls = cut(placed.select("_id", F.floor((F.col("place_") - 1) / size).alias("batch_id"), ((F.col("place_") - 1) % size + 1).cast("int").alias("i")))
    least = texts.groupBy("_id").agg(F.min("text").alias("text")).join(calls, "_id")  # gathered first, as an id may be very frequent
    own = least.groupBy("batch_id").agg(F.count("*").cast("int").alias("batch_size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))

    def said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw: list[str | None] = []
            for texts in pdf["texts"]:
                try:
                    raw.append(ask(list(texts)))
                except Exception:  # noqa: BLE001  a service fails in its own ways
                    raw.append(None)
            yield pd.DataFrame({"batch_id": pdf["batch_id"], "batch_size": pdf["batch_size"], "raw": raw})

    replies = cut(own.mapInPandas(said, "batch_id long, batch_size int, raw string"))
    told = kind.parse(replies).groupBy("batch_id", "i").agg(F.first(F.struct(*kind.said)).alias("r")).select("batch_id", "i", "r.*")
    fields = F.to_json(F.struct(*[F.col(said_).alias(name) for said_, (name, *_) in zip(kind.said, kind.fallback, strict=True)]))
    return calls.join(told, ["batch_id", "i"]).select("_id", fields.alias("payload"))


def build_index(index: str, chunks: DataFrame, cache: DataFrame | None = None, ask: Callable[[list[str]], str] | None = None, embedder: Callable[[list[str]], list] | None = None, size: int = CALL) -> tuple[DataFrame, DataFrame | None]:
    """(entries of the index, what the cache lacked): one row for each formula, table, figure or exercise of the chunks.

    Entries that the cache (_id, payload) knows get its fields; of the others each
    different one is asked about once, in calls of `size`, and what no reply says
    keeps its fallback. Chunks are read anew for the entries' keys, for the texts
    to be asked about and for the entries, of which no copy is kept: cut chunks that
    are dear to make. With an embedder, which gets a list of texts and returns a
    vector or nothing for each, entries without a vector are dropped. The second
    frame (_id, payload) is to be written to the cache; it is nothing for an index
    that is not enriched, or without an enricher.
    """
    kind = kind_of(index)
    entries, new = kind.build(chunks), None
    if kind.enriched:
        entries = entries.withColumn("cache_key_", cache_key(index, F.col("normal")))
        payload = "struct<" + ",".join(f"{name}:{type_}" for name, type_, _ in kind.fallback) + ">"
        known = None
        if cache is not None or ask is not None:
            wanted = entries.select(F.col("cache_key_").alias("_id")).distinct()
            # Cut, as the caller may write to the cache before reading the entries.
            if cache is not None:
                met = cut(wanted.join(cache.select("_id", "payload", F.lit(True).alias("hit_")), "_id", "left").groupBy("_id").agg(F.max("payload").alias("payload"), F.max("hit_").alias("hit_")))
                known, missing = met.where("hit_").select("_id", "payload"), met.where("hit_ IS NULL").select("_id")
            else:
                missing = wanted
        if ask is not None:
            texts = entries.select(F.col("cache_key_").alias("_id"), F.col(kind.enriched).alias("text"))
            new = cut(ask_about(missing, texts, index, ask, size))
            known = new if known is None else known.unionByName(new)
        entries = indexes.first_of_id(entries)
        if known is None:
            entries = entries.withColumn("payload", F.lit(None).cast("string"))
        else:
            entries = entries.join(known.withColumnRenamed("_id", "cache_key_"), "cache_key_", "left")
        entries = entries.withColumn("said_", F.from_json("payload", payload)).drop("payload", "cache_key_")
        given = lambda name, type_: F.nullif(F.col(f"said_.{name}"), F.lit("")) if type_ == "string" else F.col(f"said_.{name}")
        entries = entries.withColumns({name: F.coalesce(given(name, type_), other()) for name, type_, other in kind.fallback}).drop("said_")
    if embedder is not None:
        entries = embed(entries.withColumn("text", kind.text()), embedder).drop("text").where(F.size("embedding") > 0)
    return entries, new
