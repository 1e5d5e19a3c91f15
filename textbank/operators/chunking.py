"""Chunks: splitting, merging, redundancy, validation, identity."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType
from pyspark.sql.window import Window

from textbank.functions.text import let, strip, text_or_empty, tokens
from textbank.functions.vectors import cosine
from textbank.operators.common import cut, small
from textbank.operators.folds import numbered

#: Where a text may be cut, coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")
#: Words of a text in lower case: letters and digits of any script, of which those of most words are seen first.
_WORDS = r"(?U)[a-z0-9\w]+"


def merge_small(parts: Column, least: int, joiner: str = "\n\n") -> Column:
    """Parts with each one that is shorter than least joined to the one before it."""
    def add(done: Column, x: Column) -> Column:
        joined = F.concat(F.try_element_at(done, F.lit(-1)), F.lit(joiner), x)
        return F.when((F.size(done) > 0) & (F.length(x) < least), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def recursive_split(most: int = 3000, least: int = 300, overlap: int | None = None):  # noqa: ANN201
    """A column function that cuts texts into parts of at most `most` characters at the coarsest separator that will do.

    Each part starts with the end of the one before it, `overlap` characters
    (200 or a quarter of most); a part shorter than least joins the one before it.
    """
    shared = min(200, most // 4) if overlap is None else overlap

    def cut(text: str, level: int = 0) -> list[str]:
        if len(text) <= most - shared:
            return [text]
        if level == len(SEPARATORS):
            return [text[i : i + most - shared] for i in range(0, len(text), most - shared)]
        pieces = text.split(SEPARATORS[level])
        out: list[str] = []
        for i, p in enumerate(pieces):
            p = p + SEPARATORS[level] if i < len(pieces) - 1 else p
            if out and len(out[-1]) + len(p) <= most - shared:
                out[-1] += p
            else:
                out += cut(p, level + 1)
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def split(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            t = (t or "").strip()
            if not t:
                return []
            if len(t) <= most:
                return [t]
            plain = [p for p in cut(t) if p.strip()]
            parts = [(plain[i - 1][-shared:] if i and shared else "") + p for i, p in enumerate(plain)]
            merged: list[str] = []
            for p, own in zip(parts, plain, strict=True):
                if merged and len(own.strip()) < least:
                    merged[-1] += own
                else:
                    merged.append(p)
            return [p.strip() for p in merged]

        return text.map(one)

    return split


def paragraph_split(text: Column, most: int = 3000) -> Column:
    """Paragraphs packed up to `most` characters; a longer one is cut hard."""
    paragraphs = F.filter(F.transform(F.split(text_or_empty(text), "\n\n"), strip), lambda p: p != "")
    hard = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substr(p, i * most + 1, F.lit(most)))))
    state = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))
    fits = lambda s, p: F.length(s["held"]) + 2 + F.length(p) <= most
    step = lambda s, p: F.when(s["held"] == "", F.struct(p.alias("held"), s["done"].alias("done"))).when(fits(s, p), F.struct(F.concat(s["held"], F.lit("\n\n"), p).alias("held"), s["done"].alias("done"))).otherwise(F.struct(p.alias("held"), F.concat(s["done"], F.array(s["held"])).alias("done")))
    return F.aggregate(hard, state, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(text), r"(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda s: s != "")


def adjacent_distances(rows: DataFrame) -> DataFrame:
    """_id, pos, distance of each sentence (_id, pos, embedding) to the next one; 0 where a vector has no length."""
    after = F.lead("embedding").over(Window.partitionBy("_id").orderBy("pos"))
    similarity = cosine(F.col("embedding"), F.col("after"))
    return rows.withColumn("after", after).where("after IS NOT NULL").select("_id", "pos", F.when(similarity == 0, 0.0).otherwise(1 - similarity).alias("distance"))


def breakpoints(distances: DataFrame, percentile: int = 80, least: int = 6) -> DataFrame:
    """_id, pos, cut: whether the text breaks behind a sentence: its distance lies above the percentile; never in texts of fewer than `least` sentences."""
    place = F.row_number().over(Window.partitionBy("_id").orderBy("distance"))
    n = distances.groupBy("_id").agg(F.count("*").alias("n"))
    at = F.least(F.col("n"), F.floor(F.col("n") * percentile / 100) + 1)
    threshold = distances.select("_id", "distance", place.alias("place")).join(n, "_id").where(F.col("place") == at).select("_id", "n", F.col("distance").alias("threshold"))
    return distances.join(threshold, "_id").select("_id", "pos", ((F.col("n") + 1 >= least) & (F.col("distance") > F.col("threshold"))).alias("cut"))


def assemble(rows: DataFrame, cuts: DataFrame, least: int = 300) -> DataFrame:
    """_id, parts: sentences (_id, pos, sentence) joined between cuts; short parts join the one before."""
    own = Window.partitionBy("_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum(F.coalesce(F.col("cut"), F.lit(False)).cast("int")).over(own), F.lit(0))
    grouped = rows.join(cuts, ["_id", "pos"], "left").withColumn("part", part).groupBy("_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    return grouped.groupBy("_id").agg(merge_small(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), least, " ").alias("parts"))


def semantic_quota(chunks: DataFrame, group: str, share: float = 0.2, least: int = 1500) -> DataFrame:
    """Which chunks to split by meaning: of each group's long ones those of highest teaching density, a share of all its chunks."""
    n = small(cut(chunks.groupBy(group).agg(F.count("*").alias("n_"))))
    marked = chunks.withColumn("long_", F.coalesce(F.length("text") >= least, F.lit(False)))
    placed = numbered(marked, [group, "long_"], [F.desc("teaching_density"), "_id"], "place_")
    same = lambda a, b: a.eqNullSafe(b)
    joined = placed.join(n.withColumnRenamed(group, "group_"), same(F.col(group), F.col("group_")))
    return joined.withColumn("chosen", F.col("long_") & (F.col("place_") <= F.ceil(F.col("n_") * share))).select(*chunks.columns, "chosen")


def redundant(part: Column, base: Column, threshold: float = 0.8) -> Column:
    """Whether a share of the part's words stands in the base; an empty part is."""
    both = F.struct(tokens(part, _WORDS).alias("own"), tokens(base, _WORDS).alias("other"))

    def told(s: Column) -> Column:
        # Different words that the base lacks, found by hashing; only if they are few the words are counted one by one.
        lacked = F.array_except(s["own"], s["other"])
        share = lambda lack: (F.size(s["own"]) - F.size(F.filter(s["own"], lambda t: F.array_contains(lack, t)))) / F.size(s["own"])
        few = lambda lack: F.when(F.size(lack) == 0, threshold <= 1).when((F.size(s["own"]) - F.size(lack)) / F.size(s["own"]) < threshold, False).otherwise(share(lack) >= threshold)
        return F.when(F.size(s["own"]) == 0, True).otherwise(let(lacked, few))

    return let(both, told)


def embedding_text(text: Column, tables: Column, images: Column, math: Column) -> Column:
    """Text with what tables (1500 characters), images (1200) and formulas (800) add to it."""
    novel = lambda c, cap: F.when(~redundant(c, text), F.substring(c, 1, cap))
    return F.concat_ws("\n\n", text, novel(F.array_join(tables, "\n"), 1500), novel(F.array_join(images, "\n"), 1200), novel(math, 800))


def drop_repeated_content(text: Column, tables: Column) -> Column:
    """Text without lines of three words and more of which a table has three quarters; the whole text if nothing would be left."""
    known = F.array_distinct(F.flatten(F.transform(F.coalesce(tables, F.array().cast("array<string>")), lambda t: tokens(t, _WORDS))))

    def novel(known: Column) -> Column:
        # Different words that the tables lack, found by hashing; only if they are few the words are counted one by one.
        lacking = lambda own, lack: F.size(F.filter(own, lambda t: F.array_contains(lack, t)))
        few = lambda own, lack: F.when(F.size(lack) == 0, True).when(F.size(own) - F.size(lack) < 0.75 * F.size(own), False).otherwise(F.size(own) - lacking(own, lack) >= 0.75 * F.size(own))
        told = lambda own: (F.size(own) >= 3) & let(F.array_except(own, known), lambda lack: few(own, lack))
        return F.filter(F.split(text, "\n"), lambda x: ~let(tokens(x, _WORDS), told))

    kept = F.array_join(let(known, novel), "\n")
    return F.when(strip(kept) == "", text).otherwise(kept)


def drop_repeated_math(math: Column, text: Column, tables: Column, threshold: float = 0.92) -> Column:
    """math, or the empty string if text and tables have nearly all of its words."""
    every = F.concat(F.array(text), F.coalesce(tables, F.array().cast("array<string>")))
    base = F.concat_ws("\n", F.array_distinct(every))  # a table that is the text is read once
    repeated = redundant(math, base, threshold) & F.lower(text_or_empty(math)).rlike(r"(?U)\w")
    return F.when(F.coalesce(repeated, F.lit(False)), "").otherwise(math)


def validate(chunks: DataFrame) -> DataFrame:
    """chunks with trimmed fields, titles and formulas capped, arrays without blanks and repetitions, and page ranges the right way round.

    text is whole; math_text has 4,000 characters at most, chapter_title and
    section_title 300, "Unknown" standing for a missing chapter. math_text and
    chapter_title may be missing from chunks.
    """
    array = lambda c, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), strip), lambda x: x != "")), 1, n)
    trimmed = lambda c, n: F.substring(strip(text_or_empty(c)), 1, n)
    more = {"math_text": trimmed(F.col("math_text"), 4000)} if "math_text" in chunks.columns else {}
    if "chapter_title" in chunks.columns:
        more["chapter_title"] = trimmed(F.coalesce(F.nullif(F.col("chapter_title"), F.lit("")), F.lit("Unknown")), 300)
    return chunks.withColumns(
        {
            **more,
            "text": strip(text_or_empty(F.col("text"))),
            "section_title": trimmed(F.col("section_title"), 300),
            "table_texts": array("table_texts", 20),
            "image_texts": array("image_texts", 20),
            "key_terms": array("key_terms", 30),
            "page_start": F.least("page_start", "page_end"),
            "page_end": F.greatest("page_start", "page_end"),
        }
    )


def chunk_id(book_hash: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", book_hash, page_start.cast("string"), page_end.cast("string"), F.substring(text, 1, 2000)).cast("binary")), 1, 24)


def entry_id(book_hash: Column, parent: Column, normal: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", book_hash, parent.cast("string"), normal).cast("binary")), 1, 24)


def accept_repair(raw: Column, text: Column, math: Column) -> Column:
    """Struct of text and math_text of a repair, or the originals if the reply is unreadable or of implausible length."""
    r = F.from_json(F.nullif(F.regexp_extract(text_or_empty(raw), r"(?s)\{.*\}", 0), F.lit("")), "struct<text:string,math_text:string>")
    n, m = F.length(text), F.length(strip(r["text"]))
    ok = F.coalesce((m > 0) & (m >= 0.7 * n) & (m <= 1.4 * n + 50), F.lit(False))
    return F.struct(F.when(ok, strip(r["text"])).otherwise(text).alias("text"), F.when(ok, F.coalesce(r["math_text"], math)).otherwise(math).alias("math_text"), ok.alias("accepted"))


def cache_split(rows: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with what the cache has for their key, rows whose key it lacks); the second is what an enricher has to see."""
    keyed = rows.withColumn("cache_key", key)
    known = cache.select(F.col("_id").alias("cache_key"), F.col("payload"))
    return keyed.join(known, "cache_key"), keyed.join(known, "cache_key", "left_anti")


def enrich(rows: DataFrame, enricher, schema: str):  # noqa: ANN001, ANN201
    """rows through a caller's function of pandas batches, in batches of Arrow."""
    return rows.mapInPandas(lambda batches: (enricher(b) for b in batches), schema)


def embed(rows: DataFrame, embedder, batch: int = 100) -> DataFrame:  # noqa: ANN001
    """rows (with a column text) with embedding, from a caller's function of a list of texts, called with at most batch texts."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            yield pdf.drop(columns="embedding", errors="ignore").assign(embedding=[v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])])

    return rows.mapInPandas(run, StructType([*(f for f in rows.schema if f.name != "embedding"), StructField("embedding", ArrayType(FloatType()))]))


def hash_embedder(texts: list[str], width: int = 64) -> list[list[float]]:
    """A deterministic embedding by hashed words, for tests and examples."""
    out = []
    for t in texts:
        v = [0.0] * width
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % width] += 1.0 if h >> 16 & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out
