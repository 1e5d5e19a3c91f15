"""Indexes built from chunks: formulas, figures, tables and exercises."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from textbank.functions.text import json_array, let, strip, text_or_empty
from textbank.operators.chunking import entry_id, sentences
from textbank.operators.folds import numbered

#: What makes a line a formula.
FORMULA_LINE = r"[=√∑∏∫±≤≥≠^]|\\frac|\\sqrt|\\sum|\bsqrt\("
#: The kinds of figures.
FIGURE_KINDS = ("histogram", "bar", "scatter", "boxplot", "line", "pie", "diagram", "table", "other")
CAPTION = r"(?imd)^[ \t\n\f\r]*+(?:Figure|Fig\.)[ \t\n\f\r]++\d[^\n]*"


def _normal(c: Column, cap: int = 300) -> Column:
    return F.substring(F.lower(F.regexp_replace(c, r"\s+", "")), 1, cap)


def _ids(entries: DataFrame) -> DataFrame:
    """entries with _id, by their normal form."""
    return entries.withColumn("_id", entry_id(F.col("book_id"), F.col("parent_chunk_id"), F.col("normal")))


def first_of_id(entries: DataFrame) -> DataFrame:
    """One row an id, the first by place, without the normal form. Shuffles whichever columns are read of it."""
    own = Window.partitionBy("_id").orderBy("place")
    return entries.drop("normal").withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")


def _first_distinct(chunks: DataFrame, texts: Column, most: int | None = None, carry: str = "text") -> DataFrame:
    """_id, book_id, the carried column, entry, normal, place: the different entries of each chunk in order, told apart by their normal form; the first `most` if that is given.

    All within the chunk's row: nothing is shuffled, so that what is carried is not copied to disk for each entry.
    """
    ordered = F.array_sort(F.transform(texts, lambda x, i: F.struct(_normal(x).alias("normal"), i.alias("pos"), x.alias("entry"))))
    once = let(ordered, lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["normal"] != x["normal"])))
    own = F.array_sort(F.transform(once, lambda x: F.struct(x["pos"].alias("pos"), x["entry"].alias("entry"), x["normal"].alias("normal"))))
    # The outer form, as for the other one Spark puts a filter on the array below it and makes all entries twice.
    rows = chunks.select("_id", "book_id", carry, F.posexplode_outer(own if most is None else F.slice(own, 1, most)).alias("at", "x")).where("x IS NOT NULL")
    return rows.select("_id", "book_id", carry, F.col("x.entry").alias("entry"), F.col("x.normal").alias("normal"), (F.col("at") + 1).alias("place"))


def split_formulas(chunks: DataFrame, most: int = 12, carry: str = "text") -> DataFrame:
    """_id, book_id, the carried column, entry, normal, place: lines of math_text of four characters and more, then prose lines that look like formulas."""
    lines = lambda c: F.filter(F.transform(F.split(text_or_empty(c), "\n"), strip), lambda x: F.length(x) >= 4)
    wordy = lambda x: F.regexp_count(x, F.lit("[A-Za-z]{2,}"))
    prose = F.filter(lines(F.col("text")), lambda x: x.rlike(FORMULA_LINE) & (wordy(x) <= 6))
    return _first_distinct(chunks, F.concat(lines(F.col("math_text")), prose), most, carry)


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"\w+"), F.lit(0)))


def told_sentences(text: Column, least: int = 20) -> Column:
    """Sentences of more than `least` characters with their words, for context_of."""
    return F.transform(F.filter(sentences(text), lambda s: F.length(s) > least), lambda s: F.struct(s.alias("s"), _words(s).alias("words")))


def context_of(entry: Column, told: Column, cap: int = 240) -> Column:
    """Of told_sentences the one that shares most words with the entry, the first of equals; null if none shares one."""
    scored = let(_words(entry), lambda own: F.transform(told, lambda x, i: F.struct(F.size(F.array_intersect(x["words"], own)).alias("score"), (-i).alias("at"), x["s"].alias("s"))))
    return let(F.array_max(scored), lambda best: F.when(best["score"] > 0, F.substring(best["s"], 1, cap)))


def context_sentence(entry: Column, text: Column, cap: int = 240) -> Column:
    """The sentence of more than 20 characters of the text that shares most words with the entry, the first of equals; null if none shares one."""
    return context_of(entry, told_sentences(text), cap)


def formula_entries(chunks: DataFrame) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, formula_latex, context_sentence, normal, before entries of one id are told apart."""
    some = chunks.where((F.coalesce("math_text", F.lit("")) != "") | F.col("text").rlike(FORMULA_LINE))
    own = split_formulas(some.withColumn("told", told_sentences(F.col("text"))), carry="told")
    return _ids(own.select("book_id", F.col("_id").alias("parent_chunk_id"), "place", F.col("entry").alias("formula_latex"), context_of(F.col("entry"), F.col("told")).alias("context_sentence"), "normal"))


def build_formulas(chunks: DataFrame, enriched: DataFrame | None = None) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, formula_latex, context_sentence, concept_label, formula_plain.

    enriched (formula_latex, concept_label, formula_plain) is what an enricher said; without it a formula is its own plain text.
    """
    out = first_of_id(formula_entries(chunks))
    if enriched is not None:
        out = out.join(enriched, "formula_latex", "left")
    else:
        out = out.withColumns({"concept_label": F.lit(None).cast("string"), "formula_plain": F.lit(None).cast("string")})
    return out.withColumns({"formula_plain": F.coalesce("formula_plain", "formula_latex"), "concept_label": F.coalesce("concept_label", F.lit(""))})


def formula_text(label: Column, plain: Column, context: Column) -> Column:
    return F.regexp_replace(F.concat(text_or_empty(label), F.lit(": "), text_or_empty(plain), F.lit(" — "), text_or_empty(context)), "^[ :—]+|[ :—]+$", "")


def parse_enrichment(replies: DataFrame) -> DataFrame:
    """batch_id, i, label, plain, variables from replies (batch_id, batch_size, raw): objects with i in the batch, capped fields, six variables at most."""
    items = replies.select("batch_id", "batch_size", F.inline(json_array(F.col("raw"), "struct<i:int,concept_label:string,formula_plain:string,variables:map<string,string>>")))
    sound = items.where((F.col("i") >= 1) & (F.col("i") <= F.col("batch_size")))
    entries = F.slice(F.filter(F.map_entries(F.coalesce("variables", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()), 1, 6)
    cut = F.transform(entries, lambda e: F.struct(F.substring(e["key"], 1, 20).alias("key"), F.substring(e["value"], 1, 120).alias("value")))
    return sound.select("batch_id", "i", F.substring(F.trim("concept_label"), 1, 120).alias("label"), F.substring(F.trim("formula_plain"), 1, 500).alias("plain"), F.map_from_entries(cut).alias("variables"))


def parse_summaries(replies: DataFrame, most: int = 300) -> DataFrame:
    """batch_id, i, summary from replies about tables: objects with i in the batch and a summary, cut to `most` characters."""
    items = replies.select("batch_id", "batch_size", F.inline(json_array(F.col("raw"), "struct<i:int,table_summary:string>")))
    summary = F.substring(strip(text_or_empty(F.col("table_summary"))), 1, most)
    return items.where((F.col("i") >= 1) & (F.col("i") <= F.col("batch_size")) & (summary != "")).select("batch_id", "i", summary.alias("summary"))


def parse_kinds(replies: DataFrame) -> DataFrame:
    """batch_id, i, kind, axis_summary from classification replies; an unknown kind is other."""
    items = replies.select("batch_id", "batch_size", F.inline(json_array(F.col("raw"), "struct<i:int,kind:string,axis_summary:string>")))
    kind = F.lower(F.trim("kind"))
    return items.where((F.col("i") >= 1) & (F.col("i") <= F.col("batch_size"))).select("batch_id", "i", F.when(kind.isin(*FIGURE_KINDS), kind).otherwise("other").alias("kind"), F.substring(text_or_empty(F.col("axis_summary")), 1, 300).alias("axis_summary"))


def number_batches(rows: DataFrame, group: str, size: int = 10) -> DataFrame:
    """rows with batch and i: their place in calls of `size` rows, by group and _id."""
    place = F.col("place_") - 1
    return numbered(rows, [group], ["_id"], "place_").withColumn("batch", F.floor(place / size)).withColumn("i", (place % size + 1).cast("int")).drop("place_")


def headers(table: Column, most: int = 10) -> Column:
    """Cells of the first full line of a pipe table."""
    line = F.get(F.filter(F.split(text_or_empty(table), "\n"), lambda x: x.rlike(r"\S")), 0)
    cells = F.transform(F.split(F.coalesce(line, F.lit("")), r"\|"), strip)
    return F.slice(F.filter(cells, lambda x: (x != "") & ~x.rlike("^[-: ]+$")), 1, most)


def table_entries(chunks: DataFrame) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, table_markdown, normal, before entries of one id are told apart: tables of 30 characters and more."""
    texts = F.filter(F.transform(F.coalesce("table_texts", F.array().cast("array<string>")), strip), lambda x: F.length(x) >= 30)
    own = _first_distinct(chunks.where(F.size("table_texts") > 0), texts)
    return _ids(own.select("book_id", F.col("_id").alias("parent_chunk_id"), "place", F.col("entry").alias("table_markdown"), "normal"))


def build_tables(chunks: DataFrame) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, table_markdown, headers, table_summary: tables of 30 characters and more."""
    out = first_of_id(table_entries(chunks))
    return out.withColumn("headers", headers(F.col("table_markdown"))).withColumn("table_summary", F.substring(F.array_join("headers", ", "), 1, 200))


def table_text(summary: Column, heads: Column, markdown: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(summary, F.lit("")), F.nullif(F.array_join(heads, ", "), F.lit("")), F.array_join(F.slice(F.split(text_or_empty(markdown), "\n"), 1, 4), "\n"))


def caption_line(text: Column) -> Column:
    """The first line that starts with a figure's number as it stands, with the white space and blank lines before it."""
    return F.regexp_extract(text, CAPTION, 0)


def caption(text: Column) -> Column:
    """The first line that starts with a figure's number, stripped."""
    return strip(caption_line(text_or_empty(text)))


def figure_entries(chunks: DataFrame) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, description, caption, normal, before entries of one id are told apart: descriptions of 20 characters and more."""
    texts = F.filter(F.transform(F.coalesce("image_texts", F.array().cast("array<string>")), strip), lambda x: F.length(x) >= 20)
    own = _first_distinct(chunks.where(F.size("image_texts") > 0).withColumn("caption", caption(F.col("text"))), texts, carry="caption")
    return _ids(own.select("book_id", F.col("_id").alias("parent_chunk_id"), "place", F.col("entry").alias("description"), "caption", "normal"))


def build_figures(chunks: DataFrame) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, description, caption, figure_kind: descriptions of 20 characters and more."""
    return first_of_id(figure_entries(chunks)).withColumn("figure_kind", F.lit("other"))


def figure_text(kind: Column, title: Column, description: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(kind, F.lit("other")), F.nullif(title, F.lit("")), description)


#: Headings of the parts of a chapter that hold exercises.
_HEAD = {
    "homework": r"^\s*HOMEWORK\b",
    "practice": r"^\s*PRACTICE\b",
    "example": r"^\s*(?:EXAMPLE|Example)\s+(\d+\.\d+)\s*$",
    "try_it": r"^\s*(?:TRY\s*IT|Try\s*It)\s*(\d+\.\d+)?\s*$",
    "solution": r"^\s*(?:SOLUTION|Solution)\s*(\d+\.\d+)?\s*$",
    "activity": r"(?i)^\s*(?:COLLABORATIVE(?:\s+EXERCISE)?|STATS?\s+LAB|BRINGING\s+IT\s+TOGETHER|ACTIVITY|DO\s+THIS|THINK\s+ABOUT\s+IT|TRY\s+THESE|GROUP\s+PROJECT)\b\s*[:.]?\s*(.*)$",
}
_SECTION_HEAD = r"^\s*(\d+\.\d+)\s+[A-Z]"
_GROUP_STEM = r"(?i)Use the following information to answer the next\s+([a-z0-9]+)\s+exercises?\s*:?\s*(.*)"
_NUMBERED = r"^\s*(\d{1,3})\.\s*(.*)$"
_OPTION = r"^\s*([a-d])\.\s*(.*)$"
#: Numbers in words.
_NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
ACTIVITY_LINES = 40


def _count(word: Column) -> Column:
    w = F.lower(word)
    named = F.array_position(F.array(*map(F.lit, _NUMBER_WORDS)), w).cast("int")
    return F.coalesce(w.try_cast("int"), named, F.lit(0))


def _one_line(c: Column) -> Column:
    """With single spaces; most texts have them already, which is cheaper to see than to replace."""
    return let(c, lambda x: strip(F.when(x.rlike(r"\s(?:(?<! )|(?=\s))"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)))


def is_junk(text: Column) -> Column:
    """Shorter than 25 characters, or digits and marks only."""
    return (F.length(text) < 25) | text.rlike(r"^[\d\s.,%$()/-]+$")


def _options(body: Column) -> Column:
    """The texts of options a to d among lines, each with the lines up to the next; empty ones go."""
    starts = F.array_compact(F.transform(body, lambda x, i: F.when(x.rlike(_OPTION), i)))
    until = lambda k: F.coalesce(F.get(starts, k + 1), F.size(body))
    own = lambda at, k: F.concat(F.array(F.regexp_extract(F.get(body, at), _OPTION, 2)), F.transform(F.slice(body, at + 2, F.greatest(until(k) - at - 1, F.lit(0))), strip))
    return F.filter(F.transform(starts, lambda at, k: strip(F.array_join(own(at, k), " "))), lambda x: x != "")


#: What an event among the lines of a chunk is to exercise_blocks; its argument is whether an activity has words in its head, and how many items a group stem announces.
_EVENTS = ("homework", "practice", "example", "try_it", "solution", "activity", "section", "group", "item")
#: Lines that may be an event, by their beginning or by what stands in them; all others are looked at no further.
_MAY_BE = (r"^\s*(?:\d|HOMEWORK|PRACTICE|EXAMPLE|Example|SOLUTION|Solution|(?i:COLLAB|STAT|BRINGING|ACTIVITY|DO|THINK|TRY|GROUP))", r"(?i)Use the following information")


def _blocks(n: int, events: list[list[int]]) -> list[list[int]]:
    """Of a chunk of n lines and its events (line, number in _EVENTS, argument) the exercises.

    Each is its number among the chunk's blocks, kind, first line, line behind it,
    line behind its body, section (0, 1, or -1), and the lines of the last section
    and of the group stem that is still due (-1 without one).
    """
    homework, practice, example, try_it, solution, activity, section, group, item = range(len(_EVENTS))
    out: list[list[int]] = []
    place, part, section_line, group_line, due = 0, -1, -1, -1, 0
    open_: list[int] | None = None  # the exercise whose end is not met yet
    box, limit, solved = -1, n, 0  # the kind of box, the line it ends at, and its solutions so far

    def end(line: int) -> None:
        nonlocal open_
        if open_ is not None:
            open_[3] = line
            if open_[4] < 0:
                open_[4] = line
            out.append(open_)
            open_ = None

    for line, what, more in [*events, [n, -1, 0]]:
        if box >= 0 and line >= limit:  # a box that is too long ends by itself, which opens a block of nothing if no head stands there
            end(limit)
            box = -1
            if limit < n and not (line == limit and what in (homework, practice, example, try_it, activity, section, group, item)):
                place += 1
        if what < 0:
            break
        if what == solution:
            if box >= 0:
                solved += 1
                if box != activity and solved == 1:
                    open_[4] = line
                else:
                    end(line)
                    box, place = -1, place + 1
            continue
        if what in (section, group, item) and (box >= 0 or part < 0):
            continue
        end(line)
        place += 1
        if what in (homework, practice):
            part, box, group_line, due = what, -1, -1, 0
        elif what == section:
            section_line, group_line, due = line, -1, 0
        elif what == group:
            group_line, due = line, more
        elif what == item:
            open_ = [place, what, line, -1, -1, part, section_line, group_line if due > 0 else -1]
            due -= 1
        else:
            box, solved, limit = what, 0, line + ACTIVITY_LINES - more + 1 if what == activity else n
            open_ = [place, what, line, -1, -1, part, section_line, -1]
    end(n)
    return out


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def exercise_blocks(n: pd.Series, events: pd.Series) -> pd.Series:
    """The exercises of each chunk, by line numbers: the one thing that has to follow the lines in order."""
    return pd.Series([_blocks(k, own.reshape(-1, 3).tolist()) if len(own) else [] for k, own in zip(n, events, strict=True)], dtype=object)


# Not to be moved into the lambdas that read its result, nor run again for a filter on it.
exercise_blocks = exercise_blocks.asNondeterministic()


def _events(lines: Column) -> Column:
    """Flat triples of line, number in _EVENTS and argument of the lines that are one."""
    patterns = {**_HEAD, "section": _SECTION_HEAD, "group": _GROUP_STEM, "item": _NUMBERED}
    number = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(_EVENTS.index(k))) for k, p in patterns.items()])
    more = lambda x, no: F.when(no == _EVENTS.index("activity"), (F.regexp_extract(x, _HEAD["activity"], 1) != "").cast("int")).when(no == _EVENTS.index("group"), _count(F.regexp_extract(x, _GROUP_STEM, 1))).otherwise(F.lit(0))
    some = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"].rlike(_MAY_BE[0]) | e["x"].rlike(_MAY_BE[1]))
    told = F.filter(F.transform(some, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"), number(e["x"]).alias("no"))), lambda e: e["no"].isNotNull())
    return F.flatten(F.transform(told, lambda e: F.array(e["i"], e["no"], more(e["x"], e["no"]))))


def build_exercises(chunks: DataFrame) -> DataFrame:
    """_id, book_id, parent_chunk_id, place, kind, label, stem, solution, options, inferred_qtype, table_markdown, figure_desc, math_text.

    chunks has _id, book_id, text and, if they are there, table_texts, image_texts
    and math_text, which go whole to each of the chunk's exercises, as a chunk does
    not say where in it they belong. An example or try-it box goes up to its
    solution, which belongs to it, an activity over 40 lines at most; under
    HOMEWORK and PRACTICE each numbered line opens an item, whose options are no
    part of its stem. The words of a group stem go before the stems of as many
    items as it announces, unless a heading comes first.

    All within the chunk's row: nothing is shuffled, and of a text only the lines
    that may open or end something are told apart.
    """
    text = text_or_empty(F.col("text"))
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(F.when(F.contains(text, F.lit("\r")), unix).otherwise(text), "\n")
    found = chunks.withColumn("events_", _events(lines)).withColumn("n_", F.size(lines))
    found = found.withColumn("blocks_", exercise_blocks("n_", "events_")).where(F.size("blocks_") > 0)
    kinds = F.array(*map(F.lit, _EVENTS))
    one_of = lambda b, k: b[1] == _EVENTS.index(k)
    texts = lambda ls, start, end: F.transform(F.slice(ls, start + 1, F.greatest(end - start, F.lit(0))), strip)

    def cut_out(ls: Column, b: Column) -> Column:
        head, item = F.get(ls, b[2]), one_of(b, "item")
        first = F.when(item, F.regexp_extract(head, _NUMBERED, 2)).when(one_of(b, "activity"), F.regexp_extract(head, _HEAD["activity"], 1)).otherwise("")
        solution = F.when(one_of(b, "example") | one_of(b, "try_it"), _one_line(F.array_join(texts(ls, b[4] + 1, b[3]), " "))).otherwise("")
        section = F.get(kinds, b[5])
        section_no = F.when(b[6] >= 0, F.regexp_extract(F.get(ls, b[6]), _SECTION_HEAD, 1))
        label = (
            F.when(item, F.concat(F.initcap(section), F.lit(" "), F.coalesce(F.concat(section_no, F.lit(" ")), F.lit("")), F.lit("Q"), F.regexp_extract(head, _NUMBERED, 1)))
            .when(one_of(b, "activity"), F.substring(_one_line(head), 1, 60))
            .otherwise(strip(F.concat(F.when(one_of(b, "example"), "Example ").otherwise("Try It "), F.regexp_extract(head, r"(\d+\.\d+)\s*$", 1))))
        )
        shared = F.when(b[7] >= 0, F.nullif(_one_line(F.regexp_extract(F.get(ls, b[7]), _GROUP_STEM, 2)), F.lit("")))
        kind = F.when(item, section).otherwise(F.get(kinds, b[1]))
        return F.struct(b[0].cast("long").alias("place"), kind.alias("kind"), item.alias("item"), label.alias("label"), shared.alias("shared"), solution.alias("solution"), F.concat(F.array(first), texts(ls, b[2] + 1, b[4])).alias("body"))

    def told(x: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(x["body"], lambda y: y.rlike(_OPTION)), True), F.lit(0)).cast("int")
        stem = let(at, lambda to: strip(F.concat_ws(" ", x["shared"], _one_line(F.array_join(F.when(x["item"] & (to > 1), F.slice(x["body"], 1, F.greatest(to - 1, F.lit(0)))).otherwise(x["body"]), " ")))))
        return F.struct(*[x[k].alias(k) for k in ("place", "kind", "label")], stem.alias("stem"), x["solution"].alias("solution"), _options(x["body"]).alias("options"))

    every = let(lines, lambda ls: F.transform("blocks_", lambda b: cut_out(ls, b)))
    sound = F.filter(F.transform(every, told), lambda x: ~is_junk(x["stem"]))
    ordered = F.array_sort(F.transform(sound, lambda x: F.struct(F.substring(F.lower(F.substring(x["stem"], 1, 320)), 1, 300).alias("normal"), x["place"].alias("place"), x.alias("own"))))
    once = let(ordered, lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["normal"] != x["normal"])))
    full = lambda c, sep: strip(F.array_join(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))), sep)) if c in chunks.columns else F.lit("")
    math = strip(text_or_empty(F.col("math_text"))) if "math_text" in chunks.columns else F.lit("")
    around = found.select(F.col("_id").alias("parent_chunk_id"), "book_id", once.alias("once_"), full("table_texts", "\n\n").alias("table_markdown"), full("image_texts", "\n").alias("figure_desc"), math.alias("math_text"))
    # The outer form, as for the other one Spark puts a filter on the array below it and makes all exercises twice.
    rows = around.select("*", F.explode_outer("once_").alias("x")).where("x IS NOT NULL").select("*", "x.own.*", F.col("x.normal").alias("normal"))
    return rows.select(
        entry_id(F.col("book_id"), F.col("parent_chunk_id"), F.col("normal")).alias("_id"), "book_id", "parent_chunk_id", "place", "kind", "label", "stem", "solution", "options",
        F.when(F.size("options") >= 2, "mcq").otherwise("short_answer").alias("inferred_qtype"), "table_markdown", "figure_desc", "math_text",
    )


def exercise_text(label: Column, stem: Column, options: Column, math: Column, table: Column, figure: Column) -> Column:
    """What an exercise is found by: label, stem, six options, and 600, 600 and 400 characters of its formulas, table and figure; 2200 in all."""
    part = lambda name, c, cap=None: F.when(text_or_empty(c) != "", F.concat(F.lit(f"{name}: "), F.substring(c, 1, cap) if cap else c))
    full = lambda c: F.nullif(text_or_empty(c), F.lit(""))
    return F.substring(F.concat_ws(" — ", full(label), full(stem), part("options", F.array_join(F.slice(options, 1, 6), " | ")), part("formulas", math, 600), part("table", table, 600), part("figure", figure, 400)), 1, 2200)


def index_status(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """book_id, index, status, n: each job with the entries its index has for the book."""
    n = entries.groupBy("book_id", "index").agg(F.count("*").alias("n"))
    return jobs.join(n, ["book_id", "index"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def worklist(books: DataFrame, indexes: list[str], done: DataFrame) -> DataFrame:
    """book_id, index for every book and index that is not done."""
    every = books.select("book_id").distinct().select("book_id", F.explode(F.array(*map(F.lit, indexes))).alias("index"))
    return every.join(done.select("book_id", "index"), ["book_id", "index"], "left_anti")


def usable_tables(tables: DataFrame) -> DataFrame:
    """Tables fit to ask about: four bars, no question mark, three rows below a header mostly of words; the first of equal beginnings."""
    rows = F.filter(F.split(F.col("table_markdown"), "\n"), lambda x: (F.regexp_count(x, F.lit(r"\|")) >= 1) & ~x.rlike(r"^[\s|:\-]+$"))
    cells = F.filter(F.transform(F.split(F.get(rows, 0), r"\|"), strip), lambda x: x != "")
    wordy = F.size(F.filter(cells, lambda x: x.rlike("[A-Za-z]"))) * 2 > F.size(cells)
    sound = tables.where((F.regexp_count("table_markdown", F.lit(r"\|")) >= 4) & ~F.col("table_markdown").contains("?") & (F.size(rows) >= 4) & wordy)
    own = Window.partitionBy(F.substring("table_markdown", 1, 80)).orderBy("_id")
    return sound.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")
